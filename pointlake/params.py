"""Parameters as frozen dataclasses; lengths are in the unit of the coordinates."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Box:
    """An axis-aligned box."""

    x0: float
    x1: float
    y0: float
    y1: float
    z0: float
    z1: float

    def sides(self):
        return (self.x0, self.x1), (self.y0, self.y1), (self.z0, self.z1)


@dataclass(frozen=True)
class Hand:
    """Gripper geometry: finger width, outer diameter, depth, height, initial bite."""

    finger: float
    outer: float
    depth: float
    height: float
    bite: float

    def reach(self):
        return max(self.outer - self.finger, self.depth, self.height / 2)

    def slots(self, n: int) -> list[float]:
        """Lateral starts of the n left finger slots, then of the n right ones."""
        span = self.outer - self.finger
        at = [span * i / (n - 1) for i in range(n)] if n > 1 else [0.0]
        return [h - self.outer + self.finger for h in at] + at


@dataclass(frozen=True)
class Image:
    """Descriptor image: volume of interest and number of cells a side."""

    depth: float
    width: float
    height: float
    size: int = 60
