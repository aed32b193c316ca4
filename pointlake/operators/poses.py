"""Poses of a two-finger hand: enumeration, finger tests, closing region, antipodal labels, geometry of a pose."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import axis_rotation, dot, mul3
from ..params import Hand
from .spatial import radius_join
from .whole import MOST, parted, whole
from .whole_poses import fitted_whole, reevaluated_whole, tested_whole

R = [f"r{i}{j}" for i in range(3) for j in range(3)]
POSE = ("cloud_id", "sample_id", "orient")


def pose_grid(frames: DataFrame, axes=(2,), n_orient: int = 8) -> DataFrame:
    """Every frame with every rotation axis and orientation: axis, orient, r00 .. r22.

    Angles go from -90 degrees in steps of 180 / n_orient. At angle 0 the approach is against the frame's normal.
    """
    frame = [F.col(f"{v}{i}") for i in range(3) for v in "nbc"]
    turn = [-1.0, 0, 0, 0, 1.0, 0, 0, 0, -1.0]
    grid = []
    for axis in axes:
        for k in range(n_orient):
            r = axis_rotation(axis, -math.pi / 2 + math.pi * k / n_orient)
            r = [sum(turn[3 * i + m] * r[3 * m + j] for m in range(3)) for i in range(3) for j in range(3)]
            grid.append(F.struct(F.lit(axis).alias("axis"), F.lit(k).alias("orient"), *[F.lit(x).alias(f"q{i}") for i, x in enumerate(r)]))
    out = frames.withColumn("g_", F.explode(F.array(*grid)))
    product = mul3(frame, [F.col("g_")[f"q{i}"] for i in range(9)])
    return out.withColumns({"axis": F.col("g_")["axis"], "orient": F.col("g_")["orient"]} | dict(zip(R, product, strict=True))).drop("g_")


def to_frame(neigh: DataFrame) -> DataFrame:
    """fwd, lat, ver: the point in the pose's frame (approach, binormal, axis); nf, nl, nv its normal, if there is one."""
    gap = [F.col(c) - F.col(f"s{c}") for c in "xyz"]
    column = lambda j: [F.col(f"r{i}{j}") for i in range(3)]
    out = neigh.withColumns({c: dot(column(j), gap) for j, c in enumerate(("fwd", "lat", "ver"))})
    if "nx" in neigh.columns:
        out = out.withColumns({c: dot(column(j), ("nx", "ny", "nz")) for j, c in enumerate(("nf", "nl", "nv"))})
    return out


def rotate(points: DataFrame) -> DataFrame:
    """x, y, z turned by the row's rotation r00 .. r22, without translation."""
    return points.withColumns({c: dot([F.col(f"r{i}{j}") for j in range(3)], ("x", "y", "z")) for i, c in enumerate("xyz")})


def crop_height(neigh: DataFrame, height: float) -> DataFrame:
    """Points strictly within ``height`` of the hand's plane."""
    return neigh.where((F.col("ver") > -height) & (F.col("ver") < height))


def neighbourhoods(samples: DataFrame, poses: DataFrame, points: DataFrame, hand: Hand, keys=POSE) -> DataFrame:
    """Points around each sample, joined once, then turned into the frame of each of its poses and cropped."""
    near = radius_join(samples.select("cloud_id", "sample_id", "sx", "sy", "sz"), points, hand.reach())
    met = near.join(poses.drop("sx", "sy", "sz"), ["cloud_id", "sample_id"])
    return crop_height(to_frame(met), hand.height)


def _free(bite: Column, slot: float, hand: Hand) -> Column:
    return F.min(~((F.col("fwd") < bite) & (F.col("lat") > slot) & (F.col("lat") < slot + hand.finger)))


def finger_tests(hand: Hand, n: int) -> dict[str, Column]:
    """Aggregates over a pose's points: whether one is behind the bottom, one within the bite, and no one in each of the 2n slots."""
    bite, bottom = F.lit(hand.bite), F.lit(hand.bite - hand.depth)
    slots = {f"s{i}": _free(bite, s, hand) for i, s in enumerate(hand.slots(n))}
    return {"palm": F.max((F.col("fwd") < bite) & (F.col("fwd") < bottom)), "some": F.max(F.col("fwd") < bite)} | slots


def _fingers(n: int) -> Column:
    ok = F.col("some") & ~F.col("palm")
    return F.array(*[ok & F.col(f"s{i}") for i in range(2 * n)])


def finger_placements(neigh: DataFrame, hand: Hand, n: int = 10, keys=POSE) -> DataFrame:
    """``fingers``: for each of the 2n slots of every pose, whether a finger fits; one aggregate for all slots.

    All are false if a point is behind the hand's bottom, or none is within the bite.
    """
    out = neigh.groupBy(*keys).agg(*[test.alias(name) for name, test in finger_tests(hand, n).items()])
    return out.select(*keys, _fingers(n).alias("fingers"))


def hand_feasible(fingers: DataFrame, n: int = 10) -> DataFrame:
    """``hands``: whether both fingers of each of the n placements fit."""
    return fingers.withColumn("hands", F.array(*[F.col("fingers")[i] & F.col("fingers")[n + i] for i in range(n)]))


def choose_middle(hands: DataFrame) -> DataFrame:
    """``placement``: of the m feasible indices the one numbered ceil(m / 2) - 1, or -1 if there is none."""
    at = F.filter(F.transform("hands", lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    out = hands.withColumn("at_", at)
    return out.withColumn("placement", F.when(F.size("at_") == 0, -1).otherwise(F.element_at("at_", F.greatest(F.lit(1), F.ceil(F.size("at_") / 2).cast("int")))).cast("int")).drop("at_")


def slot_columns(poses: DataFrame, hand: Hand, n: int = 10) -> DataFrame:
    """slot_l and slot_r: lateral starts of the two fingers at the row's placement."""
    at = F.array(*[F.lit(s) for s in hand.slots(n)])
    return poses.withColumns({"slot_l": F.get(at, F.col("placement")), "slot_r": F.get(at, F.col("placement") + n)})


def depth_tests(hand: Hand, step: float) -> dict[str, Column]:
    """Aggregates over a pose's points (with slot_l, slot_r): whether step k of the bite has a point within (in), or one in its way (hit)."""
    tests = {}
    for k in range(round((hand.depth - hand.bite) / step) + 1):
        bite = hand.bite + k * step
        inside = F.col("fwd") < bite
        finger = [(F.col("lat") > F.col(s)) & (F.col("lat") < F.col(s) + hand.finger) for s in ("slot_l", "slot_r")]
        hit = inside & ((F.col("fwd") < bite - hand.depth) | finger[0] | finger[1])
        tests |= {f"in{k}": F.max(inside), f"hit{k}": F.max(hit)}
    return tests


def _deepest(hand: Hand, step: float) -> Column:
    most = round((hand.depth - hand.bite) / step)
    ok = lambda k: F.col(f"in{k}") & ~F.coalesce(F.col(f"hit{k}"), F.lit(False))
    stop = F.coalesce(*[F.when(~ok(k), F.lit(k)) for k in range(1, most + 1)], F.lit(most + 1))
    return F.lit(hand.bite) + (stop - 1) * step


def deepen(neigh: DataFrame, hand: Hand, step: float, keys=POSE) -> DataFrame:
    """top and bottom of the deepest bite reached in steps from the initial one without collision; ``neigh`` has slot_l, slot_r."""
    out = neigh.groupBy(*keys).agg(*[test.alias(name) for name, test in depth_tests(hand, step).items()])
    return out.select(*keys, _deepest(hand, step).alias("top")).withColumn("bottom", F.col("top") - hand.depth)


def closing_region(neigh: DataFrame, hand: Hand) -> DataFrame:
    """Points strictly between bottom and top and between the fingers; ``neigh`` has top, bottom, slot_l, slot_r."""
    left, right = F.col("slot_l") + hand.finger, F.col("slot_r")
    return neigh.where((F.col("fwd") > F.col("bottom")) & (F.col("fwd") < F.col("top")) & (F.col("lat") > left) & (F.col("lat") < right)).withColumn("centre", (left + right) / 2)


def closing_width(closing: DataFrame, keys=POSE) -> DataFrame:
    """Number of points and lateral extent; poses without points have no row, that is, aren't valid."""
    return closing.groupBy(*keys).agg(F.count("*").alias("n_closing"), (F.max("lat") - F.min("lat")).alias("width"))


def _sides(closing: DataFrame, friction: float, near: float, keys) -> tuple[DataFrame, dict[str, Column]]:
    """The closing points with what their pose tells about both sides, and the aggregates that end in its label.

    All that a pose tells is taken in windows over its keys, so that rows stay where they are: one partitioning serves every step.
    """
    over = Window.partitionBy(*keys)
    cone = math.cos(math.radians(friction))
    met = closing.withColumns({"l0": F.min("lat").over(over), "l1": F.max("lat").over(over)})
    met = met.withColumns({"on_l": (-F.col("nl") > cone) & (F.col("lat") < F.col("l0") + near), "on_r": (F.col("nl") > cone) & (F.col("lat") > F.col("l1") - near)})
    side = lambda f, c, s: f(F.when(F.col(f"on_{s}"), F.col(c))).over(over)
    met = met.withColumns({f"{m}_{c}_{s}": side(f, c, s) for s in "lr" for c in ("fwd", "ver") for m, f in (("min", F.min), ("max", F.max))})
    box = None
    for c in ("fwd", "ver"):
        part = (F.col(c) >= F.greatest(f"min_{c}_l", f"min_{c}_r")) & (F.col(c) <= F.least(f"max_{c}_l", f"max_{c}_r"))
        box = part if box is None else box & part
    two = F.col("min_fwd_l").isNotNull() & F.col("min_fwd_r").isNotNull()
    some = F.col("min_fwd_l").isNotNull() | F.col("min_fwd_r").isNotNull()
    return met, {"two": F.max(two), "some": F.max(some)} | {f"n_{s}": F.sum((F.col(f"on_{s}") & box).cast("long")) for s in "lr"}


def _label(viable: int) -> Column:
    full = F.col("two") & (F.col("n_l") >= viable) & (F.col("n_r") >= viable)
    return F.when(full, 2).when(F.col("some"), 1).otherwise(0)


def antipodal_label(closing: DataFrame, friction: float, viable: int, near: float, keys=POSE) -> DataFrame:
    """``label`` 0 none, 1 half, 2 full, from the outermost points whose normals lie in the friction cone (degrees)."""
    met, told = _sides(closing, friction, near, keys)
    out = met.groupBy(*keys).agg(*[a.alias(name) for name, a in told.items()])
    return out.select(*keys, _label(viable).alias("label"))


def tested_poses(neigh: DataFrame, hand: Hand, placements: int, step: float | None, friction: float, viable: int, near: float, keys=POSE) -> DataFrame:
    """Per feasible pose with points between its fingers: placement, slots, top, bottom, centre, n_closing, width, label.

    Finger placements, middle, depth, closing region, width and label of every pose over one partitioning by its keys: each
    step adds what the pose tells to its points, and one aggregate ends it.
    """
    over = Window.partitionBy(*keys)
    held = neigh.withColumns({name: test.over(over) for name, test in finger_tests(hand, placements).items()})
    held = held.select(*neigh.columns, _fingers(placements).alias("fingers"))
    held = choose_middle(hand_feasible(held, placements)).where("placement >= 0").drop("fingers", "hands")
    held = slot_columns(held, hand, placements)
    if step:
        kept = held.columns
        held = held.withColumns({name: test.over(over) for name, test in depth_tests(hand, step).items()})
        held = held.select(*kept, _deepest(hand, step).alias("top")).withColumn("bottom", F.col("top") - hand.depth)
    else:
        held = held.withColumns({"top": F.lit(hand.bite), "bottom": F.lit(hand.bite - hand.depth)})
    met, told = _sides(closing_region(held, hand), friction, near, keys)
    same = [F.first(c).alias(c) for c in ("placement", "slot_l", "slot_r", "top", "bottom", "centre")]
    out = met.groupBy(*keys).agg(*same, F.count("*").alias("n_closing"), (F.max("lat") - F.min("lat")).alias("width"), *[a.alias(name) for name, a in told.items()])
    return out.withColumn("label", _label(viable)).drop(*told)


def _at_samples(samples: DataFrame, grid: DataFrame, keys) -> DataFrame:
    """Keys, sample point and rotation of every pose."""
    return grid.select(*keys, *R).join(samples.select("cloud_id", "sample_id", "sx", "sy", "sz"), ["cloud_id", "sample_id"])


def feasible_poses(samples: DataFrame, grid: DataFrame, points: DataFrame, hand: Hand, n: int = 10, keys=POSE, most: int = MOST) -> DataFrame:
    """Poses of ``grid`` (keys, r00..r22) at ``samples`` where both fingers fit: keys, sx..sz, r00..r22, placement, slot_l, slot_r.

    Clouds of at most ``most`` points and poses are met whole, in one exchange; others by cells.
    """
    keys = list(keys)
    (at, small), large = parted("cloud_id", most, _at_samples(samples, grid, keys), points)
    out = fitted_whole(at, small, hand, n)
    if large is not None:
        fit = choose_middle(hand_feasible(finger_placements(neighbourhoods(samples, large[0], large[1], hand, keys), hand, n, keys), n))
        out = out.unionByName(large[0].join(fit.where("placement >= 0").select(*keys, "placement"), keys))
    return slot_columns(out, hand, n)


def candidate_poses(samples: DataFrame, grid: DataFrame, points: DataFrame, hand: Hand, placements: int, step: float | None, friction: float, viable: int, near: float, keys=POSE, most: int = MOST) -> DataFrame:
    """Poses of ``grid`` at ``samples`` that fit and have points between their fingers: what ``tested_poses`` gives, sx..sz and r00..r22.

    Clouds of at most ``most`` points and poses are met whole, in one exchange; others by cells and windows.
    """
    keys = list(keys)
    (at, small), large = parted("cloud_id", most, _at_samples(samples, grid, keys), points)
    out = slot_columns(tested_whole(at, small, hand, placements, step, friction, viable, near), hand, placements)
    out = out.withColumns({"top": F.lit(hand.bite) + (F.col("stop") - 1) * step if step else F.lit(hand.bite), "centre": (F.col("slot_l") + hand.finger + F.col("slot_r")) / 2})
    if whole(at, "sx", "sy", "sz", *R) and whole(small, "x", "y", "z"):
        out = out.withColumn("width", F.col("width").cast("long"))
    out = out.withColumn("bottom", F.col("top") - hand.depth).drop("stop")
    if large is not None:
        tested = tested_poses(neighbourhoods(samples, large[0], large[1], hand, keys), hand, placements, step, friction, viable, near, keys)
        out = out.unionByName(large[0].join(tested, keys))
    return out


def antipodal_from_normals(closing: DataFrame, half: float, full: float, keys=POSE) -> DataFrame:
    """``label`` by the numbers of normals in the cones about -lateral and +lateral: more than 6 in one, or in both."""
    count = lambda sign, angle: F.sum((sign * F.col("nl") > math.cos(math.radians(angle))).cast("long"))
    out = closing.groupBy(*keys).agg(count(-1, half).alias("hl"), count(1, half).alias("hr"), count(-1, full).alias("fl"), count(1, full).alias("fr"))
    return out.select(*keys, F.when((F.col("fl") > 6) & (F.col("fr") > 6), 2).when((F.col("hl") > 6) | (F.col("hr") > 6), 1).otherwise(0).alias("label"))


def reevaluate(poses: DataFrame, mesh: DataFrame, hand: Hand, friction: float, viable: int, near: float, keys=POSE, most: int = MOST) -> DataFrame:
    """Label of existing poses against another cloud: only the stored placement at the stored top is tested.

    poses: keys, sx..sz, r00..r22, slot_l, slot_r, top, bottom. No points, or a finger that doesn't fit, give 0. Clouds of at most ``most``
    points and poses are met whole, in one exchange; others by cells and windows.
    """
    keys = list(keys)
    (small, solid), large = parted("cloud_id", most, poses.select(*keys, "sx", "sy", "sz", *R, "slot_l", "slot_r", "top", "bottom"), mesh)
    out = reevaluated_whole(small, solid, hand, friction, viable, near, keys)
    return out if large is None else out.unionByName(_reevaluated_by_cells(*large, hand, friction, viable, near, keys))


def _reevaluated_by_cells(poses: DataFrame, mesh: DataFrame, hand: Hand, friction: float, viable: int, near: float, keys) -> DataFrame:
    neigh = neighbourhoods(poses.select("cloud_id", "sample_id", "sx", "sy", "sz").distinct(), poses, mesh, hand, keys)
    inside = F.col("fwd") < F.col("top")
    finger = lambda s: (F.col("lat") > F.col(s)) & (F.col("lat") < F.col(s) + hand.finger)
    over = Window.partitionBy(*keys)
    hit = F.max(inside & ((F.col("fwd") < F.col("bottom")) | finger("slot_l") | finger("slot_r"))).over(over)
    held = neigh.withColumn("fits", F.max(inside).over(over) & ~hit).where("fits")
    label = antipodal_label(closing_region(held, hand), friction, viable, near, keys)
    return poses.select(*keys).join(label, keys, "left").select(*keys, F.coalesce("label", F.lit(0)).alias("label"))


def pose_axes(poses: DataFrame) -> DataFrame:
    """Approach a0..a2, binormal b0..b2 and axis c0..c2: the columns of the rotation."""
    return poses.withColumns({f"{v}{i}": F.col(f"r{i}{j}") for j, v in enumerate("abc") for i in range(3)})


def grasp_position(poses: DataFrame) -> DataFrame:
    """px, py, pz = R (bottom, centre, 0) + s."""
    return poses.withColumns({f"p{c}": F.col(f"r{i}0") * F.col("bottom") + F.col(f"r{i}1") * F.col("centre") + F.col(f"s{c}") for i, c in enumerate("xyz")})


def pose_to_matrix(poses: DataFrame) -> DataFrame:
    """``m``: rotation and position as 16 numbers, row-major; the last row stays zero."""
    rows = [F.col(x) for i, c in enumerate("xyz") for x in (f"r{i}0", f"r{i}1", f"r{i}2", f"p{c}")]
    return poses.withColumn("m", F.array(*[x.cast("double") for x in rows], *[F.lit(0.0)] * 4))


def pose_to_quaternion(poses: DataFrame) -> DataFrame:
    """qx, qy, qz, qw of the rotation, by the greatest of trace and diagonal."""
    r = {(i, j): F.col(f"r{i}{j}").cast("double") for i in range(3) for j in range(3)}
    t = r[0, 0] + r[1, 1] + r[2, 2]
    s0 = F.sqrt(t + 1) * 2
    cases = [(t > 0, [(r[2, 1] - r[1, 2]) / s0, (r[0, 2] - r[2, 0]) / s0, (r[1, 0] - r[0, 1]) / s0, s0 / 4])]
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        s = F.sqrt(r[i, i] - r[j, j] - r[k, k] + 1) * 2
        q = [None] * 4
        q[i], q[j], q[k], q[3] = s / 4, (r[j, i] + r[i, j]) / s, (r[k, i] + r[i, k]) / s, (r[k, j] - r[j, k]) / s
        cases.append(((r[i, i] >= r[j, j]) & (r[i, i] >= r[k, k]), q))
    out = {}
    for n, c in enumerate(("qx", "qy", "qz", "qw")):
        value = F.when(cases[0][0], cases[0][1][n])
        for when, q in cases[1:]:
            value = value.when(when, q[n])
        out[c] = value
    return poses.withColumns(out)
