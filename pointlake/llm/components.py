"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the not larger) neighbours of each node on its smallest neighbour."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    kept = both.join(least, "u")
    if larger:
        kept = kept.where("v > u")
        return kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return out.unionByName(own).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """(node, label): the smallest id reachable from each linked node. Links are rows; none pass the driver.

    Null ends and self links are ignored; repeated links count once; no links give an empty table.
    """
    pairs = links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    pairs = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(pairs)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        pairs = cut(_stars(_stars(pairs, True), False), "stars")
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
