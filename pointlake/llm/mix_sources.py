"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is ``rows * weight / rows of the source``. Every document gets a uniform number
from a seeded hash of its id, and that number is put through the inverse of the Poisson distribution with
the source's rate; the document is exploded by the count and all copies are shuffled by another hash.
All of it is column expressions: only the numbers of rows and of weights pass the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as an array, to where nothing a double can tell is left."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] + F.ln(rate) - F.ln(k)
        c = acc["c"] + F.exp(p)
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["out"], F.array(c)).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["out"]).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Documents repeated to the target weights, with ``copy`` (from 1) and ``shuffle_key``; partitions are sorted by it.

    ``weights`` has source and weight: what isn't named has weight 0. Without it, a source's weight is its
    number of rows to the power ``alpha``. Weights are normalised; negative and null ones count as 0. A null source is
    a source. Rows that repeat an id get equal counts; a null id is hashed as an empty string; texts of any length are
    carried as they are. Columns of the input named copy or shuffle_key are replaced, all others stay whatever their
    names. No rows give no rows.
    """
    counts = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        named = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("w")).groupBy("named").agg(F.sum("w").alias("w"))
        weighed = counts.join(named, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    rows, total = weighed.agg(F.sum("n"), F.sum("w")).first()
    rate = F.col("w") * F.lit(float(rows or 0)) / F.col("n") / F.lit(float(total or 1.0))
    own, cdf, count = fresh(docs, "source"), fresh(docs, "cdf"), fresh(docs, "count")
    rates = cut(weighed.select("source", rate.alias("rate")).select(F.col("source").alias(own), poisson_cdf(F.col("rate")).alias(cdf)), "rates")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform(F.concat(F.lit(seed + ":"), name))
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    met = docs.select(*[F.col(f"`{c}`") for c in kept], u.alias(count)).join(rates, F.col(source_col).eqNullSafe(F.col(own)))
    copies = met.withColumn(count, F.size(F.filter(cdf, lambda c: c <= F.col(count)))).where(F.col(count) > 0)
    copies = copies.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(seed + ":order:"), name, F.lit(":"), F.col("copy").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n::DOUBLE) * (SELECT sum(n) FROM s)::DOUBLE / n / (SELECT sum(sqrt(n::DOUBLE)) FROM s) AS rate FROM s),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS k)),
u AS (SELECT *, ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT u.doc_id, count(p.k) AS m FROM u LEFT JOIN p ON p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.u GROUP BY u.doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INT) AS copy, md5('mix-1:order:' || doc_id || ':' || k) AS shuffle_key
FROM documents JOIN m USING (doc_id), LATERAL (SELECT unnest(generate_series(1, m)) AS k)
"""
