"""Mixing sources to target weights by Poisson replication.

A source that holds n of all N documents and shall make up the share w of the mixture gets the mean rate
w * N * scale / n. Each document draws from a Poisson distribution of that mean: a uniform number seeded by the
hash of its id is inverted through the cumulative distribution, so any run, retry or partitioning draws the same
count. Documents are exploded by their count and dealt to partitions by a second hash, in whose order they are
sorted: a global shuffle without sampling.

Rates above 16 are drawn as sums of equal parts of at most 16. Documents with more than ``LIGHT_PARTS`` of these are
drawn and exploded in blocks of so many parts, each a row of its own and dealt to tasks by itself, so that the copies of
one document never come from one task. Null sources are a source of their own; a null id
draws as the text "null". Sources without a target weight (or of weight 0) leave the mixture. Rows with equal ids
draw the same count. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MOST_RATE = 16.0
BROADCAST_SOURCES = 20_000
SALTS = 64
LIGHT_PARTS = 64


def uniform(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from the MD5 of seed and key: 52 bits, equal in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where nothing is left in double precision."""
    out, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        out.append(total)
        k += 1
        term *= rate / k
        if k > rate and term < 1e-18:
            return out


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0, source_col: str = "source") -> DataFrame:
    """One row per source: source, n, rate. Without weights all sources get equal shares."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        wanted = F.lit(1.0)
    else:
        wanted = F.coalesce(
            *(F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()), F.lit(0.0)
        )
    sized = written(counts.withColumn("w", wanted), "sources")
    total = sized.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    each = F.col("w") / F.lit(total.w) * F.lit(total.n) * F.lit(scale) / F.col("n") if total.w else F.lit(0.0)
    return sized.select("source", "n", each.alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    scale: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The mixture: all columns of ``docs`` with _copy (from 0), _copies, _rate and _place, globally shuffled by _place.

    Columns of ``docs`` with these four names are replaced; any other name is free.
    """
    spark = docs.sparkSession
    docs = docs.drop("_copy", "_copies", "_rate", "_place")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(id_col).alias("_id"), F.col(source_col).alias("_from"))
    rates = source_rates(docs, weights, scale, source_col).select(F.col("source").alias("_source"), F.col("rate").alias("_rate")).where("rate > 0")
    known = rates.orderBy(F.desc("_rate"), "_source").limit(BROADCAST_SOURCES + 1).collect()
    if len(known) <= BROADCAST_SOURCES:
        parts = [max(1, math.ceil(r._rate / MOST_RATE)) for r in known]
        table = spark.createDataFrame(
            [(r._source, r._rate, p, cumulative(r._rate / p)) for r, p in zip(known, parts)], "_source string, _rate double, _parts int, _cdf array<double>"
        )
        joined = held.join(F.broadcast(table), F.col("_from").eqNullSafe(F.col("_source")))
    else:  # too many sources to broadcast: a salted join, so that a hot source is spread
        @F.udf("array<double>")
        def cdf(rate: float) -> list[float]:
            return cumulative(rate)

        table = (
            rates.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MOST_RATE)).cast("int"))
            .withColumn("_cdf", cdf(F.col("_rate") / F.col("_parts")))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        )
        salted = held.withColumn("_salt0", F.pmod(F.hash("_id"), F.lit(SALTS)))
        joined = salted.join(table, F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_salt0") == F.col("_salt")))
    key = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    draw = lambda part: F.size(F.filter("_cdf", lambda p: p <= uniform(F.concat(key, F.lit("/"), part.cast("string")), seed)))
    count = F.when(F.col("_parts") == 1, draw(F.lit(0))).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.col("_parts") - 1), F.lit(0), lambda total, part: total + draw(part))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = ("_doc", "_id", "_copy", "_copies", "_rate")
    copies = (
        joined.where(F.col("_parts") <= LIGHT_PARTS)
        .withColumn("_copies", count.cast("int"))
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .select(*kept)
    )
    top = known[0]._rate if known and len(known) <= BROADCAST_SOURCES else rates.agg(F.max("_rate")).first()[0]
    if (top or 0.0) > MOST_RATE * LIGHT_PARTS:
        # numbered once in a written table, so that blocks of a document find each other whatever repeats
        heavy = written(joined.where(F.col("_parts") > LIGHT_PARTS).select("_doc", "_id", "_rate", "_parts", "_cdf").withColumn("_row", F.monotonically_increasing_id()), "heavy")
        blocks = F.ceil(F.col("_parts") / LIGHT_PARTS).cast("int")
        slots = F.least(blocks, F.lit(n))
        drawn = heavy.select("_row", "_id", "_parts", "_cdf", slots.alias("_slots"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block")).repartition(n, "_row", "_block")
        own = F.sequence(F.col("_block") * LIGHT_PARTS, F.least((F.col("_block") + 1) * LIGHT_PARTS, F.col("_parts")) - 1)
        drawn = drawn.select("_row", "_block", "_slots", F.aggregate(own, F.lit(0).cast("long"), lambda total, part: total + draw(part)).alias("_n"))
        along = Window.partitionBy("_row").orderBy("_block")  # one narrow row a block
        placed = drawn.withColumns({"_first": F.sum("_n").over(along) - F.col("_n"), "_copies": F.sum("_n").over(Window.partitionBy("_row"))}).where("_n > 0")
        placed = placed.withColumn("_slot", F.col("_block") % F.col("_slots")).drop("_slots")
        spread = heavy.select("_row", "_doc", "_id", "_rate", F.explode(F.sequence(F.lit(0), slots - 1)).alias("_slot"))
        more = spread.hint("merge").join(placed, ["_row", "_slot"]).withColumn("_copy", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
        copies = copies.unionByName(more.withColumns({c: F.col(c).cast("int") for c in ("_copy", "_copies")}).select(*kept))
    key = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    copies = copies.withColumn("_place", uniform(F.concat(key, F.lit("#"), F.col("_copy").cast("string")), seed))
    dealt = copies.repartitionById(n, F.floor(F.col("_place") * n).cast("int")).sortWithinPartitions("_place", "_id")
    return dealt.select(*(F.col(f"_doc.`{c}`") for c in docs.columns), "_copy", "_copies", "_rate", "_place")
