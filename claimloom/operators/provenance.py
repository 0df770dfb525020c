"""Closure over evidence citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import order_of
from .graph import settled


def citations(claims: DataFrame) -> DataFrame:
    """Rows (id, cited): which claim cites which."""
    return claims.select("id", F.explode("evidence").alias("e")).where("e.kind = 'claim' and e.claim_id is not null").select("id", F.col("e.claim_id").alias("cited")).distinct()


def gamma(ranked: DataFrame, lookup: DataFrame, depth: int) -> DataFrame:
    """The ranked claims and what they cite, up to ``depth`` steps away, each once and behind them with score 0.

    Every step joins the frontier's citations with the corpus and leaves out what was reached before. ``depth`` column:
    0 for the input.
    """
    found = ranked.withColumn("depth", F.lit(0))
    reached, frontier = found.select("id"), found
    for level in range(1, depth + 1):
        nearest = citations(frontier).groupBy(F.col("cited").alias("id")).agg(F.min("id").alias("via"))
        new = lookup.join(nearest.join(reached, "id", "left_anti"), "id").withColumn("score", F.lit(0.0)).withColumn("depth", F.lit(level))
        new = new.withColumn("ord", order_of(level, F.col("recorded_seq"), F.col("id"))).select(*found.columns)
        found, reached, frontier = found.unionByName(new), reached.unionByName(new.select("id")), new
    return found


def would_create_cycle(claims: DataFrame, claim_id: str, cites: list[str]) -> bool:
    """Whether citing ``cites`` from ``claim_id`` closes a circle: it is reachable from them, at any depth."""
    if claim_id in cites:
        return True
    edges = settled(citations(claims), "citations")
    frontier = claims.sparkSession.createDataFrame([(c,) for c in cites], "id string")
    seen = frontier
    while True:
        frontier = settled(edges.join(frontier, "id", "left_semi").select(F.col("cited").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        hit = frontier.agg(F.count("*").alias("n"), F.bool_or(F.col("id") == claim_id).alias("hit")).first()
        if hit.hit or not hit.n:
            return bool(hit.hit)
        seen = settled(seen.unionByName(frontier), "seen")
