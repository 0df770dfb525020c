"""What several corpus operators share: written tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import settled as written  # writes to the shared folder and reads back: cuts lineage, survives lost executors


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a long, b long), as rows (node, component).

    The component is its smallest node. Large-star and small-star steps alternate until the edges no longer
    change; every step is a partial aggregate and a join, so no vertex's neighbourhood meets in one task as a
    list. Null ends, loops and repeated edges are ignored. An empty input gives an empty result.
    """
    edges = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")), label)  # so that the join can split a node of many neighbours
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), label)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
