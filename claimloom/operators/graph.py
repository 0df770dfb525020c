"""Connected components and the shared folder in which iterations leave their tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder on a local master, the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        folder = tempfile.mkdtemp(prefix="claimloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/claimloom-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/claimloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for edges (a, b): the component is its smallest node.

    Every round joins labels to edges, takes the least label around each node, then jumps to the label's own label.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both, "edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("component", "near").alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("further"))
        new = settled(lower.join(jump, "low").select("node", "low", F.least("low", "further").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
