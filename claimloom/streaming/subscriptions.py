"""Subscriptions: queries that follow a growing claim log with Structured Streaming.

``on_every_match`` delivers each new claim that matches a predicate. ``on_transition`` delivers a change of a triple
between agreed and contested, either way: state per triple is its live claims, kept by the state store. Deliveries
are at least once; ``delivery_id`` (subscription, recorded, claim) is the same on every attempt, so a sink that
upserts by it sees each once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.confidence import effective
from ..schema import CLAIM_COLUMNS, TRIPLE, ddl


def claim_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The claims under a path as a stream, oldest files first."""
    reader = spark.readStream.schema(ddl(CLAIM_COLUMNS))
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def delivery_id(subscription: str) -> Column:
    return F.concat_ws("|", F.lit(subscription), F.col("recorded").cast("string"), F.col("id"))


def on_every_match(log: DataFrame, subscription: str, predicate: Column) -> DataFrame:
    return log.where(predicate).withColumn("delivery_id", delivery_id(subscription))


def on_every_write(log: DataFrame, subscription: str) -> DataFrame:
    return on_every_match(log, subscription, F.lit(True))


_CHANGE = "subject string, key string, scope_hash string, was string, became string, values int, claim_id string, recorded bigint"


def _transitions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the live claims of a triple as parallel lists of ids and value hashes. A status change takes a claim out."""
    live = dict(zip(*state.get)) if state.exists else {}
    counts = Counter(live.values())
    rows = pd.concat(list(batches)).sort_values(["recorded", "id"])
    out = []
    for id_, value, counted, recorded in zip(rows["id"], rows["value_hash"], rows["counted"], rows["recorded"]):
        before = len(counts)
        if (old := live.pop(id_, None)) is not None:
            counts[old] -= 1
            counts += Counter()
        if counted:
            live[id_] = value
            counts[value] += 1
        if (before < 2) != (len(counts) < 2):
            was, became = ("agreed", "contested") if before < 2 else ("contested", "agreed")
            out.append((*key, was, became, len(counts), id_, recorded))
    state.update((list(live), list(live.values())))
    yield pd.DataFrame(out, columns=["subject", "key", "scope_hash", "was", "became", "values", "claim_id", "recorded"])


def on_transition(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows when a triple's eligible claims begin or cease to disagree: once per boundary crossed, whatever the batches.

    A later row of an id replaces the earlier one; a claim that becomes deprecated or falls to the threshold drops out.
    """
    counted = (effective() > threshold) & (F.col("status") != "deprecated")
    return (
        log.select(*TRIPLE, "value_hash", "id", "recorded", F.coalesce(counted, F.lit(False)).alias("counted"))
        .groupBy(*TRIPLE)
        .applyInPandasWithState(_transitions, _CHANGE, "ids array<string>, hashes array<string>", "append", GroupStateTimeout.NoTimeout)
    )


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a subscription over what is there: each micro-batch goes to ``sink`` (frame, number), at least once."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A standing aggregate: eligible claims and distinct values per triple, for ``update`` mode."""
    return log.where(effective() > threshold).groupBy(*TRIPLE).agg(F.count("*").alias("claims"), F.approx_count_distinct("value_hash").alias("values"))
