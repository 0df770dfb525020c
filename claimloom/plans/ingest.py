"""Ingestion: extracted records take over existing names where they fit, are written, and the corpus is audited."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census


@dataclass
class Ingested:
    outcomes: DataFrame
    remapped: DataFrame
    proposals: DataFrame


def reused_names(records: DataFrame, claims: DataFrame, axis: str, t: int) -> DataFrame:
    """Rows (value, best) for new names that are an existing one in other words."""
    found = census.reconcile(records.select(F.col(axis).alias("value")), claims, axis, t)
    return found.where("disposition = 'reuse' and best <> value").select("value", "best")


def remap(records: DataFrame, claims: DataFrame, t: int) -> DataFrame:
    """Records with subject and key replaced by the existing names they reuse; names in doubt stay as they are."""
    out = records
    for axis in ("subject", "key"):
        names = reused_names(out, claims, axis, t).withColumnsRenamed({"value": axis, "best": "_best"})
        out = out.join(names, axis, "left").withColumn(axis, F.coalesce("_best", axis)).drop("_best")
    return out.select(*records.columns)


def ingest(engine, corpus_id: str, texts: DataFrame, extract: Callable[[DataFrame], DataFrame], writer: str = "ingest") -> Ingested:
    """``extract`` turns texts into claims; they are reconciled with the corpus, committed under its policy and audited."""
    before = engine.claims(corpus_id)
    batch = remap(extract(texts), before, engine.clock())
    outcomes = engine.commit_batch(corpus_id, batch, writer)
    return Ingested(outcomes, batch, engine.audit(corpus_id))
