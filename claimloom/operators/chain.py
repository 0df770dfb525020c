"""Tamper evidence: hash chains over event logs and Merkle roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import json_quoted
from .graph import settled

EVENT_FIELDS = ("op", "corpus_id", "writer", "claim_id", "deprecated_id", "to_status", "reason", "recorded", "recorded_seq")


#: Events of one number, as of one batch, follow each other by their claim.
ORDER = ("recorded_seq", "claim_id")
#: Sequence numbers of one bucket: what is ordered inside one task.
BUCKET = 1 << 16
#: Nodes of a Merkle tree that meet in one group.
FAN = 1 << 10


def canonical_column() -> Column:
    """An event as the JSON text that is hashed. Building and verifying share it."""
    parts = [F.coalesce(F.col(f).cast("string") if f.startswith("recorded") else json_quoted(F.col(f)), F.lit("null")) for f in EVENT_FIELDS]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def build_chain(events: DataFrame, start: dict[str, str] | None = None) -> DataFrame:
    """Adds prev_hash and entry_hash, in ``ORDER`` in each corpus.

    Each hash needs the one before, so a corpus is one sequential stream; it is read in sorted batches, with one hash
    in memory. ``start``: the last hash of a corpus that has a log already.
    """
    begun = start or {}
    schema = events.schema
    schema = schema.add("prev_hash", "string").add("entry_hash", "string")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus, last = None, ""
        for batch in batches:
            before, after = [], []
            for owner, text in zip(batch["corpus_id"], batch["_text"]):
                if owner != corpus:
                    corpus, last = owner, begun.get(owner, "")
                before.append(last)
                last = hashlib.sha256((text + last).encode("utf-8", "surrogatepass")).hexdigest()
                after.append(last)
            yield batch.drop(columns="_text").assign(prev_hash=before, entry_hash=after)

    rows = events.withColumn("_text", canonical_column())
    return rows.repartition("corpus_id").sortWithinPartitions("corpus_id", *ORDER).mapInPandas(chain, schema)


def _bucket() -> Column:
    return F.floor(F.col("recorded_seq") / BUCKET)


def _offsets(log: DataFrame) -> DataFrame:
    """Per corpus and bucket of sequence numbers, how many entries come before it: corpus_id, bucket, entries, before."""
    sizes = log.groupBy("corpus_id", _bucket().alias("bucket")).agg(F.count("*").alias("entries"))
    earlier = Window.partitionBy("corpus_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    return sizes.withColumn("before", F.coalesce(F.sum("entries").over(earlier), F.lit(0)))


def verify_chain(log: DataFrame) -> DataFrame:
    """Per corpus: entries, intact, broken_at (position from 0 of the first inconsistency).

    An entry is good if it hashes to its own hash and names the hash before it. Logs are cut into buckets of sequence
    numbers; inside a bucket entries see their predecessor, and only each bucket's ends meet those of its neighbours.
    """
    order = Window.partitionBy("corpus_id", "bucket").orderBy(*ORDER)
    rows = log.select("corpus_id", *ORDER, "prev_hash", "entry_hash", canonical_column().alias("text"), _bucket().alias("bucket"))
    own = F.sha2(F.concat("text", "prev_hash"), 256) == F.col("entry_hash")
    rows = rows.select("corpus_id", "bucket", *ORDER, "prev_hash", "entry_hash", own.alias("own"))
    before = F.lag("entry_hash").over(order)
    rows = rows.withColumns({"place": F.row_number().over(order) - 1, "good": F.coalesce(F.col("own") & (before.isNull() | (F.col("prev_hash") == before)), F.lit(False))})
    ends = rows.groupBy("corpus_id", "bucket").agg(
        F.count("*").alias("entries"),
        F.min(F.when(~F.col("good"), F.col("place"))).alias("bad"),
        F.min_by("prev_hash", "place").alias("first"),
        F.max_by("entry_hash", "place").alias("last"),
    )
    along = Window.partitionBy("corpus_id").orderBy("bucket")
    joined = F.coalesce(F.col("first") == F.coalesce(F.lag("last").over(along), F.lit("")), F.lit(False))
    ends = ends.withColumns({"joined": joined, "offset": F.sum("entries").over(along) - F.col("entries")})
    bad = F.col("offset") + F.when(~F.col("joined"), 0).otherwise(F.col("bad"))
    return ends.groupBy("corpus_id").agg(F.sum("entries").alias("entries"), F.max(bad).isNull().alias("intact"), F.min(bad).alias("broken_at"))


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over leaves with separate domains for leaves and nodes; an odd node moves up; nothing has 32 zero bytes."""
    if not leaves:
        return bytes(32)
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _halved(nodes: Column) -> Column:
    """One level up: pairs of hashes (hex) become one, an odd one stays."""
    pair = lambda j: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.get(nodes, 2 * j)), F.unhex(F.get(nodes, 2 * j + 1))), 256)
    up = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda j: F.when(2 * j + 1 < F.size(nodes), pair(j)).otherwise(F.get(nodes, 2 * j)))
    return F.when(F.size(nodes) <= 1, nodes).otherwise(up)


def merkle_roots(log: DataFrame) -> DataFrame:
    """Per corpus the Merkle root (hex) of its entry hashes in order.

    ``FAN`` neighbours at a time become their subtree's root, so a log of n entries takes log n / log FAN shuffles; each
    such level is written, and no task holds more than a bucket of leaves or ``FAN`` nodes.
    """
    inside = Window.partitionBy("corpus_id", "bucket").orderBy(*ORDER)
    rows = log.select("corpus_id", *ORDER, _bucket().alias("bucket"), F.sha2(F.concat(F.unhex(F.lit("00")), F.col("entry_hash").cast("binary")), 256).alias("h"))
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    level = rows.join(_offsets(log), ["corpus_id", "bucket"]).select("corpus_id", (F.col("before") + F.col("place")).alias("i"), "h")
    while True:
        groups = level.groupBy("corpus_id", F.floor(F.col("i") / FAN).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("nodes"))
        for _ in range(FAN.bit_length() - 1):
            groups = groups.withColumn("nodes", _halved(F.col("nodes")))
        level = settled(groups.select("corpus_id", "i", F.get("nodes", F.lit(0)).alias("h")), "merkle")
        if (level.agg(F.max("i")).first()[0] or 0) == 0:
            return level.select("corpus_id", F.col("h").alias("root"))


@dataclass
class AuditReport:
    corpus_id: str
    intact: bool
    entries: int
    root: str
    signature: str | None
    tamper_evident: bool


def audit_report(log: DataFrame, signer=None, anchor_class: str = "none") -> list[AuditReport]:
    """Integrity, root and (by an injected signer) signature of each corpus; only an external immutable anchor makes it evident."""
    rows = verify_chain(log).join(merkle_roots(log), "corpus_id").orderBy("corpus_id").collect()
    return [
        AuditReport(r.corpus_id, r.intact, r.entries, r.root, signer(bytes.fromhex(r.root)).hex() if signer else None, anchor_class == "external-immutable" and r.intact)
        for r in rows
    ]
