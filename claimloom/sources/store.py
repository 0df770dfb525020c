"""Claims kept as Parquet, partitioned by corpus: append-only rows and status changes, folded on reading.

A batch may append to several tables; its rows carry the number of its transaction, and readers see them once that number
stands in the table of commits, so that a batch is there as a whole or not at all. A bound corpus prunes partitions. A
read plan filters the current view, since a later row or a status change decides what an id looks like now; where only a
subject or keys are asked for, the ids that ever had those are found first, and only their rows are folded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chain import EVENT_FIELDS
from ..operators.writing import with_status
from ..schema import CLAIM_COLUMNS, ddl

#: Table -> its columns.
TABLES = {
    "claims": CLAIM_COLUMNS,
    "events": {f: "bigint" if f.startswith("recorded") else "string" for f in EVENT_FIELDS} | {"prev_hash": "string", "entry_hash": "string"},
    "anchors": {"corpus_id": "string", "epoch": "bigint", "root": "string", "signature": "string", "anchored": "bigint"},
    "idempotency": {"corpus_id": "string", "writer": "string", "key": "string", "idempotency_key": "string", "claim_id": "string", "created": "bigint"},
    "status": {"corpus_id": "string", "id": "string", "to": "string", "at": "bigint"},
    "catalog": {"corpus_id": "string", "definition": "string", "at": "bigint", "deleted": "boolean"},
}


#: The column that names a row's transaction, and its value for appends outside of one.
MARK, ALONE = "commit_id", "alone"


class UnknownCorpus(KeyError):
    """No corpus of that id."""


class ClaimStore:
    """Tables under one path; with ``corpus_id`` bound, every read and write is of that corpus alone."""

    def __init__(self, spark: SparkSession, path: str, corpus_id: str | None = None, tenant: str | None = None, transaction: str | None = None):
        self.spark, self.root, self.bound, self.transaction = spark, path.rstrip("/"), corpus_id, transaction
        self.path = f"{self.root}/tenant={tenant}" if tenant else self.root
        self.tenant = tenant

    def scoped(self, corpus_id: str) -> "ClaimStore":
        return ClaimStore(self.spark, self.root, corpus_id, self.tenant)

    def _there(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _read(self, table: str) -> DataFrame:
        """A table's rows, without those of transactions that have not ended."""
        schema = ddl(TABLES[table])
        if not self._there(table):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(f"{schema}, {MARK} string").parquet(f"{self.path}/{table}")
        df = df.where(F.col("corpus_id") == self.bound) if self.bound else df
        done = self.spark.createDataFrame([(ALONE,)], f"{MARK} string")
        if self._there("commits"):
            done = done.unionByName(self.spark.read.schema(f"{MARK} string").parquet(f"{self.path}/commits"))
        return df.join(done, MARK, "left_semi").select(*TABLES[table])

    def _append(self, table: str, df: DataFrame) -> None:
        rows = df.select(*(F.col(c).cast(t).alias(c) for c, t in TABLES[table].items()))
        if self.bound:
            rows = rows.withColumn("corpus_id", F.lit(self.bound))
        rows = rows.withColumn(MARK, F.lit(self.transaction or ALONE))
        rows.write.mode("append").partitionBy("corpus_id").parquet(f"{self.path}/{table}")

    @contextmanager
    def transact(self) -> Iterator["ClaimStore"]:
        """A store whose appends all become visible when the block ends well, and never if it fails."""
        number = uuid.uuid4().hex
        yield ClaimStore(self.spark, self.root, self.bound, self.tenant, number)
        self.spark.createDataFrame([(number,)], f"{MARK} string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def insert(self, claims: DataFrame) -> None:
        """Append claims; a later row of an id replaces the earlier one on reading."""
        self._append("claims", claims)

    def set_status(self, changes: DataFrame, at: int) -> None:
        """Append status changes: rows (corpus_id, id, to)."""
        self._append("status", changes.withColumn("at", F.lit(at)))

    def append_events(self, events: DataFrame) -> None:
        self._append("events", events)

    def put_idempotency(self, records: DataFrame) -> None:
        self._append("idempotency", records)

    def put_anchor(self, anchors: DataFrame) -> None:
        self._append("anchors", anchors)

    def claims(self, plan: Column | None = None, narrow: Column | None = None) -> DataFrame:
        """The current view: the last row of each id with its status changes, filtered by ``plan``.

        ``narrow``: a condition that some row of every id in the result meets; only ids with such rows are folded.
        """
        rows = self._read("claims")
        if narrow is not None:
            rows = rows.join(rows.where(narrow).select("corpus_id", "id").distinct(), ["corpus_id", "id"], "left_semi")
        last = F.row_number().over(Window.partitionBy("corpus_id", "id").orderBy(F.desc("recorded_seq"), F.desc("recorded")))
        rows = rows.withColumn("_r", last).where("_r = 1").drop("_r")
        rows = with_status(rows, self._read("status").select("id", "to")).select(*CLAIM_COLUMNS)
        return rows if plan is None else rows.where(plan)

    def events(self, claim_id: str | None = None, since: int | None = None) -> DataFrame:
        rows = self._read("events")
        rows = rows.where(F.col("claim_id") == claim_id) if claim_id else rows
        rows = rows.where(F.col("recorded_seq") > since) if since is not None else rows
        return rows.orderBy("corpus_id", "recorded_seq")

    def anchors(self, epoch: int | None = None, since: int | None = None) -> DataFrame:
        rows = self._read("anchors")
        rows = rows.where(F.col("epoch") == epoch) if epoch is not None else rows
        return rows.where(F.col("epoch") >= since) if since is not None else rows

    def idempotency(self) -> DataFrame:
        return self._read("idempotency")

    def max_seq(self) -> int:
        return self._read("claims").agg(F.max("recorded_seq")).first()[0] or 0

    # the catalog

    def put_corpus(self, corpus_id: str, definition: dict, at: int, deleted: bool = False) -> None:
        row = self.spark.createDataFrame([(corpus_id, json.dumps(definition, sort_keys=True), at, deleted)], ddl(TABLES["catalog"]))
        row.withColumn(MARK, F.lit(ALONE)).write.mode("append").parquet(f"{self.path}/catalog")

    def corpora(self) -> dict[str, dict]:
        rows = ClaimStore(self.spark, self.root, None, self.tenant)._read("catalog")
        last = rows.groupBy("corpus_id").agg(F.max_by(F.struct("definition", "deleted"), "at").alias("x")).collect()
        return {r.corpus_id: json.loads(r.x.definition) for r in sorted(last) if not r.x.deleted}

    def corpus(self, corpus_id: str) -> dict:
        found = self.corpora()
        if corpus_id not in found:
            raise UnknownCorpus(corpus_id)
        return found[corpus_id]


def narrowing(subject=None, key=None, keys=None, scope_hash=None, run_ids=None, **_) -> Column | None:
    """The part of a read plan that an id's rows meet or not as they were written, for ``claims(narrow=...)``."""
    return query_plan(subject, key, keys, scope_hash, run_ids=run_ids)


def query_plan(subject=None, key=None, keys=None, scope_hash=None, recorded_at_most=None, statuses=None, run_ids=None) -> Column | None:
    """A conjunctive read plan; empty lists are no condition."""
    parts = []
    if subject is not None:
        parts.append(F.col("subject") == subject)
    if key is not None:
        parts.append(F.col("key") == key)
    if keys:
        parts.append(F.col("key").isin(list(keys)))
    if scope_hash is not None:
        parts.append(F.col("scope_hash") == scope_hash)
    if recorded_at_most is not None:
        parts.append(F.col("recorded") <= recorded_at_most)
    if statuses:
        parts.append(F.col("status").isin(list(statuses)))
    if run_ids:
        parts.append(F.col("run_id").isin(list(run_ids)))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out
