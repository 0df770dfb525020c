"""The write path over batches: contradiction policies, idempotency, supersede and promote.

Claims are append-only; a status change is a row (id, status) that the current view folds in. Within one (subject,
key, scope) later items see what earlier ones did, so a batch is folded in order: rows are dealt by that triple, sorted,
and each task streams through its triples with one triple's live values in memory.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import point
from ..schema import CLAIM_COLUMNS, STATUSES, TRIPLE, as_claims

POLICIES = ("always_accept", "reject_on_contradiction", "accept_but_mark", "accept_and_resolve")
RULES = ("deprecate_lower", "keep_newer")
WINDOW_MS = 86_400_000
_DECISION = "id string, outcome string, conflict_id string, deprecated_id string"


def decide(policy: str, rule: str = "deprecate_lower"):
    """A fold over rows sorted by triple, existing claims first, then the batch in order."""
    if policy not in POLICIES or rule not in RULES:
        raise ValueError(f"unknown policy {policy!r} or rule {rule!r}")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, live = None, Live()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (triple := (row.subject, row.key, row.scope_hash)) != key:
                    key, live = triple, Live(policy == "accept_and_resolve" and rule == "deprecate_lower")
                conflict, other = live.first_other(row.value_hash) if row.candidate else (None, 0.0)
                outcome, gone = "committed", None
                if conflict is not None:
                    if policy == "reject_on_contradiction" and other >= row.point:
                        outcome = "rejected"
                    elif live.all and row.point > other:
                        gone = conflict
                        live.drop_other(row.value_hash)
                if outcome == "committed" and row.status == "validated":
                    live.add(row.value_hash, row.id, row.point)
                if row.candidate:
                    out.append((row.id, outcome, conflict, gone))
            yield pd.DataFrame(out, columns=["id", "outcome", "conflict_id", "deprecated_id"])

    return fold


class Live:
    """A triple's live claims in order. The first one of another value is found without a scan.

    Only that one can conflict, so the first claims of two values are enough unless claims can be deprecated (``all``):
    then each value has its queue, and a heap holds the queues' heads.
    """

    def __init__(self, all_: bool = False):
        self.all, self.queues, self.heads, self.n = all_, {}, [], 0

    def add(self, value: str, id_: str, point: float) -> None:
        queue = self.queues.get(value)
        if queue is None:
            if not self.all and len(self.queues) == 2:
                return
            queue = self.queues[value] = deque()
        if self.all or not queue:
            if not queue:
                heapq.heappush(self.heads, (self.n, value))
            queue.append((self.n, id_, point))
        self.n += 1

    def _head(self, value: str) -> tuple[int, str] | None:
        """The heap's entry of the first claim whose value is another one."""
        if not self.heads:
            return None
        if self.heads[0][1] != value:
            return self.heads[0]
        return min(self.heads[1:3], default=None)  # a value has one head, so the next one is a child of the top

    def first_other(self, value: str) -> tuple[str | None, float]:
        head = self._head(value)
        return self.queues[head[1]][0][1:] if head else (None, 0.0)

    def drop_other(self, value: str) -> None:
        top = heapq.heappop(self.heads)
        if top[1] == value:
            other = heapq.heappop(self.heads)
            heapq.heappush(self.heads, top)
        else:
            other = top
        queue = self.queues[other[1]]
        queue.popleft()
        if queue:
            heapq.heappush(self.heads, (queue[0][0], other[1]))


def decisions(batch: DataFrame, existing: DataFrame | None, policy: str, rule: str = "deprecate_lower") -> DataFrame:
    """Per item of the batch (ordered by ``recorded_seq``): id, outcome, conflict_id, deprecated_id."""
    if policy == "always_accept":
        return batch.select("id", F.lit("committed").alias("outcome"), F.lit(None).cast("string").alias("conflict_id"), F.lit(None).cast("string").alias("deprecated_id"))
    columns = [*TRIPLE, "id", "value_hash", "status", point().alias("point"), "recorded_seq"]
    rows = batch.select(*columns, F.lit(True).alias("candidate"))
    if existing is not None:
        triples = batch.select(*TRIPLE).distinct()
        rows = existing.where("status = 'validated'").join(triples, list(TRIPLE), "left_semi").select(*columns, F.lit(False).alias("candidate")).unionByName(rows)
    return rows.repartition(*TRIPLE).sortWithinPartitions(*TRIPLE, "candidate", "recorded_seq", "id").mapInPandas(decide(policy, rule), _DECISION)


def idempotent(batch: DataFrame, records: DataFrame | None, now: int) -> DataFrame:
    """Adds duplicate_of to items whose (corpus_id, writer, key, idempotency_key) was used within the window before.

    ``records``: rows (corpus_id, writer, key, idempotency_key, claim_id, created). Inside the batch the first wins.
    """
    scope = ["corpus_id", "writer", "key", "idempotency_key"]
    first = F.first("id").over(Window.partitionBy(*scope).orderBy("recorded_seq", "id"))
    out = batch.withColumn("_first", F.when(F.col("idempotency_key").isNotNull(), first))
    prior = F.lit(None).cast("string")
    if records is not None:
        fresh = records.where(F.lit(now) - F.col("created") < WINDOW_MS).groupBy(*scope).agg(F.max_by("claim_id", "created").alias("_prior"))
        out, prior = out.join(fresh, scope, "left"), F.col("_prior")
    return out.withColumn("duplicate_of", F.coalesce(prior, F.when(F.col("_first") != F.col("id"), F.col("_first")))).drop("_first", "_prior")


def commit_batch(batch: DataFrame, existing: DataFrame | None, policy: str, rule: str = "deprecate_lower", records: DataFrame | None = None, now: int = 0) -> DataFrame:
    """Per item: id, outcome (committed, rejected or duplicate), conflict_id, deprecated_id, duplicate_of.

    The policy is asked before the idempotency check, as a retry's outcome depends on the ledger it meets.
    """
    told = decisions(batch, existing, policy, rule)
    if "idempotency_key" not in batch.columns:
        return told.withColumn("duplicate_of", F.lit(None).cast("string"))
    seen = idempotent(batch, records, now).select("id", "duplicate_of")
    outcome = F.when((F.col("outcome") == "committed") & F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("outcome"))
    return told.join(seen, "id").withColumn("outcome", outcome)


def marks(batch: DataFrame, told: DataFrame, now: int) -> DataFrame:
    """For accepted items with a conflict, a claim that records the pair."""
    pairs = told.where("outcome = 'committed' and conflict_id is not null")
    body = pairs.join(batch.select("id", "recorded_seq"), "id").select(
        F.concat(F.lit("mark-"), F.substring(F.sha2(F.concat_ws("|", "id", "conflict_id"), 256), 1, 24)).alias("id"), F.lit("contradiction").alias("subject"),
        F.lit("contradiction.mark").alias("key"), F.to_json(F.struct(F.col("conflict_id").alias("existing"), F.col("id").alias("new"))).alias("value_json"),
        F.lit("scalar").alias("dist"), F.lit(1.0).alias("p"), F.lit(now).alias("valid_from"), F.lit(now).alias("recorded"), "recorded_seq", F.lit("candidate").alias("status"),
    )
    return as_claims(body)


def apply_commit(batch: DataFrame, existing: DataFrame | None, told: DataFrame, policy: str, now: int = 0) -> DataFrame:
    """The ledger after the batch: existing claims, accepted items and marks, with deprecations folded in."""
    accepted = batch.join(told.where("outcome = 'committed'").select("id"), "id", "left_semi").select(*CLAIM_COLUMNS)
    out = accepted if existing is None else existing.select(*CLAIM_COLUMNS).unionByName(accepted)
    gone = told.where("deprecated_id is not null").select(F.col("deprecated_id").alias("id"), F.lit("deprecated").alias("to"))
    out = with_status(out, gone)
    return out.unionByName(marks(batch, told, now).select(*CLAIM_COLUMNS)) if policy == "accept_but_mark" else out


def with_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold status changes (id, to) into claims; the last one by status rank holds."""
    ranks = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("to"))
    last = changes.groupBy("id").agg(F.max_by("to", ranks).alias("to"))
    return claims.join(last, "id", "left").withColumn("status", F.coalesce("to", "status")).drop("to").select(*claims.columns)


def promote(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (id, to): outcome promoted, invalid_transition or not_found. Only upwards, or from any status to deprecated."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATUSES)), F.col(c))
    known = F.coalesce(rank("to"), F.lit(0)) > 0
    legal = known & ((F.col("to") == "deprecated") | (rank("to") > rank("status")))
    return requests.join(claims.select("id", "status"), "id", "left").select(
        "id", "to", F.when(F.col("status").isNull(), "not_found").when(legal, "promoted").otherwise("invalid_transition").alias("outcome")
    )


def supersede(claims: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replacement claims with the column ``supersedes`` are appended; what they supersede is deprecated where it is there."""
    gone = replacements.where("supersedes is not null").select(F.col("supersedes").alias("id"), F.lit("deprecated").alias("to"))
    return with_status(claims, gone).unionByName(replacements.select(*claims.columns))
