"""The facade: corpora in a store, written in batches under a policy and read through expressions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chain, ranking, writing
from .operators.contradiction import check_cardinality
from .operators.graph import settled
from .operators.staging import Staging
from .plans import ast, census, derive, dsl, read
from .schema import CLAIM_COLUMNS, as_claims, cite
from .sources.store import ClaimStore, UnknownCorpus, narrowing, query_plan

#: Scope fields of a corpus that ``remember`` makes.
REMEMBER_SCOPE = ("project", "person", "context")
TIERS = ("claims", "events", "idempotency", "audit")


class UnavailableTiers(ValueError):
    """A corpus needs storage tiers that are not there."""


class UndeclaredScope(ValueError):
    """A claim has a scope field that its corpus does not declare."""


class Engine:
    """One store; the clock is injected, in milliseconds."""

    def __init__(self, store: ClaimStore, clock: Callable[[], int] = lambda: int(time.time() * 1000), log_path: str | None = None):
        self.log_path = log_path
        self.store, self.clock, self.staging = store, clock, Staging()

    # corpora

    def create_corpus(self, corpus_id: str, *, scope_fields=(), policy="always_accept", rule="deprecate_lower", threshold=0.5, cardinality=None, tiers=("claims",), **more) -> dict:
        missing = sorted(set(tiers) - set(TIERS))
        if missing:
            raise UnavailableTiers(", ".join(missing))
        definition = {"scope_fields": list(scope_fields), "policy": policy, "rule": rule, "threshold": threshold, "cardinality": check_cardinality(cardinality), "tiers": list(tiers)} | more
        self.store.put_corpus(corpus_id, definition, self.clock())
        return definition

    def delete_corpus(self, corpus_id: str) -> None:
        self.store.put_corpus(corpus_id, self.store.corpus(corpus_id), self.clock(), deleted=True)

    def list_corpora(self) -> list[str]:
        return list(self.store.corpora())

    def declare_cardinality(self, corpus_id: str, cardinality: dict[str, str]) -> None:
        definition = self.store.corpus(corpus_id)
        definition["cardinality"] = definition["cardinality"] | check_cardinality(cardinality)
        self.store.put_corpus(corpus_id, definition, self.clock())

    def claims(self, corpus_id: str, **plan) -> DataFrame:
        self.store.corpus(corpus_id)
        return self.store.scoped(corpus_id).claims(query_plan(**plan), narrowing(**plan))

    def inspect_corpus(self, corpus_id: str) -> dict:
        """Its definition with what it holds: claims by status and the last sequence number."""
        rows = self.claims(corpus_id)
        counts = {r.status: r.n for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
        return self.store.corpus(corpus_id) | {"claims": counts, "recorded_seq": self.store.scoped(corpus_id).max_seq()}

    def read_by_ids(self, corpus_id: str, ids: list[str]) -> DataFrame:
        return read.read_by_ids(self.claims(corpus_id), ids)

    # writing

    def commit_batch(self, corpus_id: str, batch: DataFrame, writer: str = "engine") -> DataFrame:
        """Write a batch under the corpus's policy; returns per item its outcome. One append per table."""
        definition, store, now = self.store.corpus(corpus_id), self.store.scoped(corpus_id), self.clock()
        declared = definition["scope_fields"]
        strange = batch.where(F.size(F.array_except(F.map_keys("scope"), F.array(*map(F.lit, declared)).cast("array<string>"))) > 0).limit(1).count()
        if strange:
            raise UndeclaredScope(f"declared are {declared}")
        base = store.max_seq()
        rows = batch.withColumn("corpus_id", F.lit(corpus_id)).withColumn("writer", F.lit(writer)).withColumn("recorded", F.lit(now)).withColumn("recorded_seq", F.col("recorded_seq") + base + 1)
        rows = rows.withColumn("ord", F.struct(F.lit(0).alias("stage"), F.col("recorded_seq").alias("seq"), F.col("id").alias("tie")))
        # written, not cached: what follows changes the tables that the decisions were read from
        rows = settled(rows, "batch")
        told = settled(writing.commit_batch(rows, store.claims(), definition["policy"], definition["rule"], store.idempotency(), now), "told")
        accepted = rows.join(told.where("outcome = 'committed'").select("id"), "id", "left_semi")
        last = store.events().orderBy(*map(F.desc, chain.ORDER)).limit(1).collect() if "audit" in definition["tiers"] else []
        with store.transact() as whole:
            whole.insert(accepted.select(*CLAIM_COLUMNS))
            gone = told.where("deprecated_id is not null").select(F.lit(corpus_id).alias("corpus_id"), F.col("deprecated_id").alias("id"), F.lit("deprecated").alias("to"))
            whole.set_status(gone, now)
            if definition["policy"] == "accept_but_mark":
                whole.insert(writing.marks(rows, told, now))
            if "idempotency_key" in batch.columns:
                whole.put_idempotency(accepted.where("idempotency_key is not null").select("corpus_id", "writer", "key", "idempotency_key", F.col("id").alias("claim_id"), F.lit(now).alias("created")))
            if "audit" in definition["tiers"]:
                events = accepted.select(F.lit("commit").alias("op"), "corpus_id", "writer", F.col("id").alias("claim_id"), *(F.lit(None).cast("string").alias(c) for c in ("deprecated_id", "to_status", "reason")), "recorded", "recorded_seq")
                whole.append_events(chain.build_chain(events, {corpus_id: last[0].entry_hash} if last else None))
        return told

    def promote(self, corpus_id: str, requests: DataFrame) -> DataFrame:
        told = settled(writing.promote(self.claims(corpus_id), requests), "told")
        changes = told.where("outcome = 'promoted'").select(F.lit(corpus_id).alias("corpus_id"), "id", "to")
        self.store.scoped(corpus_id).set_status(changes, self.clock())
        return told

    def supersede(self, corpus_id: str, old: str, replacement: DataFrame) -> DataFrame:
        """Write a replacement and deprecate what it replaces, where that is there."""
        told = self.commit_batch(corpus_id, replacement, "supersede")
        gone = self.claims(corpus_id).where(F.col("id") == old).select(F.lit(corpus_id).alias("corpus_id"), "id", F.lit("deprecated").alias("to"))
        self.store.scoped(corpus_id).set_status(settled(gone, "gone"), self.clock())
        return told

    def promote_staged(self, corpus_id: str, name: str) -> DataFrame:
        return self.commit_batch(corpus_id, self.staging.take(name), "staging")

    def commit_derived(self, expression: ast.Node, writer: str = "derive") -> tuple[DataFrame, derive.Derivation]:
        """Derive a claim and write it, with its inputs as evidence; the provenance replays it."""
        row, made = self.derive(expression)
        if made.inputs_table:  # too many to cite one by one
            by = lambda f, c: F.lit({"kind": "table", "method": "derive", "uri": made.inputs_table}.get(f)).cast(c).alias(f)
            refs = F.array(F.struct(*(by(f.name, f.dataType) for f in row.schema["evidence"].dataType.elementType.fields)))
            row = row.withColumn("evidence", refs)
        else:
            pairs = F.from_json(F.lit(json.dumps([{"i": i, "h": h} for i, h in zip(made.inputs, made.input_hashes)])), "array<struct<i:string,h:string>>")
            row = row.withColumn("evidence", F.transform(pairs, lambda x: cite(x["i"], F.lit("derive"), x["h"])))
        return self.commit_batch(made.corpus, row.withColumn("recorded_seq", F.lit(0).cast("bigint")), writer), made

    def remember(self, corpus_id: str, claims: DataFrame, writer: str = "remember", policy: str = "always_accept") -> DataFrame:
        """Write claims, making the corpus where there is none, and tell what each did: id, outcome, action, merged_into, deprecated_ids.

        A claim without a validity start is valid from now, so that the last word holds.
        """
        if corpus_id not in self.store.corpora():
            self.create_corpus(corpus_id, policy=policy, scope_fields=REMEMBER_SCOPE)
        now = self.clock()
        rows = as_claims(claims.withColumn("valid_from", F.coalesce("valid_from", F.lit(now)) if "valid_from" in claims.columns else F.lit(now)), corpus_id)
        told = self.commit_batch(corpus_id, rows, writer).select("id", "outcome")
        ledger = self.claims(corpus_id)
        written = ledger.join(told.where("outcome = 'committed'").select("id"), "id", "left_semi")
        did = read.attribution(written, ledger, now, read.alias_map(ledger, now).map, self.store.corpus(corpus_id)["cardinality"])
        return told.join(did, "id", "left")

    # reading

    def query(self, expression: ast.Node) -> DataFrame:
        rows = ast.compile(expression, self.claims, lambda corpus, hints: self.claims(corpus, **hints))
        return ranking.ranked(rows) if {"score", "ord"} <= set(rows.columns) else rows

    def q(self, corpus_id: str, text: str) -> DataFrame:
        return self.query(dsl.parse(corpus_id, dsl.normalize(text), self.clock()))

    def derive(self, expression: ast.Node) -> tuple[DataFrame, derive.Derivation]:
        now = self.clock()
        leaf = expression
        while leaf.source:
            leaf = leaf.source
        corpus_id = leaf.args["corpus"]
        definition = self.store.corpus(corpus_id)
        aliases = read.alias_map(self.claims(corpus_id), now).map if derive.resolves(expression) else None
        return derive.derive(derive.stamp(expression, definition["threshold"], now, aliases, definition["cardinality"]), self.claims, now)

    def replay(self, derivation: derive.Derivation) -> str:
        return derive.replay(derivation, self.claims)

    def recall(self, corpus_id: str, query: str, **options) -> read.Recall | None:
        """None for an unknown corpus: recalling creates nothing."""
        try:
            cardinality = self.store.corpus(corpus_id)["cardinality"]
        except UnknownCorpus:
            return None
        as_of = read.parse_as_of(options.pop("as_of", None))
        out = read.recall(self.claims(corpus_id), query, self.clock() if as_of is None else as_of, cardinality=options.pop("cardinality", cardinality), **options)
        if self.log_path:
            self.store.spark.createDataFrame([(self.clock(), corpus_id, query, out.top_score, out.abstained)], "at bigint, corpus_id string, query string, top_score double, abstained boolean").write.mode("append").json(self.log_path)
        return out

    def explain(self, corpus_id: str, query: str, **options) -> DataFrame:
        return read.explain(self.claims(corpus_id), query, self.clock(), cardinality=self.store.corpus(corpus_id)["cardinality"], **options)

    def history(self, corpus_id: str, subject: str, key: str | None = None) -> DataFrame:
        rows = self.claims(corpus_id)
        return read.lineage(rows, subject, read.alias_map(rows, self.clock()).family(key) if key else None)

    def audit(self, corpus_id: str) -> DataFrame:
        rows, now = self.claims(corpus_id), self.clock()
        return census.audit(rows, now, self.store.corpus(corpus_id)["cardinality"], corpus=corpus_id, aliases=read.alias_map(rows, now).map)

    def verify(self, corpus_id: str) -> DataFrame:
        return chain.verify_chain(self.store.scoped(corpus_id).events())
