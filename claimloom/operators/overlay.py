"""The learning overlay: signals reinforce claims, restatements fold, confident claims rise, insights are admitted."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import lower_bound, source_weight
from ..schema import STATUSES, cite

USAGE_WEIGHT, OUTCOME_WEIGHT, SCALAR_PSEUDOCOUNT = 0.5, 2.0, 2.0
FOLD_AT, BOUND_K = 3, 1.645
TIERS = {"provisional": 0.5, "validated": 0.65}
DREAM, SUMMARY = "dream", "summary"
DREAM_PRIOR = SUMMARY_PRIOR = (1.0, 3.0)
DREAM_DEPTH, DREAM_LIMIT = 3, 200
KEY_GRAMMAR = re.compile(r"[a-z0-9-]+(\.[a-z0-9-]+)+")


def evidence_update(claims: DataFrame, usage: DataFrame, surfaced: DataFrame, outcomes: DataFrame, usage_weight=USAGE_WEIGHT, outcome_weight=OUTCOME_WEIGHT, pseudocount=SCALAR_PSEUDOCOUNT) -> DataFrame:
    """One replacement per affected claim: id, d_alpha, d_beta, alpha, beta.

    ``usage`` and ``surfaced``: rows (episode, claim_id); ``outcomes``: rows (episode, result, weight). Each use counts;
    an outcome counts once for each claim that its episode surfaced. Scalars become a Beta of the same mean.
    """
    used = usage.groupBy("claim_id").agg((F.count("*") * usage_weight).alias("a")).withColumn("b", F.lit(0.0))
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) * outcome_weight
    totals = outcomes.groupBy("episode").agg(F.sum(F.when(F.col("result") == "success", weight).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("result") != "success", weight).otherwise(0.0)).alias("b"))
    credited = surfaced.select("episode", "claim_id").distinct().join(totals, "episode").groupBy("claim_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    delta = used.unionByName(credited).groupBy("claim_id").agg(F.sum("a").alias("d_alpha"), F.sum("b").alias("d_beta"))
    rows = claims.join(delta, F.col("id") == F.col("claim_id"))
    is_beta = F.col("dist") == "beta"
    return rows.select(
        "id",
        "d_alpha",
        "d_beta",
        (F.when(is_beta, F.col("alpha")).otherwise(F.col("p") * pseudocount) + F.col("d_alpha")).alias("alpha"),
        (F.when(is_beta, F.col("beta")).otherwise((1 - F.col("p")) * pseudocount) + F.col("d_beta")).alias("beta"),
    )


def bound(k: float = BOUND_K) -> Column:
    return F.when(F.col("dist") == "beta", lower_bound(F.col("alpha"), F.col("beta"), k)).otherwise(F.col("p"))


def tier(bound_: Column, tiers: dict[str, float] = TIERS) -> Column:
    return F.when(bound_ >= tiers["validated"], "validated").when(bound_ >= tiers["provisional"], "provisional").otherwise("candidate")


def plan_consolidation(claims: DataFrame, fold_at: int = FOLD_AT, k: float = BOUND_K) -> DataFrame:
    """Operations: op (derive, promote), target (an id), to, alpha, beta, members.

    Groups of equal values and distributions with ``fold_at`` members (two at least) fold into one derived claim by
    weighted average, and their members are deprecated; other claims rise to the tier of their lower bound.
    """
    active = claims.where("status <> 'deprecated'")
    group = ["subject", "key", "scope_hash", "value_hash", "dist"]
    w = source_weight(F.col("source"))
    sizes = active.groupBy(*group).agg(
        F.count("*").alias("members"),
        F.min_by("id", "ord").alias("first"),
        *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"g_{c}") for c in ("alpha", "beta", "p")),
    )
    fold = sizes.where(F.col("members") >= max(2, fold_at)).where(F.coalesce(F.col("g_alpha") + F.col("g_beta"), F.col("g_p")).isNotNull())
    folded = fold.select(*group, "first", "members", F.col("g_alpha").alias("alpha"), F.col("g_beta").alias("beta"), F.col("g_p").alias("p"))
    derived = folded.select(F.lit("derive").alias("op"), F.col("first").alias("target"), tier(bound(k)).alias("to"), "alpha", "beta", "members")
    none = F.lit(None).cast("double")
    gone = active.join(fold.select(*group), group, "left_semi").select(F.lit("promote").alias("op"), F.col("id").alias("target"), F.lit("deprecated").alias("to"), none.alias("alpha"), none.alias("beta"), F.lit(1).cast("bigint").alias("members"))
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATUSES)), c)
    rest = active.join(fold.select(*group), group, "left_anti").withColumn("to", tier(bound(k))).where(rank(F.col("to")) > rank(F.col("status")))
    risen = rest.select(F.lit("promote").alias("op"), F.col("id").alias("target"), "to", none.alias("alpha"), none.alias("beta"), F.lit(1).cast("bigint").alias("members"))
    return derived.unionByName(gone).unionByName(risen)


def dream_depth(tags: Column) -> Column:
    """The number in the first tag ``dream-depth:N``; 0 without one, ``DREAM_DEPTH`` where it is no number."""
    tag = F.get(F.filter(tags, lambda t: t.startswith("dream-depth:")), F.lit(0))
    text = F.trim(F.substring(tag, len("dream-depth:") + 1, 1 << 20))
    return F.when(tag.isNull(), 0.0).when(text == "", 0.0).otherwise(F.coalesce(F.nanvl(text.try_cast("double"), F.lit(None).cast("double")), F.lit(float(DREAM_DEPTH))))


def select_dreams(claims: DataFrame, run_ids: DataFrame | None = None, limit: int = DREAM_LIMIT, depth: int = DREAM_DEPTH) -> DataFrame:
    """What a dream pass reads of an episode's runs: no unvalidated dreams, nothing dreamt too deep; newest, then most confident first.

    ``run_ids``: the episode's runs as rows (run_id); None reads all.
    """
    unvalidated = F.coalesce((F.col("workflow") == DREAM) & (F.col("status") == "candidate"), F.lit(False))
    rows = claims.where(~unvalidated).where(dream_depth(F.col("tags")) < depth)
    if run_ids is not None:
        rows = rows.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")
    return rows.orderBy(F.desc("recorded"), F.desc(F.coalesce("raw", F.lit(0.0))), "ord").limit(limit)


def _cited(proposals: DataFrame, selection: DataFrame) -> DataFrame:
    """Proposals (id, key, cites array) with what their citations say: reason (null if all is well), first cited claim, depth."""
    known = selection.select(F.col("id").alias("c"), dream_depth(F.col("tags")).alias("depth"), F.lit(1).alias("known"), "valid_from", "valid_to")
    cited = proposals.select("id", F.posexplode("cites").alias("at", "c")).join(known, "c", "left")
    told = cited.groupBy("id").agg(
        F.count("*").alias("_cited"), F.count("known").alias("_known"), F.max("depth").alias("_depth"), F.min_by("valid_from", "at").alias("_from"), F.min_by("valid_to", "at").alias("_to")
    )
    ok = (F.coalesce(F.col("_cited"), F.lit(0)) > 0) & (F.col("_cited") == F.col("_known"))
    well_formed = F.coalesce(F.col("key").rlike(f"^{KEY_GRAMMAR.pattern}$"), F.lit(False))
    reason = F.when(~ok, "cites not in selected set").when(~well_formed, "invalid key")
    return proposals.join(told, "id", "left").withColumn("reason", reason)


def admit_insights(insights: DataFrame, selection: DataFrame) -> DataFrame:
    """Insights (id, key, cites array) with ``admitted``, ``reason`` and, for those admitted, their prior, subject, depth tag and evidence.

    Admitted are well-formed keys with citations from the selection only. An insight is one level deeper than the deepest claim it cites.
    """
    rows = _cited(insights, selection)
    good = F.col("reason").isNull()
    return rows.select(
        *insights.columns,
        good.alias("admitted"),
        "reason",
        F.lit(DREAM_PRIOR[0]).alias("alpha"),
        F.lit(DREAM_PRIOR[1]).alias("beta"),
        F.when(good, F.substring_index("key", ".", 1)).alias("subject"),
        F.when(good, F.array(F.concat(F.lit("dream-depth:"), (F.col("_depth") + 1).cast("bigint").cast("string")))).alias("tags"),
        F.when(good, F.transform("cites", lambda c: cite(c))).alias("evidence"),
        F.when(good, F.col("_from")).alias("valid_from"),
        F.when(good, F.col("_to")).alias("valid_to"),
    )


def admit_summaries(summaries: DataFrame, selection: DataFrame, run_id: str | None) -> DataFrame:
    """Summaries (id, key, cites array) of an episode's run with ``admitted`` and ``reason``, as for insights; without a run all are refused."""
    rows = _cited(summaries, selection)
    if run_id is None:
        rows = rows.withColumn("reason", F.lit("episode has no runs"))
    good = F.col("reason").isNull()
    return rows.select(
        *summaries.columns,
        good.alias("admitted"),
        "reason",
        F.lit(SUMMARY_PRIOR[0]).alias("alpha"),
        F.lit(SUMMARY_PRIOR[1]).alias("beta"),
        F.when(good, F.substring_index("key", ".", 1)).alias("subject"),
        F.when(good, F.transform("cites", lambda c: cite(c))).alias("evidence"),
        F.when(good, F.lit(run_id).cast("string")).alias("run_id"),
        F.when(good, F.col("_from")).alias("valid_from"),
        F.when(good, F.col("_to")).alias("valid_to"),
    )


def admitted_claims(admitted: DataFrame, workflow: str, now: int) -> DataFrame:
    """What was admitted (with a column value_json) as candidate claims of a workflow."""
    from ..schema import as_claims

    rows = admitted.where("admitted").withColumns({"status": F.lit("candidate"), "source": F.lit("llm"), "workflow": F.lit(workflow), "recorded": F.lit(now), "dist": F.lit("beta")})
    return as_claims(rows)


class BufferFull(RuntimeError):
    """Too many signals wait; a cycle must drain them."""


class SignalBuffer:
    """Signals of episodes until a cycle takes them: usage, outcomes and what was surfaced. Bounded by ``cap`` signals."""

    def __init__(self, spark, cap: int = 10_000):
        self.spark, self.cap = spark, cap
        self.used: list[tuple] = []
        self.told: list[tuple] = []
        self.shown: list[tuple] = []
        self.counts: dict[str, int] = {}

    def _count(self, episode: str) -> None:
        if sum(self.counts.values()) >= self.cap:
            raise BufferFull(f"{self.cap} signals wait")
        self.counts[episode] = self.counts.get(episode, 0) + 1

    def usage(self, episode: str, claim_ids: list[str]) -> None:
        self._count(episode)
        self.used += [(episode, c) for c in claim_ids]

    def outcome(self, episode: str, result: str, weight: float | None = None) -> None:
        self._count(episode)
        self.told.append((episode, result, weight))

    def surfaced(self, episode: str, claim_ids: list[str]) -> None:
        self.shown += [(episode, c) for c in claim_ids]

    def frames(self, episode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Usage, surfaced claims and outcomes of an episode, as ``evidence_update`` takes them."""
        own = lambda rows: [r for r in rows if r[0] == episode]
        pairs = "episode string, claim_id string"
        make = self.spark.createDataFrame
        return make(own(self.used), pairs), make(own(self.shown), pairs), make(own(self.told), "episode string, result string, weight double")

    def flush(self, episode: str) -> None:
        self.counts.pop(episode, None)
        self.used, self.told, self.shown = ([r for r in rows if r[0] != episode] for rows in (self.used, self.told, self.shown))


class Cycle:
    """Runs processes over an episode's signals, one run at a time; a failing run applies nothing and keeps the signals."""

    def __init__(self, apply, processes: list):
        self.apply, self.processes, self.running, self.number = apply, processes, False, 0

    def run(self, episode: str, buffer: SignalBuffer) -> dict:
        """``apply(plans, key)`` writes what the processes (episode, buffer) -> plan return and gives the number applied."""
        if self.running:
            return {"applied": 0, "errors": ["a cycle is running"]}
        self.running = True
        self.number += 1
        try:
            plans = [p(episode, buffer) for p in self.processes]
            applied = self.apply(plans, f"{episode}:{self.number}")
            buffer.flush(episode)
            return {"applied": applied, "errors": []}
        except Exception as e:  # a process may fail in any way; the signals stay for the next run
            return {"applied": 0, "errors": [str(e)]}
        finally:
            self.running = False


def apply_plan(claims: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """The claims after a consolidation plan: statuses changed and derived claims appended behind the rest."""
    from ..schema import order_of
    from .writing import with_status

    changed = with_status(claims, plan.where("op = 'promote'").select(F.col("target").alias("id"), "to"))
    derived = claims.join(plan.where("op = 'derive'").select(F.col("target").alias("id"), "to", F.col("alpha").alias("_a"), F.col("beta").alias("_b")), "id")
    new = derived.withColumns({
        "id": F.concat(F.lit("fold-"), F.substring(F.sha2("id", 256), 1, 24)), "status": F.col("to"), "alpha": F.col("_a"), "beta": F.col("_b"),
        "raw": F.coalesce(F.col("_a") / (F.col("_a") + F.col("_b")), F.col("p")), "source": F.lit("workflow"), "recorded": F.lit(now).cast("bigint"),
        "ord": order_of(9, F.col("recorded_seq"), F.col("id")),
    })
    return changed.unionByName(new.select(*claims.columns))


def plan_counts(claims: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: applied, skipped (nothing to change) and rejected (unknown targets)."""
    rows = plan.where("op = 'promote'").join(claims.select(F.col("id").alias("target"), "status"), "target", "left")
    return rows.agg(
        F.count_if(F.col("status").isNotNull() & (F.col("status") != F.col("to"))).alias("applied"),
        F.count_if(F.col("status") == F.col("to")).alias("skipped"),
        F.count_if(F.col("status").isNull()).alias("rejected"),
    )
