"""Reports on the vocabulary of a corpus: censuses, reconciliation of candidates, and signs of merged subjects.

Pairs are found through common tokens, rare ones first, so that a token of most names makes no pairs; those without
a common token score 0 (1 if neither has any) and are added where a report has room for them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.contradiction import cardinality_collisions
from ..operators.graph import components, settled
from ..operators.temporal import tau_valid
from .read import FLAG_KEY, is_alias, restated

REUSE_AT, NEW_AT = 0.9, 0.5
#: Likeness by which a census goes down.
LEVELS = (0.75, 0.5, 0.25, 0.0)
MIN_CLUSTER, SEPARATION, MINORITY = 2, 0.1, 0.5


def live(claims: DataFrame, t: int) -> DataFrame:
    return tau_valid(claims, t).where((F.col("status") != "deprecated") & (F.col("key") != FLAG_KEY) & ~is_alias())


def distinct_entities(claims: DataFrame, axis: str, t: int) -> DataFrame:
    """Live subjects or keys with their claims: value, n; most first, then by name."""
    return live(claims, t).groupBy(F.col(axis).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def _tokens(names: DataFrame) -> DataFrame:
    return names.select("value", V.tokens(F.col("value")).alias("t"))


def _met(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, ta, b, tb) of names (value, t) that can be ``least`` alike, each once for each token that they meet in.

    Tokens stand in one order, rarest first; names as alike as that share a token among the first n - ceil(least n) + 1
    of each, so what most names have in common makes no pairs.
    """
    often = right.select(F.explode("t").alias("k")).groupBy("k").agg(F.count("*").alias("often"))

    def prefixes(side: DataFrame, name: str, tokens: str) -> DataFrame:
        each = side.select(F.col("value").alias(name), F.col("t").alias(tokens), F.explode("t").alias("k")).join(often, "k", "left")
        rare = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("often", F.lit(0)), "k"))  # one name's tokens
        return each.withColumn("r", rare).where(F.col("r") <= F.size(tokens) - F.ceil(F.lit(least) * F.size(tokens) - 1e-9) + 1).select(name, tokens, "k")

    return prefixes(left, "a", "ta").join(prefixes(right, "b", "tb"), "k").drop("k")


def _alike(left: DataFrame, right: DataFrame, once: bool, least: float = 0.0) -> DataFrame:
    """Pairs of names (a, b) with a common token and a Jaccard of ``least`` at least."""
    met = _met(left, right, least)
    pairs = (met.where("a < b") if once else met).dropDuplicates(["a", "b"])
    return pairs.select("a", "b", V.jaccard(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") >= least)


def census(claims: DataFrame, axis: str, t: int, limit: int = 20) -> DataFrame:
    """The most alike pairs of live names on an axis: a, b, score, the best ``limit`` of all pairs.

    The search goes down by levels of likeness and stops at the first one that fills the list. Names without tokens are alike
    (1); pairs without a common token (0) fill up what is left. Of either only the first names by order can be in the list.
    """
    names = settled(_tokens(distinct_entities(claims, axis, t)), "names")
    first = lambda rows, n: rows.orderBy("value").limit(n)
    pairs = lambda rows, score: rows.select(F.col("value").alias("a"), F.col("t").alias("ta")).join(rows.select(F.col("value").alias("b"), F.col("t").alias("tb")), F.col("a") < F.col("b")).select("a", "b", "ta", "tb", F.lit(score).alias("score"))
    none = pairs(settled(first(names.where(F.size("t") == 0), limit + 1), "first"), 1.0).drop("ta", "tb")  # limit + 1 names at most
    for least in LEVELS:
        found = settled(_alike(names, names, once=True, least=least), "pairs").unionByName(none)
        if least == 0 or found.limit(limit).count() == limit:
            break
    if least == 0:
        far = pairs(settled(first(names, 2 * limit), "first"), 0.0)  # 2 * limit names at most
        far = far.where((F.size(F.array_intersect("ta", "tb")) == 0) & ((F.size("ta") > 0) | (F.size("tb") > 0))).drop("ta", "tb")
        found = found.unionByName(far)
    return found.orderBy(F.desc("score"), "a", "b").limit(limit)


def key_census(claims: DataFrame, t: int, limit: int = 20) -> DataFrame:
    return census(claims, "key", t, limit)


def subject_census(claims: DataFrame, t: int, limit: int = 20) -> DataFrame:
    return census(claims, "subject", t, limit)


def reconcile(candidates: DataFrame, claims: DataFrame, axis: str, t: int, limit: int = 5, reuse_at: float = REUSE_AT, new_at: float = NEW_AT) -> DataFrame:
    """Per candidate (column value): its best existing name, score and disposition reuse, new or uncertain."""
    asked, names = settled(_tokens(candidates.select("value").distinct()), "asked"), settled(_tokens(distinct_entities(claims, axis, t)), "names")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    # without tokens alike, without a common one not alike at all; of either only the first names can be among the best
    bare = names.where(F.size("t") == 0).orderBy("value").limit(limit).select(F.col("value").alias("b"), F.lit(1.0).alias("score"))
    bare = asked.where(F.size("t") == 0).select(F.col("value").alias("a")).join(F.broadcast(bare))  # ``limit`` rows at most
    found = settled(_alike(asked, names, once=False).unionByName(bare), "alike")
    met = found.groupBy("a").agg(F.count("*").alias("met"))
    lacking = asked.select(F.col("value").alias("a")).join(met, "a", "left").where(F.coalesce("met", F.lit(0)) < limit).select("a")
    others = names.orderBy("value").limit(2 * limit).select(F.col("value").alias("b"))
    far = lacking.join(F.broadcast(others)).join(found, ["a", "b"], "left_anti").select("a", "b", F.lit(0.0).alias("score"))  # 2 * ``limit`` rows at most
    best = found.unionByName(far).withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    told = best.groupBy(F.col("a").alias("value")).agg(F.array_sort(F.collect_list(F.struct("r", "b", "score"))).alias("suggestions"))
    score = F.coalesce(F.get("suggestions", F.lit(0))["score"], F.lit(0.0))
    return candidates.select("value").distinct().join(told, "value", "left").select(
        "value",
        F.get("suggestions", F.lit(0))["b"].alias("best"),
        score.alias("score"),
        F.when(score >= reuse_at, "reuse").when(score <= new_at, "new").otherwise("uncertain").alias("disposition"),
        F.transform("suggestions", lambda s: F.struct(s["b"].alias("existing"), s["score"].alias("score"))).alias("suggestions"),
    )


def _value_sets(rows: DataFrame) -> DataFrame:
    """Claims by subject and the tokens of their value: subject, v (hash of the tokens), t, k (claims), rep (their smallest id)."""
    sets = rows.select("id", "subject", F.array_sort(V.tokens(F.col("value_text"))).alias("t"))
    return sets.groupBy("subject", "t").agg(F.count("*").alias("k"), F.min("id").alias("rep")).withColumn("v", F.xxhash64("t"))


def _like(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of different token sets (v, t) that share a token, within ``on``: x, y, score. Sets without tokens meet nothing."""
    each = lambda side, name: side.select(*on, F.col("v").alias(name), F.col("t").alias(f"t{name}"), F.explode("t").alias("token"))
    met = each(left, "x").join(each(right, "y"), [*on, "token"]).where((F.col("x") != F.col("y")) & (F.col("token") == F.array_min(F.array_intersect("tx", "ty"))))
    return met.select(*on, "x", "y", V.jaccard(F.col("tx"), F.col("ty")).alias("score"))


def value_clusters(claims: DataFrame, t: int, min_claims: int = 4) -> DataFrame:
    """Subjects whose values fall into two well separated clusters of two claims at least: subject, n, clusters, substantial.

    Claims of one subject with equal tokens are one node; pairs of claims are counted, not made.
    """
    rows = live(claims, t)
    sizes = rows.groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") >= min_claims)
    sets = settled(_value_sets(rows.join(sizes.select("subject"), "subject", "left_semi")), "sets")
    pairs = settled(_like(sets, sets, ["subject"]).where("x < y"), "like")
    k = lambda c: sets.select("subject", F.col("v").alias(c), F.col("k").alias(f"k{c}"), F.col("rep").alias(f"rep{c}"))
    counted = pairs.join(k("x"), ["subject", "x"]).join(k("y"), ["subject", "y"]).withColumn("pairs", F.col("kx") * F.col("ky"))
    equal = sets.where("k > 1").select("subject", F.lit(1.0).alias("score"), (F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("pairs"))
    scored = counted.select("subject", "score", "pairs").unionByName(equal)
    range_ = scored.groupBy("subject").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("pairs").alias("met"))
    low = F.when(F.col("met") < F.col("n") * (F.col("n") - 1) / 2, 0.0).otherwise(F.col("low"))  # a pair without a common token scores 0
    cut = sizes.join(range_, "subject").withColumn("low", low).where(F.col("high") - F.col("low") >= SEPARATION).select("subject", ((F.col("low") + F.col("high")) / 2).alias("at"))
    found = components(counted.join(cut, "subject").where("score >= at").select(F.col("repx").alias("a"), F.col("repy").alias("b")))
    members = sets.join(cut, "subject", "left_semi").join(found, F.col("rep") == F.col("node"), "left").select("subject", "k", F.coalesce("component", "rep").alias("c"))
    grouped = members.groupBy("subject", "c").agg(F.sum("k").alias("k"))
    return grouped.groupBy("subject").agg(F.sum("k").alias("n"), F.count("*").alias("clusters"), F.count_if(F.col("k") >= MIN_CLUSTER).alias("substantial")).where("substantial >= 2")


def misplaced(claims: DataFrame, t: int, min_claims: int = 4) -> DataFrame:
    """Subjects with a minority of claims that cohere more with another subject: subject, n, affected, better_subject, gap.

    Likeness is that of token sets, so each pair of different sets is scored once, whatever claims hold them; of the
    subjects that hold a set, the first two are enough to name the best one that is not the claim's own.
    """
    rows = live(claims, t)
    sizes = rows.groupBy("subject").agg(F.count("*").alias("n"))
    held = settled(_value_sets(rows), "held")
    sets = settled(held.select("v", "t").dropDuplicates(["v"]), "sets")
    like = settled(_like(sets, sets, []).unionByName(sets.select(F.col("v").alias("x"), F.col("v").alias("y"), F.lit(1.0).alias("score"))), "like")
    first = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    two = held.select(F.col("v").alias("y"), "subject").withColumn("r", first("y", "subject")).where("r <= 2").select("y", "subject")
    best = like.join(two, "y").groupBy("x", "subject").agg(F.max("score").alias("score")).withColumn("r", first("x", F.desc("score"), "subject")).where("r <= 2")
    best = best.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("r", "subject", "score"))).alias("w"))
    top = F.when(F.col("w")[0]["subject"] != F.col("subject"), F.col("w")[0]).otherwise(F.get("w", F.lit(1)))
    foreign = held.join(best, F.col("v") == F.col("x")).select("v", "subject", "k", top.alias("top")).where("top is not null")
    mine = like.where("x <> y").join(held.select(F.col("v").alias("x"), "subject"), "x").join(held.select(F.col("v").alias("y"), "subject"), ["y", "subject"])
    mine = mine.groupBy(F.col("x").alias("v"), "subject").agg(F.max("score").alias("own"))
    own = F.when(F.col("k") > 1, 1.0).otherwise(F.coalesce("own", F.lit(0.0)))
    gaps = foreign.join(mine, ["v", "subject"], "left").select("subject", "k", F.col("top.subject").alias("better"), (F.col("top.score") - own).alias("gap")).where("gap > 0")
    votes = gaps.groupBy("subject", "better").agg(F.sum("k").alias("votes"), F.max("gap").alias("gap"))
    told = votes.groupBy("subject").agg(F.sum("votes").alias("affected"), F.max_by(F.struct("better", "gap"), F.struct("votes", "gap", "better")).alias("m"))
    out = told.join(sizes, "subject").where((F.col("n") >= min_claims) & (F.col("affected") < F.col("n") * MINORITY))
    return out.select("subject", "n", "affected", F.col("m.better").alias("better_subject"), F.col("m.gap").alias("gap"))


def audit(claims: DataFrame, t: int, cardinality: dict[str, str] | None = None, limit: int = 20, corpus: str = "default", aliases: dict[str, str] | None = None) -> DataFrame:
    """All proposals in one list, the most affected first: kind, entities, score, claims_affected, suggested_action, detail.

    Kinds: key-alias and subject-fragmentation (the most alike pairs; affected are the claims of both), cardinality-declare
    (single-valued keys with several values) and subject-over-merge (from both detectors; affects 0, so that it comes last).
    Nothing is applied: actions are texts for the caller.
    """
    name = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    quoted = lambda c: V.json_quoted(F.col(c))
    where = F.lit(json.dumps(corpus, ensure_ascii=False))
    no_score, none = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    parts = []
    for axis, kind in (("key", "key-alias"), ("subject", "subject-fragmentation")):
        n = distinct_entities(claims, axis, t)
        pairs = census(claims, axis, t, limit)
        sized = pairs.join(n.select(F.col("value").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("value").alias("b"), F.col("n").alias("nb")), "b")
        alias = F.concat(F.lit('remember(subject="key:" + '), quoted("a"), F.lit(', key="alias-of", value='), quoted("b"), F.lit(", corpus="), where, F.lit(")"))
        merge = F.concat(F.lit("reconcile("), where, F.lit(", ["), quoted("a"), F.lit(", "), quoted("b"), F.lit("]) at ingestion"))
        told = F.concat(name("a"), F.lit(" and "), name("b"), F.lit(" may be one " + axis + ", likeness "), F.format_number("score", 3))
        parts.append(sized.select(F.lit(kind).alias("kind"), F.array("a", "b").alias("entities"), "score", (F.col("na") + F.col("nb")).alias("claims_affected"), (alias if axis == "key" else merge).alias("suggested_action"), told.alias("detail")))
    merged = restated(claims, t)[2]
    found = cardinality_collisions(merged, cardinality, aliases)
    declare = F.concat(F.lit("declare_cardinality("), where, F.lit(", {"), quoted("canonical_key"), F.lit(': "multi"})'))
    told = F.concat(name("subject"), F.lit(" holds "), F.col("values").cast("string"), F.lit(" values under "), name("canonical_key"), F.lit(", of which a read serves the newest"))
    parts.append(found.select(F.lit("cardinality-declare").alias("kind"), F.array("subject", "canonical_key").alias("entities"), no_score.alias("score"), F.col("total").alias("claims_affected"), declare.alias("suggested_action"), told.alias("detail")))
    review = lambda confidence: F.concat(F.lit("review "), name("subject"), F.lit(f" (confidence {confidence}); split it if it stands for several things"))
    leaked, split = misplaced(claims, t), value_clusters(claims, t)
    told = F.concat(F.col("affected").cast("string"), F.lit(" claims of "), name("subject"), F.lit(" are nearer to "), name("better_subject"))
    parts.append(leaked.select(F.lit("subject-over-merge").alias("kind"), F.array("subject", "better_subject").alias("entities"), no_score.alias("score"), none.alias("claims_affected"), review("medium").alias("suggested_action"), told.alias("detail")))
    told = F.concat(F.lit("the values of "), name("subject"), F.lit(" fall into "), F.col("substantial").cast("string"), F.lit(" groups"))
    parts.append(split.select(F.lit("subject-over-merge").alias("kind"), F.array("subject").alias("entities"), no_score.alias("score"), none.alias("claims_affected"), review("low").alias("suggested_action"), told.alias("detail")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc("claims_affected"), F.desc(F.coalesce("score", F.lit(0.0))), "kind", "entities")
