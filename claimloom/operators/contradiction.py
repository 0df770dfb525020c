"""Contradictions: detection, resolution and what resolving adds.

A cluster is a (subject, canonical key, scope) under which eligible claims hold different values. Resolutions that
compare claims of different values need no pairs: the best claim of any *other* value follows from the two best
values of the cluster, one aggregate and one join. Pairs are made only where they are the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import PRIOR_A, PRIOR_W, check_rule, effective, fold_dempster, point, source_weight
from ..schema import CLAIM_COLUMNS, order_of

GROUP = ["subject", "canonical_key", "scope_hash"]


def canonical_key(claims: DataFrame, aliases: DataFrame | dict[str, str] | None) -> DataFrame:
    """Adds canonical_key. Aliases: a small dict, or a frame (variant, canonical)."""
    if not aliases:
        return claims.withColumn("canonical_key", F.col("key"))
    if isinstance(aliases, dict):
        table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        return claims.withColumn("canonical_key", F.coalesce(F.try_element_at(table, F.col("key")), F.col("key")))
    named = aliases.select(F.col("variant").alias("key"), F.col("canonical").alias("_to"))
    return claims.join(named, "key", "left").withColumn("canonical_key", F.coalesce("_to", "key")).drop("_to")


def check_cardinality(cardinality: dict[str, str] | None) -> dict[str, str]:
    for key, kind in (cardinality or {}).items():
        if kind not in ("single", "multi"):
            raise ValueError(f"cardinality of {key!r} must be single or multi, not {kind!r}")
    return cardinality or {}


def eligible(claims: DataFrame, threshold: float, aliases=None, cardinality: dict[str, str] | None = None) -> DataFrame:
    """Claims that can contradict: confident enough, under a key that holds one value."""
    multi = [k for k, v in check_cardinality(cardinality).items() if v == "multi"]
    out = canonical_key(claims.where(effective() > threshold), aliases)
    return out.where(~F.col("canonical_key").isin(multi)) if multi else out


def pooled(rule: str = "evidence_pooled") -> dict[str, Column]:
    """Aggregates that pool the confidences of a group: alpha, beta and p. Mixed distributions raise."""
    rule = check_rule(rule)
    n, beta = F.count("*"), F.count_if(F.col("dist") == "beta")
    mixed = F.raise_error(F.lit("distributions are mixed in one group")).cast("double")
    unsupported = F.raise_error(F.lit(f"scalar confidences have no rule {rule}")).cast("double")
    w = source_weight(F.col("source"))
    first = lambda c, by: F.max_by(F.col(c), F.struct(by, (-F.col("ord.seq")).alias("s")))
    scalar: Column = unsupported
    if rule == "evidence_pooled":
        a, b = F.sum("alpha") - (n - 1) * (PRIOR_A * PRIOR_W), F.sum("beta") - (n - 1) * ((1 - PRIOR_A) * PRIOR_W)
    elif rule == "weighted_avg":
        a, b = F.sum(w * F.col("alpha")) / F.sum(w), F.sum(w * F.col("beta")) / F.sum(w)
        scalar = F.sum(w * F.col("p")) / F.sum(w)
    elif rule == "max_mean":
        a, b = (first(c, point()) for c in ("alpha", "beta"))
        scalar = F.max("p")
    elif rule == "max_concentration":
        a, b = (first(c, F.col("alpha") + F.col("beta")) for c in ("alpha", "beta"))
        scalar = F.min_by("p", "ord")
    else:
        fused = fold_dempster(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alpha", "beta"))), lambda m: F.struct(m["alpha"].alias("alpha"), m["beta"].alias("beta"))))
        a, b = fused["alpha"], fused["beta"]
    pure = (beta == n) | (beta == 0)
    return {
        "alpha": F.when(~pure, mixed).when(beta == n, a),
        "beta": F.when(~pure, mixed).when(beta == n, b),
        "p": F.when(beta == 0, scalar),
    }


def value_groups(claims: DataFrame, threshold: float, aliases=None, cardinality=None, rule: str = "evidence_pooled") -> DataFrame:
    """Per cluster and value, of clusters with two values at least: n, first ord, pooled confidence and its mean."""
    pool = pooled(rule)
    groups = (
        eligible(claims, threshold, aliases, cardinality)
        .groupBy(*GROUP, "value_hash")
        .agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("value_json").alias("value_json"), *(c.alias(k) for k, c in pool.items()))
        .withColumn("mean", F.coalesce(F.col("alpha") / (F.col("alpha") + F.col("beta")), F.col("p")))
    )
    return groups.withColumn("values", F.count("*").over(Window.partitionBy(*GROUP))).where("values > 1")


def clusters(claims: DataFrame, threshold: float, aliases=None, cardinality=None, rule: str = "evidence_pooled") -> DataFrame:
    """One row per cluster: total_claims, distinct_values, agreement_ratio, the most confident value and all groups."""
    groups = value_groups(claims, threshold, aliases, cardinality, rule)
    best = F.struct(F.col("mean"), (-F.col("first.seq")).alias("s"))
    return groups.groupBy(*GROUP).agg(
        F.sum("n").alias("total_claims"),
        F.count("*").alias("distinct_values"),
        (F.max("n") / F.sum("n")).alias("agreement_ratio"),
        F.max_by("value_json", best).alias("best_value"),
        F.max("mean").alias("best_mean"),
        F.array_sort(F.collect_list(F.struct("first", "value_hash", "n", "alpha", "beta", "p", "mean"))).alias("groups"),
    )


def pairs(claims: DataFrame, threshold: float, aliases=None, cardinality=None) -> DataFrame:
    """All pairs of eligible claims of a cluster with different values, each once: left_id reads before right_id's group.

    The number of pairs is the result's own; for resolving, use the forms below, which make none.
    """
    keyed = eligible(claims, threshold, aliases, cardinality)
    first = keyed.groupBy(*GROUP, "value_hash").agg(F.min("ord").alias("first"))
    place = first.withColumn("g", F.row_number().over(Window.partitionBy(*GROUP).orderBy("first"))).drop("first")
    rows = keyed.join(place, [*GROUP, "value_hash"]).select(*GROUP, "id", "g")
    left, right = rows.withColumnsRenamed({"id": "left_id", "g": "lg"}), rows.withColumnsRenamed({"id": "right_id", "g": "rg"})
    return left.join(right, GROUP).where("lg < rg").select(*GROUP, "left_id", "right_id", F.lit("value-difference").alias("conflict_reason"))


def _against_others(keyed: DataFrame, measure: Column) -> DataFrame:
    """Eligible claims with ``mine`` and ``theirs``: the measure and its maximum over the cluster's other values."""
    rows = keyed.withColumn("mine", measure)
    tops = rows.groupBy(*GROUP, "value_hash").agg(F.max("mine").alias("top"))
    two = tops.groupBy(*GROUP).agg(F.slice(F.sort_array(F.collect_list(F.struct("top", "value_hash")), asc=False), 1, 2).alias("two"), F.count("*").alias("values")).where("values > 1")
    other = F.when(F.col("two")[0]["value_hash"] != F.col("value_hash"), F.col("two")[0]["top"]).otherwise(F.col("two")[1]["top"])
    return rows.join(two, GROUP).withColumn("theirs", other)


def flag_artifacts(pairs_df: DataFrame, now: int, stage: int = 9) -> DataFrame:
    """A reviewable claim for each pair (left_id, right_id), with an id derived from both."""
    cite = lambda c: F.struct(F.lit("claim").alias("kind"), F.col(c).alias("claim_id"))
    from ..schema import as_claims

    body = pairs_df.select(
        F.concat(F.lit("flag-"), F.substring(F.sha2(F.concat_ws("|", "left_id", "right_id"), 256), 1, 24)).alias("id"),
        F.lit("contradiction").alias("subject"),
        F.lit("contradiction.flag").alias("key"),
        F.to_json(F.struct(F.col("left_id").alias("left"), F.lit("value-difference").alias("reason"), F.col("right_id").alias("right"))).alias("value_json"),
        F.lit("scalar").alias("dist"), F.lit(1.0).alias("p"), F.lit(now).alias("valid_from"), F.lit(now).alias("recorded"),
        F.lit("candidate").alias("status"), F.lit("heuristic").alias("source"),
        F.expr("array(named_struct('kind','claim','claim_id',left_id,'document_id',cast(null as string),'offset_start',cast(null as bigint),'offset_end',cast(null as bigint),'method',cast(null as string),'uri',cast(null as string),'content_hash',cast(null as string)),"
               "named_struct('kind','claim','claim_id',right_id,'document_id',cast(null as string),'offset_start',cast(null as bigint),'offset_end',cast(null as bigint),'method',cast(null as string),'uri',cast(null as string),'content_hash',cast(null as string)))").alias("evidence"),
    )
    return as_claims(body).withColumn("ord", order_of(stage, F.col("recorded_seq"), F.col("id")))


def _resolve_by(claims: DataFrame, measure: Column, threshold: float, now: int, aliases, cardinality, flags: bool) -> DataFrame:
    """Claims below the best of another value are deprecated; pairs tied at the cluster's top are flagged."""
    judged = _against_others(eligible(claims, threshold, aliases, cardinality), measure)
    losers = judged.where("mine < theirs").select("id").distinct().withColumn("lost", F.lit(True))
    out = claims.join(losers, "id", "left").withColumn("status", F.when(F.col("lost"), "deprecated").otherwise(F.col("status"))).select(*claims.columns)
    if not flags:
        return out
    tied = judged.where("mine = theirs").select(*GROUP, "value_hash", "id", "ord")
    first = tied.groupBy(*GROUP, "value_hash").agg(F.min("ord").alias("first"))
    tied = tied.join(first.withColumn("g", F.row_number().over(Window.partitionBy(*GROUP).orderBy("first"))).drop("first"), [*GROUP, "value_hash"]).select(*GROUP, "id", "g")
    both = tied.withColumnsRenamed({"id": "left_id", "g": "lg"}).join(tied.withColumnsRenamed({"id": "right_id", "g": "rg"}), GROUP).where("lg < rg")
    added = flag_artifacts(both.select("left_id", "right_id"), now)
    return out.unionByName(added.select(*CLAIM_COLUMNS), allowMissingColumns=True)


def resolve_deprecate_older(claims, threshold=0.5, now=0, aliases=None, cardinality=None, flags=True) -> DataFrame:
    return _resolve_by(claims, F.col("valid_from"), threshold, now, aliases, cardinality, flags)


def resolve_deprecate_lower(claims, threshold=0.5, now=0, aliases=None, cardinality=None, flags=True) -> DataFrame:
    return _resolve_by(claims, point(), threshold, now, aliases, cardinality, flags)


def resolve_keep_both(claims, threshold=0.5, now=0, aliases=None, cardinality=None) -> DataFrame:
    return claims


def resolve_flag_for_review(claims, threshold=0.5, now=0, aliases=None, cardinality=None) -> DataFrame:
    """One flag for each pair: as many rows as pairs, by definition."""
    return claims.unionByName(flag_artifacts(pairs(claims, threshold, aliases, cardinality), now).select(*CLAIM_COLUMNS), allowMissingColumns=True)


def _by_majority(claims, threshold, aliases, cardinality, promote: bool) -> DataFrame:
    keyed = eligible(claims, threshold, aliases, cardinality)
    sizes = keyed.groupBy(*GROUP, "value_hash").agg(F.count("*").alias("n"))
    ranks = sizes.select(
        *GROUP, "value_hash", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("n"), "value_hash")).alias("r"), F.count("*").over(Window.partitionBy(*GROUP)).alias("values")
    ).where("values > 1")
    told = keyed.join(ranks, [*GROUP, "value_hash"]).select("id", "r").dropDuplicates(["id"])
    status = F.when(F.col("r") > 1, "deprecated").when(F.lit(promote) & (F.col("r") == 1), "validated").otherwise(F.col("status"))
    return claims.join(told, "id", "left").withColumn("status", status).select(*claims.columns)


def resolve_deprecate_minority(claims, threshold=0.5, now=0, aliases=None, cardinality=None) -> DataFrame:
    return _by_majority(claims, threshold, aliases, cardinality, promote=False)


def resolve_promote_consensus(claims, threshold=0.5, now=0, aliases=None, cardinality=None) -> DataFrame:
    return _by_majority(claims, threshold, aliases, cardinality, promote=True)


def fused_beliefs(claims: DataFrame, threshold: float, rule: str = "weighted_avg", aliases=None, cardinality=None) -> DataFrame:
    """For clusters of two values: the pooled confidences of both sides fused by ``rule``, weighted by source trust."""
    rule = check_rule(rule)
    keyed = eligible(claims, threshold, aliases, cardinality).withColumn("w", source_weight(F.col("source")))
    pool = pooled("evidence_pooled")
    sides = keyed.groupBy(*GROUP, "value_hash").agg(F.min("ord").alias("first"), F.sum("w").alias("w"), F.max("value_json").alias("value_json"), F.min_by("scope", "ord").alias("scope"), F.min_by("valid_from", "ord").alias("valid_from"), *(c.alias(k) for k, c in pool.items()))
    two = sides.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("first", "value_hash", "value_json", "valid_from", "w", "alpha", "beta", F.to_json("scope").alias("scope")))).alias("s")).where(F.size("s") == 2)
    a, b = F.col("s")[0], F.col("s")[1]
    mean = lambda x: x["alpha"] / (x["alpha"] + x["beta"])
    weigh = lambda f: (a["w"] * a[f] + b["w"] * b[f]) / (a["w"] + b["w"])
    pick = lambda m: (lambda f: F.when(m(b) > m(a), b[f]).otherwise(a[f]))
    if rule == "weighted_avg":
        fused = {f: weigh(f) for f in ("alpha", "beta")}
    elif rule == "evidence_pooled":
        fused = {"alpha": a["alpha"] + b["alpha"] - PRIOR_A * PRIOR_W, "beta": a["beta"] + b["beta"] - (1 - PRIOR_A) * PRIOR_W}
    elif rule in ("max_mean", "max_concentration"):
        chosen = pick(mean if rule == "max_mean" else lambda x: x["alpha"] + x["beta"])
        fused = {f: chosen(f) for f in ("alpha", "beta")}
    else:
        both = fold_dempster(F.transform("s", lambda m: F.struct(m["alpha"].alias("alpha"), m["beta"].alias("beta"))))
        fused = {f: both[f] for f in ("alpha", "beta")}
    favored = F.when(mean(b) > mean(a), b).otherwise(a)
    return two.select(
        *GROUP, a["value_json"].alias("left_value"), b["value_json"].alias("right_value"), favored["value_json"].alias("value_json"),
        F.from_json(favored["scope"], "map<string,string>").alias("scope"), favored["valid_from"].alias("valid_from"), *(c.alias(f) for f, c in fused.items()),
    )


def resolve_synthesize_belief(claims, threshold=0.5, now=0, aliases=None, cardinality=None, rule: str = "weighted_avg") -> DataFrame:
    """Both sides of two-value clusters are deprecated; a validated claim with the fused confidence is appended."""
    from ..schema import as_claims

    fused = fused_beliefs(claims, threshold, rule, aliases, cardinality)
    members = eligible(claims, threshold, aliases, cardinality).join(fused.select(*GROUP), GROUP, "left_semi").select("id").withColumn("lost", F.lit(True))
    out = claims.join(members.distinct(), "id", "left").withColumn("status", F.when(F.col("lost"), "deprecated").otherwise(F.col("status"))).select(*claims.columns)
    body = fused.select(
        F.concat(F.lit("fused-"), F.substring(F.sha2(F.concat_ws("|", *GROUP), 256), 1, 24)).alias("id"), "subject", F.col("canonical_key").alias("key"),
        "value_json", "scope", "alpha", "beta", "valid_from", F.lit(0).alias("recorded"), F.lit("validated").alias("status"), F.lit("workflow").alias("source"),
    )
    added = as_claims(body).withColumn("ord", order_of(9, F.col("recorded_seq"), F.col("id")))
    return out.unionByName(added.select(*CLAIM_COLUMNS), allowMissingColumns=True)


class MissingRule(KeyError):
    """No resolution rule of that name."""


RESOLUTIONS = {
    "deprecate_older": resolve_deprecate_older,
    "deprecate_lower": resolve_deprecate_lower,
    "keep_both": resolve_keep_both,
    "flag_for_review": resolve_flag_for_review,
    "deprecate_minority": resolve_deprecate_minority,
    "promote_consensus": resolve_promote_consensus,
    "synthesize_belief": resolve_synthesize_belief,
}


def resolution(name: str):
    if name not in RESOLUTIONS:
        raise MissingRule(f"no resolution rule {name!r}")
    return RESOLUTIONS[name]


def cardinality_collisions(claims: DataFrame, cardinality: dict[str, str] | None = None, aliases=None) -> DataFrame:
    """Single-valued keys that hold two values or more: subject, canonical_key, scope_hash, values, total (claims)."""
    multi = [k for k, v in check_cardinality(cardinality).items() if v == "multi"]
    rows = canonical_key(claims.where("status <> 'deprecated'"), aliases)
    rows = rows.where(~F.col("canonical_key").isin(multi)) if multi else rows
    return rows.groupBy(*GROUP).agg(F.count_distinct("value_hash").alias("values"), F.count("*").alias("total")).where("values > 1")
