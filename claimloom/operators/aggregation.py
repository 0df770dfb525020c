"""Aggregation of claims, Beta-typed rates, and aggregates that reweight a ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.confidence import PRIOR_A, PRIOR_W, wilson_lower
from ..schema import CLAIM_COLUMNS
from .ranking import ranked


def claim_path(path: str) -> Column:
    """``scope.x``, ``value``, ``value.x.y`` or a plain field, as JSON text or the field itself."""
    if path.startswith("scope."):
        return F.try_element_at("scope", F.lit(path[6:]))
    if path == "value":
        return F.col("value_json")
    if path.startswith("value."):
        return V.json_at(F.col("value_json"), path[6:])
    return F.col(path)


def as_number(path: str) -> Column:
    """Numbers as lenient as the claims' origin: true is 1, null and empty text 0, numeric text its number, the rest null."""
    if path == "value" or path.startswith("value."):
        found = F.try_parse_json("value_json") if path == "value" else V.at_path(F.col("value_json"), path[6:])
        text = F.trim(F.try_variant_get(found, "$", "string"))
        kind = V.kind_of(found)
        return (
            F.when(kind == "null", 0.0)
            .when(kind == "boolean", F.try_variant_get(found, "$", "boolean").cast("double"))
            .when(kind == "string", F.when(text == "", 0.0).otherwise(text.try_cast("double")))
            .when(kind == "number", F.try_variant_get(found, "$", "double"))
        )
    if path.startswith("scope."):
        text = F.trim(F.try_element_at("scope", F.lit(path[6:])))
        return F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    return F.col(path).try_cast("double")


def _finite(path: str) -> Column:
    n = as_number(path)
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def count() -> dict[str, Column]:
    return {"n": F.count("*")}


def count_where(predicate: Column) -> dict[str, Column]:
    return {"n": F.count_if(predicate)}


def sum_of(path: str) -> dict[str, Column]:
    return {"value": F.coalesce(F.sum(_finite(path)), F.lit(0.0))}


def avg_of(path: str) -> dict[str, Column]:
    return {"value": F.coalesce(F.avg(_finite(path)), F.lit(0.0))}


def _comparable(path: str) -> Column:
    """What a claim holds at a path for comparisons: (number, text). Text counts where there is no number."""
    if path == "value" or path.startswith("value."):
        found = F.try_parse_json("value_json") if path == "value" else V.at_path(F.col("value_json"), path[6:])
        text = F.when(V.kind_of(found) == "string", F.try_variant_get(found, "$", "string"))
        return F.struct(F.when(text.isNull(), as_number(path)).alias("number"), text.alias("text"))
    if path.startswith("scope."):
        return F.struct(F.lit(None).cast("double").alias("number"), claim_path(path).alias("text"))
    kind = CLAIM_COLUMNS.get(path, "double")
    number = F.col(path).cast("double") if kind in ("double", "bigint", "int") else F.lit(None).cast("double")
    return F.struct(number.alias("number"), (F.lit(None) if kind in ("double", "bigint", "int") else F.col(path)).cast("string").alias("text"))


def _extreme(path: str, of: Callable[[Column], Column]) -> dict[str, Column]:
    """Numbers are compared as numbers where there is one, texts as texts where all are texts; a missing value is none.

    A mixture compares the numbers alone, with numeric texts among them. ``value`` is the number, ``text`` the text.
    """
    c = _comparable(path)
    numeric = F.coalesce(c["number"], F.trim(c["text"]).try_cast("double"))
    only_text = F.count(c["number"]) == 0
    return {"value": F.when(only_text, F.lit(None).cast("double")).otherwise(of(numeric)), "text": F.when(only_text, of(c["text"]))}


def min_of(path: str) -> dict[str, Column]:
    return _extreme(path, F.min)


def max_of(path: str) -> dict[str, Column]:
    return _extreme(path, F.max)


def rate(hit: Column, trial: Column) -> dict[str, Column]:
    """A Beta: hits and trials that are no hits, with the prior."""
    return {"alpha": F.count_if(hit) + PRIOR_A * PRIOR_W, "beta": F.count_if(trial & ~hit) + (1 - PRIOR_A) * PRIOR_W}


def binary_rate(path: str) -> dict[str, Column]:
    """A Beta over true and false; everything else does not count."""
    text = claim_path(path)
    return {"alpha": F.count_if(text == "true") + PRIOR_A * PRIOR_W, "beta": F.count_if(text == "false") + (1 - PRIOR_A) * PRIOR_W}


def alpha(claims: DataFrame, core: dict[str, Column]) -> DataFrame:
    """One row for all claims."""
    return claims.agg(*(c.alias(k) for k, c in core.items()))


def group_by(claims: DataFrame, path: str, core: dict[str, Column]) -> DataFrame:
    """One row per value of ``path`` as text; claims without one drop out."""
    key = claim_path(path)
    if path == "value" or path.startswith("value."):
        found = F.try_parse_json("value_json") if path == "value" else V.at_path(F.col("value_json"), path[6:])
        key = F.when(~F.is_variant_null(found), F.coalesce(F.when(V.kind_of(found) == "string", F.try_variant_get(found, "$", "string")), key))
    return claims.withColumn("group_key", key.cast("string")).where("group_key is not null").groupBy("group_key").agg(*(c.alias(k) for k, c in core.items()))


# reweighting: (score, aggregate's columns) -> score




def multiply(score: Column, agg: Callable[[str], Column]) -> Column:
    return score * agg("n")


def multiply_mean(score: Column, agg: Callable[[str], Column]) -> Column:
    return score * agg("alpha") / (agg("alpha") + agg("beta"))


def wilson_floor(score: Column, agg: Callable[[str], Column], z: float = 1.96) -> Column:
    """Score x the Wilson lower bound of the rate without its prior."""
    hits = agg("alpha") - PRIOR_A * PRIOR_W
    trials = hits + agg("beta") - (1 - PRIOR_A) * PRIOR_W
    return score * wilson_lower(hits, trials, z)


def boost(factor: float):
    return lambda score, agg: score + agg("n") * factor


def normalize(aggregates: DataFrame, column: str = "n"):
    """Score x aggregate over the largest aggregate; where that is 0 the score stays."""
    top = aggregates.agg(F.max(column)).first()[0] or 0
    return lambda score, agg: score * agg(column) / F.lit(float(top)) if top else score


def join_aggregate(rows: DataFrame, aggregates: DataFrame, path: str, reweight, ordered: bool = True) -> DataFrame:
    """Ranked rows with their score reweighted by the aggregate of their group; rows without one keep theirs."""
    named = aggregates.select(*(F.col(c).alias(f"_agg_{c}") for c in aggregates.columns))
    keyed = rows.withColumn("_key", claim_path(path).cast("string"))
    joined = keyed.join(named, F.col("_key") == F.col("_agg_group_key"), "left")
    score = F.when(F.col("_agg_group_key").isNotNull(), reweight(F.col("score"), lambda c: F.col(f"_agg_{c}"))).otherwise(F.col("score"))
    out = joined.withColumn("score", score).select(*rows.columns)
    return ranked(out) if ordered else out
