"""Participation joins and override.

A participation join keeps the claims of either side that have a partner on the other, left ones first, each id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TRIPLE


def _one_each(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.join(left.select("id"), "id", "left_anti")
    later = right.withColumn("ord", F.struct((F.col("ord.stage") + 1).alias("stage"), F.col("ord.seq").alias("seq"), F.col("ord.tie").alias("tie")))
    return left.unionByName(later.select(*left.columns))


def _participating(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    l, r = left.withColumn("_k", on).where("_k is not null"), right.withColumn("_k", on).where("_k is not null")
    return _one_each(l.join(r.select("_k"), "_k", "left_semi").select(*left.columns), r.join(l.select("_k"), "_k", "left_semi").select(*left.columns))


def join_subject(left: DataFrame, right: DataFrame) -> DataFrame:
    return _participating(left, right, F.col("subject"))


def join_scope(left: DataFrame, right: DataFrame) -> DataFrame:
    """On the scope's entityId, where both have one."""
    return _participating(left, right, F.try_element_at("scope", F.lit("entityId")))


def _evidence_tokens(claims: DataFrame, side: str) -> DataFrame:
    """What a claim can be met by: its own id, the ids it cites and each reference as a whole. Rows (side, id, own, token)."""
    reference = claims.schema["evidence"].dataType.elementType
    token = lambda claim, e: F.struct(claim.cast("string").alias("claim"), e.cast(reference).alias("reference"))
    none = F.lit(None)
    own = F.array(F.struct(F.lit(True).alias("own"), token(F.col("id"), none).alias("token")))
    cited = F.transform(F.filter("evidence", lambda e: e["kind"] == "claim"), lambda e: F.struct(F.lit(False).alias("own"), token(e["claim_id"], none).alias("token")))
    whole = F.transform("evidence", lambda e: F.struct(F.lit(False).alias("own"), token(none, e).alias("token")))
    return claims.select(F.lit(side).alias("side"), "id", F.explode(F.array_distinct(F.concat(own, cited, whole))).alias("x")).select("side", "id", "x.own", "x.token")


def join_evidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Claims of which one cites the other, or that share a reference.

    All tokens of both sides are one frame; an aggregate tells for each token who has it and how, and a claim is met if
    the other side has one of its tokens in a way that fits. A token of many claims is one row of the aggregate.
    """
    tokens = _evidence_tokens(left, "left").unionByName(_evidence_tokens(right, "right"))
    who = tokens.groupBy("token").agg(*(F.bool_or((F.col("side") == s) & (F.col("own") == o)).alias(f"{s}_{o}".lower()) for s in ("left", "right") for o in (True, False)))
    other = lambda o: F.when(F.col("side") == "left", F.col(f"right_{o}")).otherwise(F.col(f"left_{o}"))
    # an own id is met where it is cited, a cited id where it is owned, a reference where it is used
    fits = F.when(F.col("own") | F.col("token.claim").isNull(), other("false")).otherwise(other("true"))
    met = tokens.join(who, "token").where(fits).select("side", "id").distinct()
    own = lambda side: met.where(F.col("side") == side).select("id")
    return _one_each(left.join(own("left"), "id", "left_semi").select(*left.columns), right.join(own("right"), "id", "left_semi").select(*right.columns))


def override(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left layer, and of the right one what the left says nothing about (by subject, key and scope)."""
    rest = right.join(left.select(*TRIPLE).distinct(), list(TRIPLE), "left_anti")
    later = rest.withColumn("ord", F.struct((F.col("ord.stage") + 1).alias("stage"), F.col("ord.seq").alias("seq"), F.col("ord.tie").alias("tie")))
    return left.unionByName(later.select(*left.columns))
