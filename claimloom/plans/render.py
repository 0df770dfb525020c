"""Query results as lines of text for a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import point

NUMBERS = ("n", "value", "text", "alpha", "beta")


def claim_line() -> Column:
    """``subject key = value  [status p=0.900]``."""
    return F.concat_ws(
        "", "subject", F.lit(" "), "key", F.lit(" = "), F.coalesce("value_json", F.lit("null")), F.lit("  ["), "status", F.lit(" p="), F.coalesce(F.format_string("%.3f", point()), F.lit("none")), F.lit("]")
    )


def lines(result: DataFrame) -> DataFrame:
    """A result as rows (line): a composed text as it is, groups as ``key: numbers``, claims one by one, anything else as JSON.

    Ranked claims come by rank, other claims in their order, groups by key.
    """
    have = set(result.columns)
    if "content" in have:
        return result.select(F.col("content").alias("line"))
    if "subject" in have and "value_json" in have:
        order = ([F.desc("score")] if "score" in have else []) + (["ord"] if "ord" in have else ["subject", "key"])
        return result.orderBy(*order).select(claim_line().alias("line"))
    numbers = [c for c in result.columns if c in NUMBERS]
    if numbers:
        shown = numbers[:1] if len(numbers) == 1 else numbers
        text = F.concat_ws(" ", *(F.col(c).cast("string") if len(shown) == 1 else F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in shown))
        if "group_key" in have:
            return result.orderBy("group_key").select(F.concat(F.col("group_key"), F.lit(": "), text).alias("line"))
        return result.select(text.alias("line"))
    return result.select(F.to_json(F.struct(*result.columns)).alias("line"))
