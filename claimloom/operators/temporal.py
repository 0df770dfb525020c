"""Projection, slices in both time dimensions and decay. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import point
from ..schema import DAY_MS
from .predicates import valid_at


def pi(claims: DataFrame, fields: list[str]) -> DataFrame:
    """Keep the named fields, and the read order."""
    return claims.select(*fields, *(["ord"] if "ord" in claims.columns and "ord" not in fields else []))


def tau_valid(claims: DataFrame, t: int) -> DataFrame:
    return claims.where(valid_at(t))


def tau_recorded(claims: DataFrame, t: int) -> DataFrame:
    return claims.where(F.col("recorded") <= t)


def tau_known(claims: DataFrame, t: int) -> DataFrame:
    return tau_recorded(tau_valid(claims, t), t)


def tau_now(claims: DataFrame, now: int) -> DataFrame:
    return tau_known(claims, now)


#: Half-lives in days by kind of source.
SOURCE_HALF_LIVES = {"manual": 180, "verification": 90, "workflow": 60, "heuristic": 30, "llm": 14, "imported": 60}


def none() -> dict:
    return {"kind": "none"}


def exponential(half_life_days: float) -> dict:
    return {"kind": "exponential", "half_life_days": half_life_days}


def linear(rate_per_day: float) -> dict:
    return {"kind": "linear", "rate_per_day": rate_per_day}


def step(threshold_days: float) -> dict:
    return {"kind": "step", "threshold_days": threshold_days}


def multiplier(policy: dict, age_ms: Column) -> Column:
    days = age_ms / F.lit(float(DAY_MS))
    match policy["kind"]:
        case "none":
            return F.lit(1.0)
        case "exponential":
            return F.pow(F.lit(0.5), days / policy["half_life_days"])
        case "linear":
            return F.greatest(F.lit(0.0), 1 - policy["rate_per_day"] * days)
        case "step":
            return F.when(days >= policy["threshold_days"], 0.0).otherwise(1.0)
    raise ValueError(f"unknown decay policy {policy!r}")


def delta(claims: DataFrame, policy: dict, now: int) -> DataFrame:
    """effective = point estimate x multiplier of the age since recording. Applied twice, the last one holds."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("recorded"))
    return claims.withColumn("effective", point() * multiplier(policy, age))


def suppress(claims: DataFrame, floor: float, half_life_ms: float, now: int) -> DataFrame:
    """Keep claims whose unclamped exponential decay is at least ``floor``."""
    age = F.lit(now) - F.col("recorded")
    return claims.where(point() * F.pow(F.lit(0.5), age / half_life_ms) >= floor)
