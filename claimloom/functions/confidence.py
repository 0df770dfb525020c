"""Confidences as columns: Beta distributions, scalars, subjective-logic opinions and source trust."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prior: weight and base rate.
PRIOR_W, PRIOR_A = 2.0, 0.5
#: How far each kind of source is trusted.
SOURCE_WEIGHTS = {"manual": 1.3, "verification": 1.2, "workflow": 1.0, "heuristic": 0.9, "llm": 0.7, "imported": 0.6}
#: From this conflict on, Dempster's rule has no answer.
TOTAL_CONFLICT = 1 - 1e-4


class TotalConflict(ValueError):
    """Two opinions contradict each other completely."""


class RemovedRule(ValueError):
    """A rule that existed once and has no meaning now."""


class UnsupportedRule(ValueError):
    """A rule that the distribution does not have."""


BETA_RULES = ("weighted_avg", "evidence_pooled", "max_mean", "max_concentration", "dempster")
SCALAR_RULES = ("weighted_avg", "max_mean", "max_concentration")


def check_rule(rule: str) -> str:
    name = rule.removeprefix("rule_")
    if name == "max_confidence":
        raise RemovedRule("rule_max_confidence was split into rule_max_mean and rule_max_concentration")
    if name not in BETA_RULES:
        raise UnsupportedRule(f"unknown rule {rule!r}")
    return name


class UnknownDistribution(KeyError):
    """No distribution of that name."""


@dataclass(frozen=True)
class Distribution:
    """What a kind of confidence needs: the columns that hold its parameters, its mean and its variance over them."""

    fields: tuple[str, ...]
    mean: Callable[[Callable[[str], Column]], Column]
    variance: Callable[[Callable[[str], Column]], Column]


_DISTRIBUTIONS = {
    "beta": Distribution(("alpha", "beta"), lambda c: mean(c("alpha"), c("beta")), lambda c: variance(c("alpha"), c("beta"))),
    "scalar": Distribution(("p",), lambda c: c("p"), lambda c: F.lit(0.0)),
}


def distribution(name: str) -> Distribution:
    if name not in _DISTRIBUTIONS:
        raise UnknownDistribution(f"no distribution {name!r}")
    return _DISTRIBUTIONS[name]


def _by_distribution(of: Callable[[Distribution], Column], dist: Column) -> Column:
    """The expression of each row's distribution; an unknown name raises when it is met, no name gives null."""
    unknown = F.raise_error(F.concat(F.lit("no distribution "), dist)).cast("string")
    out = F.when(dist.isNotNull() & ~dist.isin(*_DISTRIBUTIONS), unknown)
    for name, d in _DISTRIBUTIONS.items():
        out = out.when(dist == name, of(d).cast("string"))
    return out


def serialized_params(c=F.col) -> Column:
    """A confidence's parameters as JSON text."""
    return _by_distribution(lambda d: F.to_json(F.struct(*(c(f).alias(f) for f in d.fields))), c("dist"))


def deserialized_params(text: Column) -> Column:
    """Such a text as struct(alpha, beta, p)."""
    return F.from_json(text, "alpha double, beta double, p double")


def spread(c=F.col) -> Column:
    """The variance of each row's distribution."""
    return _by_distribution(lambda d: d.variance(c), c("dist")).cast("double")


def point(c=F.col) -> Column:
    return F.when(c("dist") == "beta", _DISTRIBUTIONS["beta"].mean(c)).otherwise(_DISTRIBUTIONS["scalar"].mean(c))


def effective(c=F.col) -> Column:
    return F.coalesce(c("effective"), point(c))


def mean(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def variance(alpha: Column, beta: Column) -> Column:
    n = alpha + beta
    return alpha * beta / (n * n * (n + 1))


def source_weight(source: Column, weights: dict[str, float] | None = None) -> Column:
    known = SOURCE_WEIGHTS | (weights or {})
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source), F.lit(1.0))


def beta_to_opinion(alpha: Column, beta: Column, w: float = PRIOR_W, a: float = PRIOR_A) -> Column:
    """struct(b, d, u): belief, disbelief, uncertainty."""
    r, s = alpha - a * w, beta - (1 - a) * w
    total = r + s + w
    return F.struct((r / total).alias("b"), (s / total).alias("d"), (F.lit(w) / total).alias("u"))


def opinion_to_beta(b: Column, d: Column, u: Column, w: float = PRIOR_W, a: float = PRIOR_A) -> Column:
    """struct(alpha, beta); an opinion without uncertainty has no Beta and raises."""
    sure = F.when(u > 0, u).otherwise(F.raise_error(F.lit("a dogmatic opinion (u = 0) has no Beta distribution")).cast("double"))
    return F.struct((b * w / sure + a * w).alias("alpha"), (d * w / sure + (1 - a) * w).alias("beta"))


def projected(b: Column, u: Column, a: float = PRIOR_A) -> Column:
    return b + a * u


def scalar_to_beta(p: Column, pseudocount: float, w: float = PRIOR_W, a: float = PRIOR_A) -> Column:
    return F.struct((p * pseudocount + a * w).alias("alpha"), ((1 - p) * pseudocount + (1 - a) * w).alias("beta"))


def beta_from_raw(raw: Column, concentration: Column) -> Column:
    return F.struct((raw * concentration).alias("alpha"), ((1 - raw) * concentration).alias("beta"))


def extend_to_frame(alpha: Column, beta: Column, base: list[float], w: float = PRIOR_W, a: float = PRIOR_A) -> Column:
    """A Beta on the first of several outcomes as a Dirichlet over all, by their base rates."""
    r, s = alpha - a * w, beta - (1 - a) * w
    rest = 1 - base[0]
    others = [(s * (x / rest) if rest else F.lit(0.0)) + w * x for x in base[1:]]
    return F.array(r + w * base[0], *others)


def wilson_lower(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval; 0 without trials."""
    p = successes / n
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n <= 0, 0.0).otherwise(low)


def lower_bound(alpha: Column, beta: Column, z: float = 1.645) -> Column:
    return mean(alpha, beta) - z * F.sqrt(variance(alpha, beta))


def fold_dempster(members: Column) -> Column:
    """Dempster's rule over an ordered array of struct(alpha, beta): struct(alpha, beta). Total conflict raises."""

    def step(state: Column, m: Column) -> Column:
        o = beta_to_opinion(m["alpha"], m["beta"])
        conflict = state["b"] * o["d"] + state["d"] * o["b"]
        rest = F.when(conflict < TOTAL_CONFLICT, 1 - conflict).otherwise(F.raise_error(F.lit("total conflict between opinions")).cast("double"))
        return F.struct(
            ((state["b"] * o["b"] + state["b"] * o["u"] + state["u"] * o["b"]) / rest).alias("b"),
            ((state["d"] * o["d"] + state["d"] * o["u"] + state["u"] * o["d"]) / rest).alias("d"),
            (state["u"] * o["u"] / rest).alias("u"),
        )

    vacuous = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("d"), F.lit(1.0).alias("u"))
    return F.aggregate(members, vacuous, step, lambda s: opinion_to_beta(s["b"], s["d"], s["u"]))
