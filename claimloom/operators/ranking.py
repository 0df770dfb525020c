"""Similarity and ranking.

A ranked frame has ``score`` and is read by (score descending, ord). With ``ordered=False`` operators add the score and
leave rows where they are, so that a chain of them costs no shuffle: what reads the order (``top_k``, a composed text,
``ranked`` at the end of a query) sorts. Plans and registered queries do so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..schema import DAY_MS

SimilarityFn = Callable[[object], Column]


class NoSimilarity(KeyError):
    """No similarity function of that name."""


def _text(query) -> str:
    return query if isinstance(query, str) else V.canonical(query)


def jaccard(query) -> Column:
    wanted = V.python_tokens(_text(query))
    own = V.tokens(F.col("value_text"))
    if not wanted:
        return F.when(F.col("value_text").isNotNull(), F.when(F.size(own) == 0, 1.0).otherwise(0.0))
    query_set = F.array(*map(F.lit, wanted)).cast("array<string>")
    sizes = lambda t: F.struct(F.size(t).alias("own"), F.size(F.array_intersect(t, query_set)).alias("both"))
    return V.let(V.let(own, sizes), lambda n: n["both"] / (n["own"] + len(wanted) - n["both"]))


def exact(query) -> Column:
    return F.when(F.col("value_json") == V.canonical(query), 1.0).otherwise(0.0)


_registry: dict[str, SimilarityFn] = {"jaccard": jaccard, "exact": exact}


def similarity(name: str) -> SimilarityFn:
    if name not in _registry:
        raise NoSimilarity(f'no similarity fn "{name}"')
    return _registry[name]


def register_similarity(name: str, fn: SimilarityFn) -> None:
    if _registry.get(name, fn) is not fn:
        raise ValueError(f'similarity fn "{name}" is registered with another implementation')
    _registry[name] = fn


def cosine(a: Column, b: Column) -> Column:
    """(1 + cos) / 2 in double arithmetic; two zero vectors are alike (1), one zero vector says nothing (0.5)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.5).otherwise((1 + dot(a, b) / F.sqrt(na * nb)) / 2)


def cosine_over(vector: str, query: list[float]) -> SimilarityFn:
    """Similarity by a column of embeddings; a claim without one raises, as an uncached embedding."""
    missing = F.raise_error(F.lit("a value has no embedding")).cast("array<double>")
    return lambda _=None: cosine(F.coalesce(F.col(vector).cast("array<double>"), missing), F.array(*(F.lit(float(x)) for x in query)))


def hybrid_max(a: SimilarityFn, b: SimilarityFn) -> SimilarityFn:
    """The larger of two; one that is no finite number gives way to the other."""
    finite = lambda c: F.when(F.abs(c) != float("inf"), F.nanvl(c, F.lit(None).cast("double")))
    return lambda q: F.coalesce(F.greatest(finite(a(q)), finite(b(q))), F.lit(float("nan")))


def ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), "ord")


def _scored(claims: DataFrame, score: Column, ordered: bool) -> DataFrame:
    rows = claims.withColumn("score", score)
    return ranked(rows) if ordered else rows


def rho(claims: DataFrame, name: str, query, ordered: bool = True) -> DataFrame:
    return _scored(claims, similarity(name)(query), ordered)


def rho_by(claims: DataFrame, fn: SimilarityFn, query, ordered: bool = True) -> DataFrame:
    return _scored(claims, fn(query), ordered)


def recency(half_life_days: float, now: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(now) - F.col("valid_from"))
    return F.pow(F.lit(0.5), age / F.lit(float(half_life_days) * DAY_MS))


def rank_blend(claims: DataFrame, fn: SimilarityFn, query, now: int, alpha: float = 0.5, half_life_days: float = 90, ordered: bool = True) -> DataFrame:
    """alpha x similarity + (1 - alpha) x recency of valid_from; what is valid from the future on has age 0."""
    if not 0 <= alpha <= 1 or half_life_days <= 0:
        raise ValueError("alpha must be in [0, 1] and the half-life above 0")
    return _scored(claims, alpha * fn(query) + (1 - alpha) * recency(half_life_days, now), ordered)


def rank_blend_confidence(claims: DataFrame, query, now: int, w_sim: float, w_rec: float, w_conf: float, half_life_days: float = 90, ordered: bool = True) -> DataFrame:
    from ..functions.confidence import point

    return _scored(claims, w_sim * jaccard(query) + w_rec * recency(half_life_days, now) + w_conf * point(), ordered)


def relevance_floor(rows: DataFrame, least: float) -> DataFrame:
    if not 0 <= least <= 1:
        raise ValueError("the floor must be in [0, 1]")
    return rows.where(F.col("score") >= least)


def abstain_below_top(rows: DataFrame, least: float) -> DataFrame:
    """Nothing at all if the best score is below ``least``."""
    if not 0 <= least <= 1:
        raise ValueError("the least top score must be in [0, 1]")
    top = rows.agg(F.max("score").alias("top")).where(F.col("top") >= least).select(F.lit(True).alias("answer"))
    return rows.join(F.broadcast(top)).drop("answer")  # one row or none


def top_k(rows: DataFrame, k: int = 5) -> DataFrame:
    return ranked(rows).limit(k)
