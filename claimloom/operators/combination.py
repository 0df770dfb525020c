"""Combination of beliefs: one survivor per group, or per cluster of similar values.

Weighted averages and pooled evidence are sums, so groups of any size aggregate partially. Only Dempster's rule needs
the members in order. In similarity mode, groups are cut by single-link clustering. A group that fits one task is
clustered there, so each value is shuffled once and nothing iterates. Larger groups are cut into blocks: each pair of
blocks is compared in a task of its own and gives no more links than it has members, which connected components join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.confidence import check_rule
from ..schema import CLAIM_COLUMNS, TRIPLE, order_of
from .contradiction import pooled
from .graph import components, settled

#: What one task compares at a time: members, and characters of all their values.
BLOCK_MEMBERS, BLOCK_CHARS = 2_000, 4_000_000
MAX_RULES = ("max_mean", "max_concentration")


def _winner(rule: str) -> Column:
    """What the representative of a max rule is chosen by: the largest wins, the smallest id on ties."""
    mean = F.coalesce(F.col("alpha") / (F.col("alpha") + F.col("beta")), F.col("p"))
    size = F.coalesce(F.col("alpha") + F.col("beta"), F.lit(0.0))
    return mean if rule == "max_mean" else size


def _combined(rows: DataFrame, group: list[str], rule: str, representative: list[Column]) -> DataFrame:
    """One row per group: the representative's columns with the group's combined confidence, and members."""
    rule = check_rule(rule)
    order = [F.desc("_by"), F.asc("id")] if rule in MAX_RULES else representative
    rows = rows.withColumn("_by", _winner(rule))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r", "_by")
    if rule in MAX_RULES:
        sizes = rows.groupBy(*group).agg(F.count("*").alias("members"), F.min("ord").alias("_first"))
        return first.join(sizes, group)
    pool = pooled(rule)
    sums = rows.groupBy(*group).agg(F.count("*").alias("members"), F.min("ord").alias("_first"), *(c.alias(f"_{k}") for k, c in pool.items()))
    out = first.join(sums, group).withColumns({k: F.col(f"_{k}") for k in pool}).drop(*(f"_{k}" for k in pool))
    return out.withColumn("raw", F.when(F.col("members") > 1, F.coalesce(F.col("alpha") / (F.col("alpha") + F.col("beta")), F.col("p"))).otherwise(F.col("raw")))


def similar_pairs(claims: DataFrame, cutoff: float, fn: str) -> DataFrame:
    """Pairs (a, b) that link what is alike without comparing values: equal values, or all of a (subject, key, scope)."""
    same = [*TRIPLE, "value_json"] if fn == "exact" else list(TRIPLE)
    rows = claims.select("id", *same)
    hub = rows.groupBy(*same).agg(F.min("id").alias("b"))
    return rows.withColumnRenamed("id", "a").join(hub, same).where("a <> b").select("a", "b")


def _clusters(cutoff: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by group: (node, component) of what hangs together in each; with two sides, only pairs across count."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # few texts are Python objects at a time
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True)

    def cluster(members: Iterator[tuple]) -> Iterator[tuple[str, str]]:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def link(a: str, b: str) -> None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a

        sets: dict[tuple[int, frozenset], str] = {}
        for _, side, node, words in members:
            parent.setdefault(node, node)
            link(node, sets.setdefault((side, frozenset(words.split())), node))
        seen: list[tuple[int, frozenset, str]] = []
        across = len({side for side, _ in sets}) > 1
        for (side, own), node in sets.items():
            for other_side, other, rep in seen:
                if across and side == other_side or root(node) == root(rep):
                    continue
                if not own and not other:
                    link(node, rep)
                elif min(len(own), len(other)) / max(len(own), len(other)) >= cutoff:
                    both = len(own & other)
                    if both / (len(own) + len(other) - both) >= cutoff:
                        link(node, rep)
            seen.append((side, own, node))
        tops = {x: root(x) for x in parent}
        wide = {top for x, top in tops.items() if x != top}
        return ((x, top) for x, top in tops.items() if top in wide)

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str]] = []
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["node", "component"])
        for _, members in groupby(rows(batches), key=itemgetter(0)):
            out.extend(cluster(members))
            if len(out) >= 10_000:
                yield send()
                out.clear()
        if out:
            yield send()

    return clusters


def _clustered(rows: DataFrame, group: list[str], side: Column, cutoff: float) -> DataFrame:
    """``rows``: id, words and the columns of ``group``."""
    dealt = rows.select(F.struct(*group).alias("g"), side.cast("int").alias("side"), "id", "words").repartition("g").sortWithinPartitions("g")
    text = dealt.select(F.to_json("g").alias("g"), "side", "id", "words")
    return text.mapInArrow(_clusters(cutoff), "node string, component string")


def similar_groups(claims: DataFrame, cutoff: float, fn: str = "jaccard") -> DataFrame:
    """The clusters of similar values in one (subject, key, scope), as rows (node, component), written; what stands alone has no row."""
    if not 0 <= cutoff <= 1:
        raise ValueError("the cutoff must be in [0, 1]")
    if fn not in ("exact", "jaccard"):
        raise ValueError(f"no pairs for similarity {fn!r}")
    if fn == "exact" or cutoff == 0:
        return components(similar_pairs(claims, cutoff, fn))
    usable = claims.select("id", *TRIPLE, "value_text").where(" and ".join(f"{c} is not null" for c in ("id", *TRIPLE, "value_text")))
    sizes = usable.groupBy(*TRIPLE).agg(F.count("*").alias("n"), F.sum(F.length("value_text")).alias("chars"))
    large = settled(sizes.where((F.col("n") > BLOCK_MEMBERS) | (F.col("chars") > BLOCK_CHARS) & (F.col("n") > 1)).select(*TRIPLE), "large")
    rows = usable.select("id", *TRIPLE, F.array_join(V.tokens(F.col("value_text")), " ").alias("words"))
    if large.isEmpty():
        return _one_label(settled(_clustered(rows, list(TRIPLE), F.lit(0), cutoff), "similar"))
    small = _clustered(rows.join(large, list(TRIPLE), "left_anti"), list(TRIPLE), F.lit(0), cutoff)
    ordered = F.array_join(F.array_sort(F.split("words", " ")), " ")
    big = rows.join(large, list(TRIPLE)).withColumn("words", ordered).withColumn("digest", F.sha2("words", 256))
    one = settled(big.groupBy(*TRIPLE, "digest").agg(F.min("id").alias("id"), F.min("words").alias("words")), "distinct")
    copies = big.select(F.col("id").alias("node"), *TRIPLE, "digest").join(one.select(F.col("id").alias("component"), *TRIPLE, "digest"), [*TRIPLE, "digest"])
    parts = one.groupBy(*TRIPLE).agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum(F.length("words")) / BLOCK_CHARS)).alias("parts"))
    blocks = one.join(parts, list(TRIPLE)).withColumn("side", F.pmod(F.xxhash64("digest"), F.col("parts")))
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    met = met.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    links = _clustered(met, [*TRIPLE, "low", "high"], F.col("side"), cutoff).unionByName(copies.select("node", "component"))
    joined = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return _one_label(settled(small.unionByName(joined), "similar"))


def _one_label(found: DataFrame) -> DataFrame:
    """Clusters of different groups that share an id are one: ids that occur in several groups have several rows."""
    many = found.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("least")).where("n > 1").select("node", "least")
    if many.isEmpty():
        return found
    joined = components(found.join(many, "node").select(F.col("component").alias("a"), F.col("least").alias("b")))
    named = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("label")), "component", "left")
    return settled(named.groupBy("node").agg(F.min(F.coalesce("label", "component")).alias("component")), "similar")


def dedupe(claims: DataFrame, rule: str = "weighted_avg", cutoff: float | None = None, fn: str = "jaccard", weights: dict | None = None, found: DataFrame | None = None) -> DataFrame:
    """One survivor per (subject, key, scope), or per cluster of similar values in it. Adds ``members``.

    ``found``: the clusters, where ``similar_groups`` has made them already.
    """
    if cutoff is None:
        out = _combined(claims, list(TRIPLE), rule, [F.asc("ord")])
        return out.withColumn("ord", F.col("_first")).drop("_first")
    found = similar_groups(claims, cutoff, fn) if found is None else found
    rows = claims.join(found, claims["id"] == found["node"], "left").withColumn("_cluster", F.coalesce("component", "id")).drop("node", "component")
    out = _combined(rows, ["_cluster"], rule, [F.desc("valid_from"), F.asc("id")])
    groups = rows.groupBy(*TRIPLE).agg(F.min("ord").alias("_group"))
    out = out.join(groups, list(TRIPLE))
    return out.withColumn("ord", order_of(0, F.col("_group.seq"), F.concat_ws("|", F.col("_group.tie"), "_cluster"))).drop("_first", "_group", "_cluster")


def merged_into(claims: DataFrame, survivors: DataFrame, cutoff: float | None = None, fn: str = "jaccard", found: DataFrame | None = None) -> DataFrame:
    """Rows (member_id, survivor_id) for claims that a survivor absorbed."""
    if cutoff is None:
        kept = survivors.select(*TRIPLE, F.col("id").alias("survivor_id"))
        return claims.select(F.col("id").alias("member_id"), *TRIPLE).join(kept, list(TRIPLE)).where("member_id <> survivor_id").select("member_id", "survivor_id")
    found = similar_groups(claims, cutoff, fn) if found is None else found
    named = claims.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c"))
    kept = named.join(survivors.select("id"), "id", "left_semi").select("c", F.col("id").alias("survivor_id"))
    return named.join(kept, "c").where("id <> survivor_id").select(F.col("id").alias("member_id"), "survivor_id")


def synthesize_as(claims: DataFrame, subject: str, key: str, rule: str = "weighted_avg", by: list[str] | None = None) -> DataFrame:
    """All claims (of each ``by`` group) folded into one: first claim's value and scope, all evidence, combined confidence."""
    by = by or []
    rows = claims.withColumn("_all", F.lit(1))
    group = by or ["_all"]
    out = _combined(rows, group, rule, [F.asc("ord")])
    evidence = rows.select(*group, F.explode("evidence").alias("e")).distinct().groupBy(*group).agg(F.collect_list("e").alias("_evidence"))
    out = out.join(evidence, group, "left").withColumn("evidence", F.coalesce("_evidence", "evidence"))
    named = out.withColumn("id", F.concat(F.lit("synth-"), F.substring(F.sha2(F.concat_ws("|", F.lit(subject), F.lit(key), *group), 256), 1, 24)))
    keep = [c for c in CLAIM_COLUMNS if c in out.columns]
    renamed = {} if by else {"subject": F.lit(subject), "key": F.lit(key)}
    return named.withColumns(renamed | {"source": F.lit("workflow")}).select(*keep, "members")
