"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are cut into blocks and queries into blocks; each pair of blocks is one task's work. Inside it every
dimension is a list of the vectors sorted by their component, read from the top for queries with a positive
component there and from the bottom for negative ones. All lists are read in step, some rows at a time. What was
read adds up to partial sums; the last value read in each list bounds what a vector may still add, the list's far
end bounds it from below. A vector that cannot reach the k-th lower bound of a query is dropped for it, one that no query
needs any more is read no further. A query stops once few are left, and these get their final
scores. Each block returns its k best for each query, and a partial aggregate merges the blocks.

The work is queries x vectors by definition of the search; memory is that of two blocks, whose rows shrink as vectors
get wider. Scaled components travel as integers of 32 bits where all fit, else as doubles. Nothing is broadcast.

Components are scaled and floored to integers. Vectors that are null, or hold null or non-finite components, take
no part. Shorter vectors are padded with zeros. Ties go to the smaller id; a candidate with the query's own id is
skipped. Rows that repeat id and vector are one query, but each a candidate; rows that repeat an id with another vector are queries of
their own, each with its ranks from 1. With fewer than k candidates all are returned; an empty table gives
none. Sums beyond 2^53 are added as whole numbers of any size and held to the range of a long.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_BLOCK = 16384
QUERY_BLOCK = 16384
#: Numbers of one block of vectors.
BLOCK_CELLS = 1 << 20
#: Queries that are taken at a time inside a task.
AT_ONCE = 256
DEPTHS = (0.2, 0.45, 0.7, 1.0)
_FOUND = pa.schema([("nth", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: list, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


class Lists:
    """A block's vectors with, for every dimension, their list sorted from the largest component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids, self.entries = vectors, ids, 0
        n, width = vectors.shape
        self.order = np.argsort(-vectors, axis=0, kind="stable")
        self.rank = np.empty((n, width), np.int32)  # how deep in its list each value is met
        np.put_along_axis(self.rank, self.order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.at = np.arange(width)

    def value_at(self, depth: int) -> np.ndarray:
        return self.vectors[self.order[depth], self.at]


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vector_ids: np.ndarray, k: int, lists: Lists | None = None) -> list[tuple[int, int, int, int]]:
    """For each query its k best vectors of the block as (position, query, vector, score), read from sorted lists."""
    if not len(vectors):
        return []
    lists = lists or Lists(vectors, vector_ids)
    return [x for first in range(0, len(queries), AT_ONCE) for x in _search(first, queries[first : first + AT_ONCE], query_ids[first : first + AT_ONCE], lists, k)]


def _search(first: int, queries: np.ndarray, query_ids: np.ndarray, lists: Lists, k: int) -> list[tuple[int, int, int, int]]:
    """Rounds for all queries at once; ``entries`` counts what is read of lists for a query and what final scores multiply."""
    vectors, ids = lists.vectors, lists.ids
    n, width = vectors.shape
    top, bottom = lists.value_at(0), lists.value_at(n - 1)
    sides = np.hstack((np.maximum(queries, 0), np.minimum(queries, 0))).T.astype(np.float32)
    # bounds in single precision, with room for what it rounds
    slack = (4 * width + 8) * 2.0**-23 * np.abs(vectors).max() * np.abs(queries).sum(axis=1)
    rows, active, found = np.arange(n), np.arange(len(queries)), []
    mine, had = ids[:, None] != query_ids[None, :], np.zeros(n, np.int64)  # what may still be among a query's best; entries read by vector
    for depth in DEPTHS:
        stop = n if depth == 1.0 else max(1, int(n * depth))
        own, rank = vectors[rows], lists.rank[rows]
        begin, end = rank < stop, rank >= n - stop
        side = lambda up, down: np.hstack((np.where(begin, own, up), np.where(end, own, down))).astype(np.float32) @ sides[:, active]  # noqa: B023, E731
        lower = side(bottom, top)  # what was not read adds its list's far end at least
        lower[~mine] = -np.inf
        bar = np.partition(lower, max(0, len(rows) - k), axis=0)[max(0, len(rows) - k)] - 2 * slack[active]
        may = (side(lists.value_at(stop - 1), lists.value_at(n - stop)) >= bar) & mine  # and its list's frontier at most
        now = (begin | end).sum(axis=1)
        lists.entries += int((now - had[rows]) @ mine.sum(axis=1))
        had[rows] = now
        done = (may.sum(axis=0) <= 4 * k) | (stop == n)
        for c in np.flatnonzero(done):
            left = rows[may[:, c]]
            exact = vectors[left] @ queries[active[c]]  # final scores of those that remain
            lists.entries += len(left) * width
            best = np.lexsort((ids[left], -exact))[:k]
            found += [(first + int(active[c]), int(query_ids[active[c]]), int(ids[left[i]]), int(exact[i])) for i in best]
        active, mine = active[~done], may[:, ~done]
        if not len(active):
            break
        wanted = mine.any(axis=1)  # vectors that no query needs any more are dropped for good
        rows, mine = rows[wanted], mine[wanted]
    return found


def search_exactly(queries, query_ids, vectors, vector_ids, k) -> list[tuple[int, int, int, int]]:
    """The same for integers of any size."""
    most = (1 << 63) - 1
    whole = [[int(x) for x in v] for v in vectors]
    found = []
    for nth, (q, own) in enumerate(zip(queries, query_ids)):
        q = [int(x) for x in q]
        scores = [(-max(-most, min(most, sum(a * b for a, b in zip(q, v)))), int(i)) for v, i in zip(whole, vector_ids) if i != own]
        found += [(nth, int(own), i, -s) for s, i in sorted(scores)[:k]]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k best: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where("id is not null and v is not null and size(v) > 0").where(F.forall("v", finite))
    largest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))) * abs(scale) + 1
    size = usable.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("width"), F.max(largest).alias("largest")).first()
    small = (size.largest or 0) < 2**31
    # as the contract has it: the floor of the scaled component, in doubles
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int")) if small else F.col("v")
    usable = usable.select("id", whole.alias("v"), "q")
    most = max(256, min(VECTOR_BLOCK, BLOCK_CELLS // max(1, size.width or 1)))
    spread = ceil(size.n / (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))  # small tables still make enough tasks
    query_blocks, vector_blocks = max(1, ceil(size.q / QUERY_BLOCK)), max(1, ceil(size.n / min(most, max(1024, spread))))
    block = lambda of: F.pmod(F.xxhash64("id", "v"), F.lit(of)).cast("int")
    dealt = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = usable.where("q").select("id", "v").distinct().select("id", "v", F.xxhash64("v").alias("h"), block(query_blocks).alias("qb")).withColumn("vb", dealt(vector_blocks))
    others = usable.select("id", "v", block(vector_blocks).alias("vb")).withColumn("qb", dealt(query_blocks))
    schema = pa.schema([("h", pa.int64()), *((f.name, f.type) for f in _FOUND if f.name != "nth")])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        hashes = left.column("h").to_pylist()
        if left.num_rows and right.num_rows:
            q, v = left.column("v").to_pylist(), right.column("v").to_pylist()
            width = max(map(len, (*q, *v)))
            q, v = _matrix(q, width), _matrix(v, width)
            if not small:
                with np.errstate(over="ignore"):
                    q, v = np.floor(scale * q), np.floor(scale * v)
            q_ids, v_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            safe = np.isfinite(q).all() and np.isfinite(v).all() and np.abs(q).max() * np.abs(v).max() * width < 2.0**52
            if safe:
                rows = search_block(q, q_ids, v, v_ids, k)
            else:
                rows = search_exactly(np.nan_to_num(q), q_ids, np.nan_to_num(v), v_ids, k)
        found = [(hashes[nth], *x) for nth, *x in rows]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, schema.types)], schema=schema)

    found = queries.groupBy("qb", "vb").cogroup(others.groupBy("qb", "vb")).applyInArrow(search, "h long, query_id long, vec_id long, score long")
    # k rows for each query and block
    best = found.groupBy("query_id", "h").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))).alias("all"))
    return best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
