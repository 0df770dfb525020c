"""Exact n-gram Jaccard self-join by size-aware heavy-light processing.

A document is the set of its distinct word shingles (64-bit hashes of ``width`` words; of all words if there are
fewer). Two documents link when |A n B| / |A u B| >= num / den. The steps:

1. *Classes.* Documents with equal sets become one class, by a digest and a partial aggregate: a hot text costs one
   row per task, and only one document of a class goes on. Frequent shingles are gathered on the way, as counts of what
   each task sees often.
2. *Light sets* (size up to a boundary). For each possible partner size the smallest overlap that links is known;
   all subsets of that size are enumerated, and sets that link share one.
3. *Heavy sets* go to inverted lists. All shingles stand in one global order, rarest first: first the hash region
   for which document frequencies are counted exactly, then the rest of the hash range, then the frequent ones.
   Linked sets share a shingle among the first n - ceil(t n) + 1 of each. Lists are scanned in buckets of the hash
   range and shipped as packed arrays. A document with enough shingles of its own needs no list at all. The list of a
   frequent shingle never meets in one bucket: its entries are dealt by document.
4. *Verification.* What shares a list or a subset, and has about the same size, forms a bundle; the whole sets of a
   bundle meet and each overlap is counted through the bundle's inverted lists. Bundles are cut into blocks by their
   cost (the pairs that meet in lists) and by ``block_items`` shingles, and each pair of blocks is one task's work, so
   that no task or group is unbounded and no link is lost.

The boundary between light and heavy is where the estimated rows of either way, over the sizes that occur, add up
to the least. The frequent-shingle list has at most ``FREQUENT`` entries by its threshold (all shingles / FREQUENT), so it can be
broadcast; the bitmaps of representatives and of bundled ids have at most 2^24 bits (what else they let through is
found out by a join).

Null and empty texts have no shingles and link with nothing: each is its own component. Rows that repeat an id are
one document to the links; each row gets its answer. A null id has a null component. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written
from .texthash import _SALT, U, chunks, mix, shingle_sets
from .worker import release, slices

REGION = 0.25
FREQUENT = 1 << 18
BUCKET_ITEMS = 1_000_000
MOST_COUNTED = 1_000_000
BLOCK_COST = 20_000_000
_LIMIT = U(int(REGION * 2.0**64))


def least_overlap(n: int, m: int, num: int, den: int) -> int:
    """The smallest overlap with which sets of n and m items link."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n, num: int, den: int):
    """How many of a set's first shingles any linked set must meet."""
    return n - (num * n + den - 1) // den + 1


def partner_sizes(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def light_cost(n: int, num: int, den: int) -> int:
    return sum(comb(n, o) for m in partner_sizes(n, num, den) if (o := least_overlap(n, m, num, den)) <= min(n, m))


def light_boundary(sizes: dict[int, int], num: int, den: int, most: int = 40) -> int:
    """The largest size treated as light, such that the rows of both ways together are fewest.

    A heavy set costs its region entries, its prefix with lists of about four and its whole set once.
    """
    best, boundary, total = 0, 0, 0
    for n in range(1, most + 1):
        heavy = REGION * n + 5 * prefix_length(n, num, den) + n
        total += sizes.get(n, 0) * (light_cost(n, num, den) - heavy)
        if total <= best and sizes.get(n, 0):
            best, boundary = total, n
    return boundary


def subset_keys(items: np.ndarray, num: int, den: int, most: int) -> np.ndarray:
    """Keys of all fixed-size subsets: two light sets share a key exactly when they link (up to hash collisions)."""
    n, mixed, keys = len(items), mix(items + U(1)), []
    whole = np.add.reduce(mixed, keepdims=True)
    for m in partner_sizes(n, num, den):
        overlap = least_overlap(n, m, num, den)
        if m > most or overlap > min(n, m):
            continue
        left_out = np.array([np.add.reduce(mixed[list(c)]) for c in combinations(range(n), n - overlap)] if n > overlap else [0], np.uint64)
        keys.append(mix((whole - left_out) * _SALT[40] + np.full(1, min(n, m), np.uint64) * _SALT[41] + np.full(1, max(n, m), np.uint64) * _SALT[42]))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids = batch.column(0).to_pylist()
    for first, raws in chunks(batch.column(1).to_pylist()):
        yield ids[first : first + len(raws)], shingle_sets(raws, width)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _digests(width: int):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        often, floor = [np.zeros(0, np.uint64), np.zeros(0, np.int64)], 0
        for batch in slices(batches):
            for ids, sets in _rows(batch, width):
                n = [len(s) for s in sets]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                edge = np.concatenate(([0], np.cumsum(n)))
                a, b = (np.concatenate(([U(0)], np.cumsum(mix(flat ^ _SALT[k]) * _SALT[k + 1], dtype=np.uint64))) for k in (50, 52))
                yield _batch(schema, np.zeros(len(n), np.int32), ids, n, (a[edge[1:]] - a[edge[:-1]]).view(np.int64), (b[edge[1:]] - b[edge[:-1]]).view(np.int64))
                seen, count = np.unique(flat, return_counts=True)
                often = [np.concatenate((often[0], seen)), np.concatenate((often[1], count))]
                if len(often[0]) > MOST_COUNTED:
                    often = _summed(*often)
                    while len(often[0]) > MOST_COUNTED // 2:  # what was rare so far is forgotten, as nothing rests on exact counts
                        floor += 1
                        often = [x[often[1] > floor] for x in often]
        seen, count = _summed(*often)
        keep = count >= max(8, int(count.sum()) >> 14)
        k = int(keep.sum())
        yield _batch(schema, np.ones(k, np.int32), pa.nulls(k, pa.int64()), count[keep], seen[keep].view(np.int64), np.zeros(k, np.int64))
        release()

    return digests, "kind int, doc_id long, n long, a long, b long"


def _summed(items: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    if not len(items):
        return [items, counts]
    order = np.argsort(items)
    items = items[order]
    first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    return [items[first], np.add.reduceat(counts[order], first)]


REGION_ENTRY, LISTED, SUBSET, SPREAD = 0, 1, 2, 3
_ENTRY = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("docs", "gap", "cnt", "items"))])
_ENTRY_SQL = "bucket long, kind int, docs binary, gap binary, cnt binary, items binary"


def _entries(width: int, num: int, den: int, light: int, buckets: int, shared_frequent):
    """Packed inverted-list entries of each run of documents, by bucket."""
    heavy_from = -(-num * (light + 1) // den)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frequent = shared_frequent.value
        for batch in slices(batches):
            for ids, sets in _rows(batch, width):
                out: dict[int, list] = {REGION_ENTRY: [], LISTED: [], SUBSET: [], SPREAD: []}
                for doc, items in zip(ids, sets):
                    n = len(items)
                    if doc is None or not n:
                        continue
                    if n <= light:
                        out[SUBSET].append((doc, 0, subset_keys(items, num, den, light)))
                    if n >= heavy_from:
                        rare, often = items, items[:0]
                        if len(frequent):
                            at = np.minimum(np.searchsorted(frequent, items), len(frequent) - 1)
                            known = frequent[at] == items
                            rare, often = items[~known], items[known]
                        cut = int(np.searchsorted(rare, _LIMIT))
                        lacking = int(prefix_length(n, num, den)) - cut
                        out[REGION_ENTRY].append((doc, lacking, rare[:cut]))
                        if lacking > 0:
                            more = rare[cut : cut + lacking]
                            out[LISTED].append((doc, lacking, more))
                            if len(more) < lacking:
                                out[SPREAD].append((doc, lacking, often[: lacking - len(more)]))
                for kind, found in out.items():
                    if found:
                        yield from _packed(kind, found, buckets)

    return entries


def _packed(kind: int, found: list, buckets: int) -> Iterator[pa.RecordBatch]:
    docs, gap = (np.array([f[i] for f in found], t) for i, t in ((0, np.int64), (1, np.int32)))
    items = np.concatenate([f[2] for f in found])
    owner = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
    if not len(items):
        return
    to = (items % U(buckets)).astype(np.int64) if kind != SPREAD else (mix(docs.view(np.uint64)) % U(buckets)).astype(np.int64)[owner]
    order = np.argsort(to, kind="stable")
    items, owner, to = items[order], owner[order], to[order]
    run = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (owner[1:] != owner[:-1]))))
    counts, runs = np.diff(np.append(run, len(items))).astype(np.uint32), owner[run]
    edge = np.flatnonzero(np.concatenate(([True], to[run][1:] != to[run][:-1])))
    rows = []
    for i, j in zip(edge, np.append(edge[1:], len(run))):
        stop = run[j] if j < len(run) else len(items)
        who = runs[i:j]
        rows.append((int(to[run[i]]), kind, docs[who].tobytes(), gap[who].tobytes(), counts[i:j].tobytes(), items[run[i] : stop].tobytes()))
    yield _batch(_ENTRY, *zip(*rows))


def _unpacked(table: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in columns]


def _shared(groups: int):
    """Per bucket: the items that two documents have at least, packed by group of documents."""

    def shared(table: pa.Table) -> pa.Table:
        out = []
        for kind in (REGION_ENTRY, LISTED, SUBSET, SPREAD):
            part = table.filter(pa.array(np.asarray(table.column("kind")) == kind))
            docs, gap, cnt, items = _unpacked(part, ("docs", np.int64), ("gap", np.int32), ("cnt", np.uint32), ("items", np.uint64))
            owner = np.repeat(np.arange(len(docs)), cnt)
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            new = np.concatenate(([True], items[1:] != items[:-1])) if len(items) else np.zeros(0, bool)
            df = np.diff(np.append(np.flatnonzero(new), len(items)))
            df = np.repeat(df, df)
            keep = (df >= 2) | (kind == SPREAD)
            items, owner, df = items[keep], owner[keep], df[keep].astype(np.uint32)
            doc = docs[owner] if len(owner) else np.zeros(0, np.int64)
            to = (mix(doc.view(np.uint64)) % U(groups)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.diff(to[order], prepend=-1))
            for at in np.split(order, edge[1:]) if len(order) else []:
                out.append((int(to[at[0]]), kind, doc[at].tobytes(), gap[owner[at]].tobytes(), df[at].tobytes(), items[at].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, _ENTRY.types)], schema=_ENTRY)

    return shared


def _prefixes():
    """Per group of documents: those entries of each that belong to its prefix (gap: its length less the region's items)."""
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64())])

    def prefixes(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        rest = table.filter(pa.array(kinds != REGION_ENTRY))
        other_doc, other_item = _unpacked(rest, ("docs", np.int64), ("items", np.uint64))
        doc, gap, df, item = _unpacked(table.filter(pa.array(kinds == REGION_ENTRY)), ("docs", np.int64), ("gap", np.int32), ("cnt", np.uint32), ("items", np.uint64))
        if len(doc):
            order = np.lexsort((item, df, doc))
            doc, gap, item = doc[order], gap[order], item[order]
            start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            size = np.diff(np.append(start, len(doc)))
            rank = np.arange(len(doc)) - np.repeat(start, size)
            keep = rank < gap + np.repeat(size, size)  # the prefix, less the region's items that no other document has
            doc, item = doc[keep], item[keep]
        return pa.table([np.concatenate((doc, other_doc)), np.concatenate((item, other_item)).view(np.int64)], schema=schema)

    return prefixes, "doc long, item long"


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, its overlap with every set, by scanning the inverted lists of what at least two have."""
    k = len(sets)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    size = np.diff(np.append(start, len(items)))
    group = np.repeat(np.arange(len(start)), size)
    shared = size[group] >= 2
    mine = np.argsort(owner[shared], kind="stable")
    lists = np.split(group[shared][mine], np.cumsum(np.bincount(owner[shared], minlength=k))[:-1])
    for i, own in enumerate(lists):
        length = size[own]
        total = int(length.sum())
        at = np.repeat(start[own] - np.cumsum(length) + length, length) + np.arange(total)
        yield i, np.bincount(owner[at], minlength=k)


def links_in(sets: list[np.ndarray], sides: np.ndarray, across: bool, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the positions of those it links with; ``across``: only those of the other side."""
    sizes = np.array([len(s) for s in sets])
    for i, both in overlaps(sets):
        linked = (den * both >= num * (sizes[i] + sizes - both)) & (both > 0)
        linked[i] = False
        if across:
            linked &= sides != sides[i]
        yield i, np.flatnonzero(linked)


_VERIFIED = pa.schema([("doc", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _verify(num: int, den: int):
    def settle(rows: list, across: bool) -> pa.RecordBatch:
        own = {}
        for r in rows:
            own.setdefault(r[0], r)
        ids, sides, weights = (np.array([r[c] for r in own.values()], np.int64) for c in (0, 1, 2))
        parent = np.arange(len(ids))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = np.zeros(len(ids), np.int64)
        if len(ids) > 1:
            for i, others in links_in([np.frombuffer(r[3], np.uint64) for r in own.values()], sides, across, num, den):
                links[i] = weights[others].sum()
                for other in others[others > i]:
                    x, y = root(i), root(other)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        tops = np.array([root(i) for i in range(len(ids))])
        low = ids.copy()
        np.minimum.at(low, tops, ids)
        return _batch(_VERIFIED, ids, low[tops], links)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bundle, i, j): bundle, i, j, doc, side, weight, items."""
        key, rows = None, []
        for batch in batches:
            for bundle, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bundle, i, j) != key:
                    if len(rows) > 1:
                        yield settle(rows, key[1] != key[2])
                    key, rows = (bundle, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield settle(rows, key[1] != key[2])
        rows.clear()
        release()

    return verify, "doc long, root long, links long"


def _sets(width: int):
    schema = pa.schema([("doc", pa.int64()), ("items", pa.binary())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for ids, sets in _rows(batch, width):
                yield _batch(schema, ids, [s.tobytes() for s in sets])

    return sets_of, "doc long, items binary"


def _among(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of the chosen ids (rows with doc) and, by chance, a few others: a bitmap of at most 2^18 words is broadcast."""
    k = chosen.count()
    bits = 1 << min(24, max(16, (8 * k).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at("doc") % 64).cast("int"))
    bitmap = chosen.groupBy(F.shiftright(at("doc"), 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
    return (
        texts.where("doc_id is not null")
        .withColumn("at", at("doc_id"))
        .join(F.broadcast(bitmap), F.shiftright("at", 6) == F.col("word"))
        .where(F.call_function("shiftright", F.col("mask"), (F.col("at") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        .select("doc_id", "text")
    )


def jaccard_components(
    docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_items: int = 4_000_000
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same set), n_links, component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    # 1. classes and frequent shingles
    seen = written(texts.mapInArrow(*_digests(width)), "digests")
    each = seen.where("kind = 0").drop("kind")
    size = each.agg(F.sum("n").alias("items")).first()["items"] or 0
    least = max(64, size // FREQUENT)
    frequent = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("a").collect()
    frequent = np.sort(np.array([r.a for r in frequent], np.int64).view(np.uint64))
    classes = written(
        each.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("copies")), "classes"
    )
    sizes = {r.n: r.k for r in classes.where("n <= 40").groupBy("n").agg(F.count("*").alias("k")).collect()}
    light = light_boundary(sizes, num, den)

    # 2. and 3. candidates
    parts = max(8, ceil(REGION * size / BUCKET_ITEMS))
    one_each = classes.select(F.col("class_id").alias("doc"), "n", "copies")
    first = _among(texts, one_each)
    packed = first.mapInArrow(_entries(width, num, den, light, parts, spark.sparkContext.broadcast(frequent)), _ENTRY_SQL)
    found = packed.groupBy("bucket").applyInArrow(_shared(parts), _ENTRY_SQL).groupBy("bucket").applyInArrow(*_prefixes())
    # linked sets are of one level of sizes or of neighbouring ones
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(den / num) * (1 + 1e-6))) if num < den else F.col("n")
    found = written(found.distinct().join(one_each.select("doc", level.alias("level")), "doc"), "lists")
    hubs = written(found.groupBy("item", "level").agg(F.min("doc").alias("hub"), F.count("*").alias("k")), "hubs")
    upper = hubs.select("item", (F.col("level") - 1).alias("level"), F.col("hub").alias("b"))
    edges = found.join(hubs, ["item", "level"]).where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    edges = edges.unionByName(hubs.join(upper, ["item", "level"]).select(F.col("hub").alias("a"), "b"))
    bundles = written(connected_components(edges, "bundles").select(F.col("node").alias("doc"), F.col("component").alias("bundle")), "bundles")

    # 4. verification
    bundled = bundles.join(one_each, "doc")
    met = hubs.join(bundles, F.col("hub") == F.col("doc")).groupBy("bundle").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
    # of the shingles that two near sets share, about the prefix's share is listed
    cost = F.coalesce("pairs", F.lit(0)) * den / (den - num + 1)
    by_cost = F.least(F.sqrt(cost / BLOCK_COST), F.col("k"))
    blocks = bundled.groupBy("bundle").agg(F.sum("n").alias("items"), F.count("*").alias("k")).join(met, "bundle", "left")
    blocks = blocks.select("bundle", F.greatest(F.ceil(F.col("items") / block_items), F.ceil(by_cost)).cast("int").alias("blocks")).where("blocks > 1")
    # written, so that the join below can split a large bundle
    bundled = written(bundled.join(written(blocks, "blocks"), "bundle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "bundled")
    most = bundled.agg(F.max("blocks").alias("most")).first().most
    near = _among(texts, bundled)
    side = F.pmod(F.xxhash64("doc", F.lit("block")), F.col("blocks")).cast("int")
    both = (
        near.mapInArrow(*_sets(width))
        .join(bundled, "doc")
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bundle", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "doc", F.col("side").cast("long"), "copies", "items")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle", "i", "j")
        .sortWithinPartitions("bundle", "i", "j")
    )
    verified = written(both.mapInArrow(*_verify(num, den)), "verified")
    if (most or 0) > 1:
        roots = connected_components(verified.select(F.col("doc").alias("a"), F.col("root").alias("b")), "links").withColumnRenamed("component", "root")
    else:
        roots = verified.where("doc <> root").select(F.col("doc").alias("node"), "root")
    links = verified.groupBy("doc").agg(F.sum("links").alias("links"))
    answers = (
        classes.join(links, F.col("class_id") == links["doc"], "left")
        .join(roots, F.col("class_id") == roots["node"], "left")
        .select("n", "a", "b", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    )
    return each.join(answers, ["n", "a", "b"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
