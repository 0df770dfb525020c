"""Language-model scoring with a probabilistic suffix tree.

A text is the symbol sequence of its words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``): their bytes, a space after
each and an end symbol. From the training documents all strings of ``DEPTH`` context symbols and the next
symbol are counted. A context is retained if its next-symbol counts diverge enough from those of its suffix,
count * KL >= ``PER_SYMBOL`` for each different next symbol, and if it was seen ``LEAST`` times, however large the corpus is;
the suffixes of a retained context are retained too. Distributions are smoothed towards the suffix's by the number of
different next symbols; a symbol has its probability in the longest retained suffix of what precedes it. A token (a word with its space, or the end) has the product
of its symbols' probabilities. As for the base score, the outcomes are the tokens seen in training and one class of all
others: a seen token has (1 - u) * (c / N + product) / 2, an unseen one u, the Good-Turing share of tokens seen once.

The tree grows with the training text, so it is nowhere held whole: it lies in the shared folder, split by the two
symbols before the next one and a hash of the third, so that no common ending of words is one task's work. Counts of a bucket are added as they
come, in the memory of its different strings. One pass over the texts makes both what is counted and what is asked: a chunk's
different strings, once each, with their counts in its training texts. Chunks get the probabilities back; buckets of which much is asked are salted by chunk. Only contexts of up to two symbols, 2^24 counts at most, are broadcast.
Unigram counts for the base score are exact: words that make up more than 1 / ``FREQUENT`` of all tokens (so
fewer than ``FREQUENT``) are broadcast, all others are looked up in the counts by buckets of the hash range, shipped as packed
arrays.

Null and empty texts are the end symbol alone. Unknown symbols share the root's escape probability. Rows that
repeat an id are scored alike. Without training text every token is unseen for sure: both scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .texthash import U, chunks, mix, word_hashes
from .worker import release, slices

DEPTH = 6
LEAST = 4
PER_SYMBOL = 1.0
OWN_SHARE = 0.5
FREQUENT = 1 << 20
BUCKET_ITEMS = 300_000
SEGMENT = 512
CHUNK_BYTES = 1 << 24
THIRDS = 4
#: Training bytes of a bucket for each of its salts.
SALT_BYTES = 1 << 24
AT_ONCE = 1 << 20
_END = 0x0A
_LEAD = bytes(DEPTH) + bytes([_END])


def streams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of lower-cased texts, each after DEPTH zeros and an end symbol; and each text's length with those."""
    parts = [_LEAD + b" ".join([*r.replace(b"\0", b"\1").split(), b"\n"]) for r in raws]
    return np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)


def predicted(data: np.ndarray) -> np.ndarray:
    """Which symbols of the streams are predicted: all but what leads each text."""
    lead = np.zeros(len(data), bool)
    lead[DEPTH:] = (data[DEPTH:] == _END) & (data[DEPTH - 1 : -1] == 0)
    return (data != 0) & ~lead


def token_sums(logp: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over every token's symbols, in order: the words of each text and then its end."""
    sums = np.concatenate(([0.0], np.cumsum(logp, dtype=np.float64)))
    ends = (data == 0x20) | (data == _END)
    ends[np.cumsum(lengths) - lengths + DEPTH] = False  # the end symbol that leads each stream
    return np.diff(sums[np.flatnonzero(ends) + 1], prepend=0.0)


def grams(data: np.ndarray) -> np.ndarray:
    """Every predicted symbol (lowest byte) with its context; zeros stand for what precedes the text."""
    if not len(data):
        return np.zeros(0, np.uint64)
    windows = np.ndarray(len(data) - 7, ">u8", np.ascontiguousarray(data), strides=(1,))  # the last eight symbols of each place; what leads a text is seven
    return windows[predicted(data)[7:]].astype(np.uint64) & U((1 << 8 * (DEPTH + 1)) - 1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and their counts; ``x`` is sorted in place, which is faster than the hash table of ``np.unique``."""
    x.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x))


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and the place of each one among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))
    back = np.empty(len(x), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x[new], back


def _merge(items: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate(items) if items else np.zeros(0, np.uint64), np.concatenate(counts) if counts else np.zeros(0, np.int64)
    if not len(a):
        return a, b.astype(np.int64)
    order = np.argsort(a)
    a = a[order]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return a[first], np.add.reduceat(b[order].astype(np.int64), first)


class _Tally:
    """Counts of 64-bit items, merged whenever many have come together. Items of weight 0 are only noted."""

    def __init__(self):
        self.items, self.counts, self.n = [], [], 0
        self.waiting: dict[int, list] = {}
        self.waits = 0

    def add(self, items: np.ndarray, weight: int = 1) -> None:
        self.waiting.setdefault(weight, []).append(items)
        self.waits += len(items)
        if self.waits > 2_000_000:
            self.unite()

    def unite(self) -> None:
        for weight, parts in self.waiting.items():
            new, count = distinct(np.concatenate(parts))
            parts.clear()
            self.items.append(new)
            self.counts.append(count * weight)
            self.n += len(new)
        self.waiting, self.waits = {}, 0
        if self.n > 1_500_000:
            a, b = _merge(self.items, self.counts)
            self.items, self.counts, self.n = [a], [b], len(a) // 2

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.unite()
        return _merge(self.items, self.counts)


WORD, GRAM, DOCUMENT, REQUEST, TRIPLE, TEXT = 0, 1, 2, 3, 4, 5
_COUNTED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("items", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("different", pa.int64())])
_COUNTED_SQL = "kind int, bucket long, items binary, counts binary, total long, different long"


def planes(x: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on, so that zeros lie together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> bytes:
    """Ascending numbers as steps from one to the next."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unsteps(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unplanes(raw, kind), dtype=kind)


def packed(items: np.ndarray) -> bytes:
    """Sorted strings of one bucket as steps, without the two symbols that its number tells."""
    return zstandard.compress(steps(((items >> U(24)) << U(8)) | (items & U(255))), 1)


def unpacked(raw: bytes, bucket: int) -> np.ndarray:
    rest = unsteps(zstandard.decompress(raw), np.uint64)
    return ((rest >> U(8)) << U(24)) | U((bucket // THIRDS) << 8) | (rest & U(255))


def _split(kind: int, items: np.ndarray, counts: np.ndarray, to: np.ndarray) -> list[tuple]:
    """Kind, bucket, items, counts and their sum, for each bucket."""
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    shown = packed if kind == GRAM else np.ndarray.tobytes
    return [
        (kind, int(to[at[0]]), shown(items[at]), zstandard.compress(planes(counts[at].astype(np.uint32)), 1), int(counts[at].sum()))
        for at in (np.split(order, edge[1:]) if len(order) else [])
    ]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _unpack(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])


def gram_bucket(items: np.ndarray) -> np.ndarray:
    """By the two symbols before the next one and a class of the third: the whole subtree of a three-symbol context is in one bucket."""
    third = (((items >> U(24)) & U(255)) * U(0x9E37)) >> U(6)
    return (((items >> U(8)) & U(0xFFFF)) * U(THIRDS) + third % U(THIRDS)).astype(np.int64)


class _Sum:
    """The counts of one bucket, added as its parts come in."""

    def __init__(self, kind: int, bucket: int):
        self.kind, self.bucket, self.total = kind, bucket, 0
        self.items, self.counts, self.waiting, self.merged = [], [], 0, 0

    def add(self, items: bytes, counts: bytes, total: int) -> None:
        self.total += total
        if self.kind == DOCUMENT:
            return
        counts = unplanes(zstandard.decompress(counts), np.uint32)
        seen = counts > 0  # what only held-out texts of a chunk hold was not
        self.items.append((unpacked(items, self.bucket) if self.kind == GRAM else np.frombuffer(items, np.uint64))[seen])
        self.counts.append(counts[seen])
        self.waiting += len(self.items[-1])
        if self.waiting > max(1 << 20, self.merged):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        items, counts = _merge(self.items, self.counts)
        self.items, self.counts, self.waiting, self.merged = [items], [counts], 0, len(items)
        return items, counts

    def rows(self) -> list[tuple]:
        if self.kind == DOCUMENT:
            return [(self.kind, self.bucket, b"", b"", self.total, 0)]
        items, counts = self.merge()
        if self.kind == WORD:
            return [(WORD, self.bucket, items.tobytes(), counts.tobytes(), int(counts.sum()), len(items))]
        triples, sums = _merge([items & U(0xFFFFFF)], [counts])
        return [
            (GRAM, self.bucket, packed(items), planes(counts), int(counts.sum()), len(items)),
            (TRIPLE, self.bucket, triples.tobytes(), sums.tobytes(), 0, len(triples)),
        ]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by kind and bucket."""
    own = None
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for kind, bucket, items, counts, total in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], columns[4].to_pylist()):
            if own is None or (own.kind, own.bucket) != (kind, bucket):
                if own:
                    yield from _table(own.rows(), _COUNTED).to_batches()
                own = _Sum(kind, bucket)
            own.add(items.as_py(), counts.as_py(), total)
    if own:
        yield from _table(own.rows(), _COUNTED).to_batches()
    release()


def _contexts(items: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Strings of ``depth`` context symbols and a next symbol: (string, count), its context's position, contexts, their totals."""
    whole = items & U((1 << 8 * (depth + 1)) - 1)
    full = (whole >> U(8 * depth)) != 0 if depth else np.ones(len(items), bool)
    strings, at = np.unique(whole[full], return_inverse=True)
    count = np.bincount(at, counts[full], len(strings))
    contexts, of = np.unique(strings >> U(8), return_inverse=True)
    return strings, count, of, contexts, np.bincount(of, count, len(contexts))


def retained(
    items: np.ndarray, counts: np.ndarray, least: float, per_symbol: float, pairs: tuple[np.ndarray, np.ndarray] | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For depths 2 to DEPTH, strings and counts of the contexts that the divergence test keeps; all depths 0, 1 and 2 are kept elsewhere.

    ``pairs``: strings of two context symbols with their counts in the whole text, where ``items`` are only some of it.
    """
    levels = {d: _contexts(items, counts, d) for d in range(2, DEPTH + 1)}
    if pairs is not None:
        own = np.isin(pairs[0] >> U(8), levels[2][3])
        levels[2] = _contexts(pairs[0][own], pairs[1][own], 2)
    keep = {d: np.zeros(len(x[3]), bool) for d, x in levels.items()}
    keep[2][:] = True
    for d in range(DEPTH, 2, -1):
        strings, count, of, contexts, total = levels[d]
        up_strings, up_count, _, up_contexts, up_total = levels[d - 1]
        if not len(strings):
            continue
        low = U((1 << 8 * d) - 1)
        parent = np.searchsorted(up_contexts, contexts & U((1 << 8 * (d - 1)) - 1))
        expected = up_count[np.searchsorted(up_strings, strings & low)] / up_total[parent[of]]
        gain = np.bincount(of, count * np.log(count / total[of] / expected), len(contexts))
        keep[d] |= (gain >= per_symbol * np.bincount(of, minlength=len(contexts))) & (total >= least)
        keep[d - 1][parent[keep[d]]] = True
    return [(x[0][keep[d][x[2]]], x[1][keep[d][x[2]]].astype(np.int64)) for d, x in levels.items()]


def _prune(least: float, per_symbol: float, shared_pairs):
    schema = pa.schema([("bucket", pa.int64()), ("depth", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw, count in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                items, counts = unpacked(raw.as_py(), bucket), unplanes(count.as_py(), np.int64)
                context = bucket // THIRDS
                strings, n = shared_pairs.value
                own = slice(*np.searchsorted(strings, (np.array([context, context + 1], np.uint64) << U(8))))
                kept = retained(items, counts, least, per_symbol, (strings[own], n[own]))
                yield from _table([(bucket, d, steps(a), planes(b)) for d, (a, b) in enumerate(kept, 2) if d > 2 and len(a)], schema).to_batches()
        release()

    return prune, "bucket long, depth int, items binary, counts binary"


def root_chances(levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Probabilities of every symbol after every single symbol, from the strings of contexts of up to one symbol."""
    table = np.full((256, 256), 1 / 257)
    for d in (0, 1):
        strings, counts = levels.get(d, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        own = np.zeros((256, 256))
        np.add.at(own, ((strings >> U(8)).astype(np.int64), (strings & U(255)).astype(np.int64)), counts)
        if d == 0:
            own[:] = own[0]
        sums, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
        table = np.where(kinds > 0, (own + kinds * table) / np.maximum(1, sums + kinds), table)
    return table


def prepared(levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each depth from 2: strings, counts, contexts, their totals and numbers of next symbols."""
    out = {}
    for d in range(2, DEPTH + 1):
        strings, counts = levels.get(d, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        if len(strings):
            contexts, first = np.unique(strings >> U(8), return_index=True)
            out[d] = strings, counts, contexts, np.add.reduceat(counts, first), np.diff(first, append=len(strings))
    return out


def chances(items: np.ndarray, levels: dict, root: np.ndarray) -> np.ndarray:
    """log10 probabilities of the last symbols of strings, each in the longest retained suffix of its context.

    ``levels``: strings and counts by depth, or what ``prepared`` makes of them.
    """
    if levels and len(next(iter(levels.values()))) == 2:
        levels = prepared(levels)
    found = root[((items >> U(8)) & U(255)).astype(np.int64), (items & U(255)).astype(np.int64)]
    for d in range(2, DEPTH + 1):
        if d not in levels:
            break  # suffixes of retained contexts are retained, so nothing is deeper
        strings, counts, contexts, sums, kinds = levels[d]
        context, whole = (items >> U(8)) & U((1 << 8 * d) - 1), items & U((1 << 8 * (d + 1)) - 1)
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        here = np.minimum(np.searchsorted(strings, whole), len(strings) - 1)
        own = np.where(strings[here] == whole, counts[here], 0)
        found = np.where(contexts[at] == context, (own + kinds[at] * found) / (sums[at] + kinds[at]), found)
    return np.log10(found).astype(np.float32)


_READ = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int64()), ("items", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("chunk", pa.int64()), ("nth", pa.int64())]
    + [("texts", pa.binary()), ("sizes", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_()))]
)
_READ_SQL = "kind int, bucket long, items binary, counts binary, total long, chunk long, nth long, texts binary, sizes array<long>, ids array<long>, train array<boolean>"


def _read(buckets: int):
    """One pass over the texts: they themselves in compressed runs, numbered by chunk; each chunk's different strings by bucket with

    their counts in its training texts (0: held-out texts alone hold it), which is also what the chunk asks for; counts of training words.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        chunk, nth, size, texts, words, strings = TaskContext.get().partitionId() << 20, 0, 0, 0, _Tally(), _Tally()

        def counted() -> list[pa.RecordBatch]:
            items, counts = strings.result()
            return _table([(*p, chunk, 0, None, None, None, None) for p in _split(GRAM, items, counts, gram_bucket(items))], _READ).to_batches()

        for batch in slices(batches):
            ids, train = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, raws in chunks(batch.column(0).to_pylist()):
                own = slice(first, first + len(raws))
                learnt = [r for r, t in zip(raws, train[own]) if t]
                words.add(word_hashes(learnt)[0])
                strings.add(grams(streams(learnt)[0]))
                strings.add(grams(streams([r for r, t in zip(raws, train[own]) if not t])[0]), 0)
                texts += len(learnt)
                yield from _table([(TEXT, -1, None, None, 0, chunk, nth, zstandard.compress(b"".join(raws), 3), list(map(len, raws)), ids[own], train[own])], _READ).to_batches()
                nth, size = nth + 1, size + sum(map(len, raws)) + len(raws)
                if size >= CHUNK_BYTES:
                    yield from counted()
                    chunk, nth, size, strings = chunk + 1, 0, 0, _Tally()
        yield from counted()
        del strings
        items, counts = words.result()
        rows = [(DOCUMENT, -1, b"", b"", texts), *_split(WORD, items, counts, (items % U(buckets)).astype(np.int64))]
        yield from _table([(*r, -1, 0, None, None, None, None) for r in rows], _READ).to_batches()
        del words, items, counts, rows
        release()

    return read, _READ_SQL


def _levels(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, tuple[list, list]] = {}
    for d, items, counts in zip(*(table.column(c).to_pylist() for c in ("depth", "items", "counts"))):
        at = parts.setdefault(d, ([], []))
        at[0].append(unsteps(items, np.uint64))
        at[1].append(unplanes(counts, np.int64))
    return {d: _merge(*x) for d, x in parts.items()}


def _reply(shared_root, shared_pairs):
    """Per bucket and salt: the probabilities of what chunks ask for, in the order in which they asked."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("chance", pa.binary())])

    def reply(asked: pa.Table, model: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([], schema)
        bucket = asked.column("bucket")[0].as_py()
        strings, n = shared_pairs.value
        own = slice(*np.searchsorted(strings, (np.array([bucket // THIRDS, bucket // THIRDS + 1], np.uint64) << U(8))))
        full = strings[own] >> U(16) != 0
        levels, rows = prepared({2: (strings[own][full], n[own][full])} | _levels(model)), []
        chunks_, raws = asked.column("chunk").to_pylist(), asked.column("items").to_pylist()
        first, parts, size = 0, [], 0
        for i, raw in enumerate(raws):  # many small requests are looked up together
            parts.append(unpacked(raw, bucket))
            size += len(parts[-1])
            if size >= AT_ONCE or i + 1 == len(raws):
                found = np.split(chances(np.concatenate(parts), levels, shared_root.value), np.cumsum([len(p) for p in parts])[:-1])
                rows += [(chunks_[j], bucket, planes(x)) for j, x in enumerate(found, first)]
                first, parts, size = i + 1, [], 0
        return _table(rows, schema)

    return reply, "chunk long, bucket long, chance binary"


def _answered(items: np.ndarray, replies: pa.Table) -> np.ndarray:
    """The probabilities of a chunk's strings (sorted): replies hold each bucket's in order."""
    parts = sorted(zip(replies.column("bucket").to_pylist(), replies.column("chance").to_pylist()))
    out = np.empty(len(items), np.float32)
    out[np.argsort(gram_bucket(items), kind="stable")] = np.concatenate([unplanes(x, np.float32) for _, x in parts] or [np.zeros(0, np.float32)])
    return out


class Automaton:
    """A whole small tree in memory, against which tests hold ``chances``.

    Next states and log10 probabilities by state and symbol; symbol 0 pads, symbol 1 is any unknown byte.
    """

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        seen = np.unique(np.concatenate([x[0] & U(255) for x in levels.values()] or [np.zeros(0, np.uint64)])).astype(np.int64)
        self.symbols = np.ones(256, np.uint16)
        self.symbols[seen] = np.arange(2, len(seen) + 2)
        self.symbols[0] = 0
        width = self.width = len(seen) + 2
        known = {d: np.unique(x[0] >> U(8)) for d, x in levels.items() if d and len(x[0])}
        states: dict[int, np.ndarray] = {0: np.zeros(1, np.uint64)}
        for d in range(DEPTH, 0, -1):  # prefixes of states are states
            longer = states.get(d + 1, np.zeros(0, np.uint64)) >> U(8)
            states[d] = np.union1d(longer, known.get(d, np.zeros(0, np.uint64)))
        first = {d: sum(len(states[k]) for k in range(d)) for d in range(DEPTH + 1)}
        total = sum(map(len, states.values()))
        step = np.zeros((total, width), np.int32)
        chance = np.zeros((total, width), np.float32)

        def place(d: int, keys: np.ndarray) -> np.ndarray:
            """Positions of strings of d symbols among the states, -1 where there is none."""
            if not len(states[d]):
                return np.full(len(keys), -1)
            at = np.minimum(np.searchsorted(states[d], keys), len(states[d]) - 1)
            return np.where(states[d][at] == keys, first[d] + at, -1)

        for d in range(DEPTH + 1):
            own = slice(first[d], first[d] + len(states[d]))
            if not len(states[d]):
                continue
            if d:
                suffix = np.full(len(states[d]), -1)
                for k in range(d - 1, -1, -1):
                    open_ = suffix < 0
                    suffix[open_] = place(k, states[d][open_] & U((1 << 8 * k) - 1))
                step[own], base = step[suffix], chance[suffix]
            else:
                base = np.full((1, width), 1 / 257, np.float32)
            chance[own] = base
            strings, counts = levels.get(d, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            if len(strings):
                row, column = place(d, strings >> U(8)) - first[d], self.symbols[(strings & U(255)).astype(np.int64)]
                sums, kinds = np.bincount(row, counts, len(states[d])), np.bincount(row, minlength=len(states[d]))
                part = (kinds / np.maximum(1, sums + kinds)).astype(np.float32)
                part[kinds == 0] = 1
                mixed = base * part[:, None]
                np.add.at(mixed, (row, column), (counts / (sums + kinds)[row]).astype(np.float32))
                chance[own] = mixed
            if d < DEPTH and len(states[d + 1]):  # a longer state follows where its last symbol is read
                to = states[d + 1]
                step[place(d, to >> U(8)), self.symbols[(to & U(255)).astype(np.int64)]] = first[d + 1] + np.arange(len(to))
        step[:, 0] = 0
        chance[:, 0] = 1
        if total * width >= 1 << 31:
            raise ValueError(f"{total} states of {width} symbols are too many for one table")
        self.states = total
        step *= width
        self.step = step.ravel()
        self.logp = np.log10(chance, out=chance).ravel()

    def symbol_scores(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability of every symbol of the streams (0 for what leads them), all segments side by side."""
        symbols = self.symbols[data].astype(np.int32)
        begin = np.cumsum(lengths) - lengths + len(_LEAD)
        predicted = lengths - len(_LEAD)
        pieces = -(-predicted // SEGMENT)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, predicted[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        state = np.zeros(len(at), np.int32)
        for back in range(DEPTH, 0, -1):
            state = self.step[state + symbols[at - back]]
        out = np.zeros(len(data), np.float32)
        active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments longer than t
        for t in range(int(size.max(initial=0))):
            k = active[t]
            here = at[:k] + t
            index = state[:k] + symbols[here]
            out[here] = self.logp[index]
            state[:k] = self.step[index]
        return out

    def token_scores(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability of every token's symbols, in order: the words of each text and then its end."""
        return token_sums(self.symbol_scores(data, lengths), data, lengths)


def unseen_share(tokens: int, once: int) -> float:
    """Good-Turing: what share of tokens to expect that training has not seen; 1 without training."""
    return min(0.5, max(once, 1) / (tokens + 1)) if tokens else 1.0


def mixed(counts: np.ndarray, spelt: np.ndarray, tokens: int, unseen: float) -> np.ndarray:
    """log10 of a token's probability: its own frequency and its symbols' product in equal parts, or the unseen share."""
    own = np.log10(np.maximum(counts, 1) / max(tokens, 1) * OWN_SHARE)
    other = spelt + np.log10(1 - OWN_SHARE)
    known = np.maximum(own, other) + np.log1p(10.0 ** -np.minimum(np.abs(own - other), 300.0)) / np.log(10.0)
    return np.where(counts > 0, known + np.log10(max(1 - unseen, 1e-300)), np.log10(unseen))


_SCORED = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64())]
    + [("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rows", pa.binary()), ("cnt", pa.binary()), ("items", pa.binary()), ("spelt", pa.binary())]
)
_SCORED_SQL = "kind int, bucket long, row long, doc_id long, train boolean, n_tokens long, n_known long, base double, score double, rows binary, cnt binary, items binary, spelt binary"


def _requests(words: np.ndarray, rows: np.ndarray, spelt: np.ndarray, buckets: int) -> pa.Table:
    """By bucket: words, how many each row has of them, and their spelling's probabilities."""
    to = (words % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(to[order], prepend=-1))[1:]) if len(order) else []:
        run = np.flatnonzero(np.diff(rows[at], prepend=-1))
        counts = np.diff(np.append(run, len(at))).astype(np.uint32)
        out.append((REQUEST, int(to[at[0]]), None, None, None, None, None, None, None, steps(rows[at[run]]), planes(counts), words[at].tobytes(), planes(spelt[at])))
    return _table(out, _SCORED)


def _score(shared_words, tokens: int, different: int, unseen: float, end_count: int, buckets: int):
    """Per chunk: one row per document with what is known by now, and packed requests for the counts of all other words."""

    size = tokens + different + 1

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        frequent, frequent_counts = shared_words.value
        number, nth = texts.column("chunk")[0].as_py() << 25 if texts.num_rows else 0, texts.column("nth").to_pylist()
        runs = []
        for i in sorted(range(len(nth)), key=nth.__getitem__):
            whole, sizes = texts.column("texts")[i].as_py(), texts.column("sizes")[i].as_py()
            whole, ends = zstandard.decompress(whole), np.cumsum(sizes).tolist()
            raws = [whole[a:b] for a, b in zip([0, *ends], ends)]
            data, lengths = streams(raws)
            runs.append((i, raws, data, lengths, *ranked(grams(data))))
        items, _ = distinct(np.concatenate([r[4] for r in runs] or [np.zeros(0, np.uint64)]))
        chance = _answered(items, replies)
        made, requests = [], ([], [], [])
        runs.reverse()
        while runs:  # let go of one by one
            i, raws, data, lengths, asked, back = runs.pop()
            ids, train = (texts.column(c)[i].as_py() for c in ("ids", "train"))
            k = len(raws)
            words, per_text = word_hashes(raws)
            owner = np.repeat(np.arange(k), per_text)
            logp = np.zeros(len(data), np.float32)
            logp[predicted(data)] = chance[np.searchsorted(items, asked)][back]
            spelt = token_sums(logp, data, lengths)
            is_end = np.zeros(len(spelt), bool)
            is_end[np.cumsum(per_text + 1) - 1] = True
            scores, spelt = mixed(np.full(k, end_count), spelt[is_end], tokens, unseen), spelt[~is_end]
            found = np.zeros(len(words), bool)
            base = np.full(k, np.log10((end_count + 1) / size))
            n_known = np.full(k, int(end_count > 0))
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
                found = frequent[at] == words
                counts = frequent_counts[at[found]]
                base += np.bincount(owner[found], np.log10((counts + 1) / size), k)
                scores += np.bincount(owner[found], mixed(counts, spelt[found], tokens, unseen), k)
                n_known = n_known + np.bincount(owner[found], minlength=k)
            rows = np.arange(number, number + k)
            number += k
            none = pa.nulls(k, pa.binary())
            made.append(
                pa.Table.from_arrays(
                    [
                        pa.array(c, t) if not isinstance(c, pa.Array) else c
                        for c, t in zip(
                            (np.full(k, DOCUMENT, np.int32), np.full(k, -1, np.int64), rows, ids, train, per_text + 1, n_known, base, scores, none, none, none, none),
                            _SCORED.types,
                        )
                    ],
                    schema=_SCORED,
                )
            )
            for to, x in zip(requests, (words[~found], rows[owner[~found]], spelt[~found].astype(np.float32))):
                to.append(x)
        if made:
            made.append(_requests(*map(np.concatenate, requests), buckets))
        return pa.concat_tables(made) if made else _table([], _SCORED)

    return score


def _answer(tokens: int, different: int, unseen: float, groups: int):
    """Per bucket: look requests up in the counts; sums for each document, packed by group of documents."""
    schema = pa.schema([("bucket", pa.int64()), ("rows", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary())])
    size = tokens + different + 1

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        items, counts = _unpack(counted.column("items"), np.uint64), _unpack(counted.column("counts"), np.int64)
        if not asked.num_rows:
            return _table([], schema)
        words, rows = _unpack(asked.column("items"), np.uint64), np.concatenate([unsteps(x, np.int64) for x in asked.column("rows").to_pylist()])
        cnt, spelt = (np.concatenate([unplanes(x, t) for x in asked.column(c).to_pylist()]) for c, t in (("cnt", np.uint32), ("spelt", np.float32)))
        found = np.zeros(len(words), np.int64)
        if len(items):
            at = np.minimum(np.searchsorted(items, words), len(items) - 1)
            found = np.where(items[at] == words, counts[at], 0)
        owner = np.repeat(np.arange(len(rows)), cnt)
        base, known = np.bincount(owner, np.log10((found + 1) / size), len(rows)), np.bincount(owner, found > 0, len(rows)).astype(np.int64)
        score = np.bincount(owner, mixed(found, spelt.astype(float), tokens, unseen), len(rows))
        to = (mix(rows.view(np.uint64)) % U(groups)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return _table(
            [(int(to[at[0]]), rows[at].tobytes(), known[at].tobytes(), base[at].tobytes(), score[at].tobytes()) for at in np.split(order, np.flatnonzero(np.diff(to[order], prepend=-1))[1:])],
            schema,
        )

    return answer, "bucket long, rows binary, known binary, base binary, score binary"


def _gather(table: pa.Table) -> pa.Table:
    rows, known, base = _unpack(table.column("rows"), np.int64), _unpack(table.column("known"), np.int64), _unpack(table.column("base"), np.float64)
    score = _unpack(table.column("score"), np.float64)
    own, at = np.unique(rows, return_inverse=True)
    sums = {"more_base": np.bincount(at, base, len(own)), "more_score": np.bincount(at, score, len(own))}
    return pa.table({"row": own, "more_known": np.bincount(at, known, len(own)).astype(np.int64)} | sums)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, per_symbol: float = PER_SYMBOL) -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train")
    )
    letters = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    buckets = max(8, ceil(letters / 6 / BUCKET_ITEMS))

    read = written(rows.select("text", "doc_id", "train").mapInArrow(*_read(buckets)), "read")
    parts = read.where((F.col("kind") == DOCUMENT) | (F.col("total") > 0)).select("kind", "bucket", "items", "counts", "total")
    counted = written(parts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_sum_up, _COUNTED_SQL), "counted")
    sums = {r.kind: r for r in counted.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("different").alias("different")).collect()}
    total = lambda kind, what: sums[kind][what] if kind in sums else 0
    texts, words = total(DOCUMENT, "total"), counted.where(F.col("kind") == WORD)
    tokens, different = total(WORD, "total") + texts, total(WORD, "different") + int(texts > 0)
    often_from = tokens / FREQUENT

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, counts = _unpack(batch.column(0), np.uint64), _unpack(batch.column(1), np.int64)
            keep = counts > often_from
            yield pa.RecordBatch.from_pydict({"items": [items[keep].tobytes()], "counts": [counts[keep].tobytes()], "once": [int((counts == 1).sum())]})

    often = words.select("items", "counts").mapInArrow(frequent, "items binary, counts binary, once long").collect()
    known, known_counts = _merge([np.frombuffer(r["items"], np.uint64) for r in often], [np.frombuffer(r["counts"], np.int64) for r in often])

    unseen = unseen_share(tokens, sum(r["once"] for r in often))

    share = spark.sparkContext.broadcast
    triples: tuple[list, list] = ([], [])
    for r in counted.where(F.col("kind") == TRIPLE).select("items", "counts").toLocalIterator():  # 2^24 different ones at most
        triples[0].append(np.frombuffer(r["items"], np.uint64))
        triples[1].append(np.frombuffer(r["counts"], np.int64))
        if len(triples[0]) >= 4096:
            triples = tuple([x] for x in _merge(*triples))
    pairs = _merge(*triples)
    root, shared_pairs = share(root_chances({d: _contexts(*pairs, d)[:2] for d in (0, 1)})), share(pairs)
    strings = counted.where(F.col("kind") == GRAM).select("bucket", "items", "counts")
    model = written(strings.mapInArrow(*_prune(least, per_symbol, shared_pairs)), "tree")

    # so that what chunks ask of one bucket never meets whole: one row for each large bucket, of which there are 2^16 * THIRDS at most
    salts = counted.where((F.col("kind") == GRAM) & (F.col("total") > SALT_BYTES)).select("bucket", F.ceil(F.col("total") / SALT_BYTES).alias("salts"))
    salts = F.broadcast(written(salts, "salts"))
    many = F.coalesce("salts", F.lit(1))
    asks = read.where(F.col("kind") == GRAM).select("chunk", "bucket", "items").join(salts, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("chunk"), many)).drop("salts")
    deep = model.join(salts, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("salts")
    replies = asks.groupBy("bucket", "salt").cogroup(deep.groupBy("bucket", "salt")).applyInArrow(*_reply(root, shared_pairs))
    texts_of = read.where(F.col("kind") == TEXT).select("chunk", "nth", "texts", "sizes", "ids", "train")
    scored = written(
        texts_of.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(share((known, known_counts)), tokens, different, unseen, texts, buckets), _SCORED_SQL), "scored"
    )
    asked = scored.where(F.col("kind") == REQUEST).select("bucket", "rows", "cnt", "items", "spelt")
    more = (
        asked.groupBy("bucket").cogroup(words.select("bucket", "items", "counts").groupBy("bucket")).applyInArrow(*_answer(tokens, different, unseen, buckets))
        .groupBy("bucket").applyInArrow(_gather, "row long, more_known long, more_base double, more_score double")
    )
    return scored.where(F.col("kind") == DOCUMENT).join(more, "row", "left").select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
