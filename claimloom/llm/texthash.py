"""Vectorised word and shingle hashes of whole texts (numpy, no per-word Python).

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased, which is what ``bytes.lower`` and
``bytes.split`` see too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 3
_SALT = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_SEGMENT = 1 << 19
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n. Only tables of the usual size are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, _SEGMENT + (1 << 16))
    up, down = np.full(size, U(_BASE)), np.full(size, U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size > n:
        _powers[:] = made
    return made


def chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as lower-cased UTF-8, in runs of about ``limit`` bytes; with each run its first position."""
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if run and size + len(raw) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = change if space[0] else np.concatenate(([0], change))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    out = np.zeros(len(starts), np.uint64)
    for a, b in _runs(starts):  # sums of a stretch at a time, so that a very long text needs little more than itself
        low = starts[a]
        part = data[low : ends[b - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        own, stop = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[stop] - sums[own]) * down[own] + (stop - own).astype(np.uint64))
    return out, counts


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words that begin within one segment."""
    edge = np.flatnonzero(np.diff(starts // _SEGMENT, prepend=-1))
    yield from zip(edge.tolist(), np.append(edge[1:], len(starts)).tolist())


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``width`` words, or of all words if there are fewer."""
    words, counts = word_hashes(raws)
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            rolled += words[j : n - width + 1 + j] * _SALT[j]
        rolled = mix(rolled)
    out, at = [], 0
    for k in counts.tolist():
        if k >= width:
            x = np.sort(rolled[at : at + k - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif k:
            out.append(mix(np.array([(words[at : at + k] * _SALT[32 : 32 + k]).sum(dtype=np.uint64) + U(k)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out
