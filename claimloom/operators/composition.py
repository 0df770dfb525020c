"""Composition of a ranked frame into one text within a token budget.

The result is one text for a reader with a bounded budget, so only as many rows as can fit are gathered: a row costs
at least its own characters, and heads of the ranking are taken by top-k before anything is collected. Only where
near copies fill even the largest head is the whole ranking read, partition by partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

HEADS = (64, 1 << 10, 1 << 14, 1 << 18)
FORMATS = ("xml", "markdown", "json", "text")


def _units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def count_tokens(text: str) -> int:
    return ceil(_units(text) / 4)


def _cut(text: str, units: int) -> str:
    return text.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore")


def dedup_content(rows: Iterator[tuple[str, str, float]], threshold: float) -> list[tuple[str, str, float]]:
    """Greedy in rank order: a row stays unless a kept one is at least ``threshold`` alike."""
    kept, sets = [], []
    for row in rows:
        mine = set(V.python_tokens(row[1]))
        if all((len(mine & s) / len(mine | s) if mine | s else 1.0) < threshold for s in sets):
            kept.append(row)
            sets.append(mine)
    return kept


def render(rows: list[tuple[str, str, float]], fmt: str) -> str:
    """Rows (value_json, value_text, score) as one text. Objects print as canonical JSON."""
    if fmt == "xml":
        escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        body = "\n".join(f'<claim score="{V.canonical_number(score)}">{escape(text)}</claim>' for _, text, score in rows)
        return f"<context>\n{body}\n</context>"
    if fmt == "markdown":
        return "\n".join(f"- {text}" for _, text, _ in rows)
    if fmt == "json":
        return "[" + ",".join(f'{{"value":{value},"score":{V.canonical_number(score)}}}' for value, _, score in rows) + "]"
    if fmt == "text":
        return "\n".join(text for _, text, _ in rows)
    raise ValueError(f"unknown format {fmt!r}")


def within_budget(text: str, most: int) -> str:
    if count_tokens(text) <= most:
        return text
    return _cut(text, most * 4)


def kappa(rows: DataFrame, fmt: str = "markdown", max_tokens: int = 1000, dedup_threshold: float = 0.9) -> DataFrame:
    """One row: format, content, token_count.

    Rows past the budget cannot show: each adds one character at least, so 4 * max_tokens rows that survive the
    deduplication fill it. The ranking is read in that order and reading stops once the budget is full or the rows end.
    Of equal values only the first can survive the deduplication, so they are one row before the ranking.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if dedup_threshold <= 1:
        equal = rows.groupBy("value_json", "value_text", "score").agg(F.min("ord").alias("ord"))
        best = equal.groupBy("value_json", "value_text").agg(F.max(F.struct("score", "ord")).alias("best"))
        rows = best.select("value_json", "value_text", "best.score", "best.ord")
    head = rows.orderBy(F.desc("score"), "ord", "value_json", "value_text").select("value_json", "value_text", "score")

    def until_full() -> Iterator[tuple[str, str, float]]:
        taken = units = 0
        seen: list[set] = []
        for size in (*HEADS, None):
            n = 0
            for n, r in enumerate(head.limit(size).collect() if size else head.toLocalIterator(), 1):
                if n <= taken:
                    continue
                mine = set(V.python_tokens(r.value_text))
                if all((len(mine & s) / len(mine | s) if mine | s else 1.0) < dedup_threshold for s in seen):
                    seen.append(mine)
                    units += _units(r.value_text) + 1
                    yield (r.value_json, r.value_text, r.score)
                if units > 4 * max_tokens:
                    return
            if not size or n < size:
                return
            taken = size

    content = within_budget(render(list(until_full()), fmt), max_tokens)
    return rows.sparkSession.createDataFrame([(fmt, content, count_tokens(content))], "format string, content string, token_count int")


def kappa_rows(rows: list[tuple[str, str, float]], fmt: str, max_tokens: int, dedup_threshold: float = 0.9) -> tuple[str, int]:
    """The same for rows at hand."""
    content = within_budget(render(dedup_content(iter(rows), dedup_threshold), fmt), max_tokens)
    return content, count_tokens(content)


def parse_context(content: str) -> list:
    """What the json format holds."""
    return json.loads(content)
