"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

A piece of text starts as one symbol per UTF-8 byte, the last marked as a word's end. The adjacent pair of
lowest rank is popped from a heap and merged, neighbours are relinked and their new pairs pushed, until no
ranked pair is left. The piece then counts (initial symbols - merges) tokens.

The rules come from the vocabulary file (JSON, BPE with ``</w>`` as word end, NFC, lower case, white space
dropped), read on the driver and broadcast: its size is that of the file. Pieces between white space are counted
once per Python worker while a bounded memo holds them.

Null and empty texts count 0. Special strings inside a text are one token each. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordsplit import WordSplitter
from .worker import kept, release


def read_rules(path: str) -> dict:
    """Merge ranks, word-split pattern and special strings of a vocabulary file."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
        raise ValueError("a BPE vocabulary with </w> as word end is needed")
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "merges": [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]],
        "pattern": split["pattern"]["Regex"],
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(own)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under one set of rules."""

    def __init__(self, rules: dict):
        letters = byte_letters()
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.inner = [number(c) for c in letters]
        self.last = [number(c + "</w>") for c in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(rules["merges"]):
            self.ranks.setdefault((number(a), number(b)), (rank, number(a + b)))
        special = rules["special"]
        self.split = WordSplitter(rules["pattern"], special, self.merged, sum)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def merged(self, raw: bytes) -> int:
        """Tokens of one word given as bytes: symbols less merges."""
        n = len(raw)
        if n < 2:
            return n
        ranks = self.ranks
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(found[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := ranks.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if right < 0 or symbol[left] != a or symbol[right] != b:
                continue  # a neighbour has been merged since
            symbol[left] = ranks[a, b][1]
            symbol[right] = -1
            merges += 1
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                if found := ranks.get((symbol[left], symbol[beyond])):
                    heapq.heappush(heap, (found[0], left, symbol[left], symbol[beyond]))
            if (earlier := before[left]) >= 0 and (found := ranks.get((symbol[earlier], symbol[left]))):
                heapq.heappush(heap, (found[0], earlier, symbol[earlier], symbol[left]))
        return n - merges

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split.simple(text):
            return self.split.plain(text)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self.split.normalised(p) for p in parts if p)


def token_counter(spark, tokenizer_path: str) -> Callable[[Column], Column]:
    """A function from a text column to its token count."""
    rules = spark.sparkContext.broadcast(read_rules(tokenizer_path))
    key = zlib.crc32(repr(rules.value).encode())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = kept(("count", key), lambda: MergeCounter(rules.value)).count
        for texts in batches:
            yield texts.map(count).astype("int64")
        del count
        release()

    return lambda text: tokens(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, UTF-8 bytes, tokens and whether they exceed ``limit``. One narrow pass, no shuffle."""
    tokens = token_counter(docs.sparkSession, tokenizer_path)
    return docs.select(
        F.col(id_col),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        tokens(F.col(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
