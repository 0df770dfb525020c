"""Packing by concatenating and cutting.

Pass one encodes each document once, closes it with an end identifier and writes the identifiers with each
partition's running totals. The prefix sums over the partitions' totals then give every document a place in one
global stream. Pass two cuts that stream into fixed windows: a document yields one piece for each window it
touches. Windows that reach over a partition's end are marked as boundary records; all others are whole within
one partition.

Only the stream's last window is shorter than the others. Null texts are empty documents: the end identifier
alone. Repeated ids are separate documents. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .token_counts import byte_letters
from .wordsplit import WordSplitter
from .worker import kept, release, slices

#: The splitting rules for which words can be encoded one by one.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "bytes": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
}


class Encoder:
    """Identifiers as little-endian 32-bit bytes, as the library gives them.

    Where the vocabulary splits text into words, the library's model encodes each word once while a bounded memo
    holds it. Texts beyond Latin letters or with special strings, and other vocabularies, go to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.letters = byte_letters()
        rules = json.loads(spec)
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.split = None
        if rules["normalizer"] == WORD_RULES["normalizer"] and len(steps) == 2 and steps[1] == WORD_RULES["bytes"] and steps[0]["type"] == "Split" and steps[0]["invert"]:
            self.split = WordSplitter(steps[0]["pattern"]["Regex"], [t["content"] for t in rules["added_tokens"]], self.word, b"".join)

    def word(self, raw: bytes) -> bytes:
        letters = self.letters
        return array("I", [t.id for t in self.tokenizer.model.tokenize("".join([letters[b] for b in raw]))]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split and self.split.simple(text):
            return self.split.plain(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, written: part, doc_id, n (tokens with the end), local_start and ids (binary) of each document."""
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    spec = docs.sparkSession.sparkContext.broadcast(text)
    key, end = zlib.crc32(text.encode()), np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = kept(("encode", key), lambda: Encoder(spec.value)), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 250):
            ids = [encoder(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int64)), batch.column(0), pa.array(n), pa.array(start), pa.array(ids, pa.binary())],
                ["part", "doc_id", "n", "local_start", "ids"],
            )
        del encoder
        release()

    return written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            encode, "part long, doc_id long, n long, local_start long, ids binary"
        ),
        "encoded",
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian 32 bit), doc_tokens, sequence_id, offset, boundary."""
    spark = docs.sparkSession
    tokens = encoded(docs, tokenizer_path, end_id, id_col, text_col)
    # one row for each partition that wrote rows, whatever the documents' number
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect())
    bases = [0, *accumulate(t for _, t in totals)]
    offsets = spark.createDataFrame([(p, b, b + t) for (p, t), b in zip(totals, bases)], "part long, base long, stop long")
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("base") + F.col("local_start"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window)

    def cut(s):
        low = F.greatest(F.col("at"), s * window)
        length = F.least(F.col("at") + F.col("n"), (s + 1) * window) - low
        start = low - F.col("at")
        return F.struct(
            start.alias("start"),
            length.alias("length"),
            F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
            s.alias("sequence_id"),
            (low - s * window).alias("offset"),
            ((s * window < F.col("base")) | ((s + 1) * window > F.col("stop"))).alias("boundary"),
        )

    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), cut)).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "p.boundary"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary) and tokens. A sequence has as many pieces as tokens at most."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
        .select("sequence_id", F.unhex(F.array_join(F.transform("p.ids", F.hex), "")).alias("ids"), "tokens")
    )
