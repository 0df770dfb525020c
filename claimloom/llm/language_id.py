"""Language identification by compression.

For each language a zstandard dictionary of raw content is filled with text of labelled documents. A text's words
(lower case, letters only, single spaces) are cut into blocks; each block is compressed under every dictionary, and
the language with the smallest total wins. Short texts are compressed at a level that finds short matches. The
margin is the gap between the two smallest totals; ``rejected`` marks texts without a letter and those whose margin is
narrow: less than the share ``narrow`` of the second total or less than a byte. Whole bytes are coarse for short
texts, so theirs may be settled by triples of characters: where at least ``KNOWN`` of a text's triples occur in the
dictionaries, the likeliest of the languages within the margin wins if it leads by ``LEAD`` nats. A text that no
dictionary knows is a tie and goes, however short.

The dictionaries are the only thing that is fitted, on a bounded sample: ``dictionary_bytes`` of text per language
from about ``sample_docs`` labelled documents, chosen by a hash of their ids, for at most ``languages`` labels. They are
sent to every task: that many times ``dictionary_bytes`` at most. Every text is judged whole.

Null texts and texts without a letter are ``und`` with score 0. Ties that stay unsettled go to the language with more labelled documents,
then to the smaller label. With no labelled
document every text is ``und``. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import kept, release

UNKNOWN = "und"
KNOWN, LEAD = 0.5, 5.0
_NO_LETTERS = re.compile(r"[\W\d_]+")


def sample_texts(
    docs: DataFrame, where: Column, sample_docs: int = 60, dictionary_bytes: int = 1 << 16, languages: int = 200, id_col="doc_id", text_col="text", lang_col="lang"
) -> dict[str, bytes]:
    """Raw dictionary content per language, from labelled documents with the smallest hashes of their ids (of texts, where an id is null).

    At most ``languages`` languages, those with the most labelled documents, are learned. Rows that repeat an id are one
    document here, with the least text, so about 2 * sample_docs texts a language come to the driver whatever repeats.
    """
    labelled = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit("sample")).alias("h"),
    )
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("different"))
    known = sizes.orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = {r.lang: r.n for r in known}
    if not counts:
        return {}
    # uniform hash below a bound: about 2 * sample_docs different documents of each language, whatever the table's size
    bound = F.create_map(*(F.lit(x) for r in known for x in (r.lang, 4.0 * sample_docs / r.different - 1)))[F.col("lang")]
    chosen = labelled.where(F.col("h") / F.lit(2.0**63) <= bound).groupBy("lang", "h").agg(F.min(F.substring("text", 1, dictionary_bytes)).alias("text"))
    found: dict[str, list] = {}
    for r in chosen.collect():
        found.setdefault(r.lang, []).append((r.h, r.text))
    order = sorted(found, key=lambda lang: (-counts[lang], lang))
    return {lang: b"".join(words_of(t) for _, t in sorted(found[lang])[:sample_docs])[:dictionary_bytes] for lang in order}


def words_of(text: str) -> bytes:
    """Lower-case words of letters, each between single spaces."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def triples(raw: bytes) -> list[str]:
    text = raw.decode("utf-8", "replace")
    return [text[i : i + 3] for i in range(len(text) - 2)]


class Judge:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, content: dict[str, bytes], level: int, block: int, short: int = 1024, short_level: int = 19):
        self.block, self.short, self.content, self.counts = block, short, content, None
        self.long_text, self.short_text = ([self._compressor(raw, *x) for raw in content.values()] for x in ((level, block), (short_level, short)))

    @staticmethod
    def _compressor(raw: bytes, level: int, most: int):
        """Tables sized for the dictionary and one block, not for the level's usual window."""
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sized = zstandard.ZstdCompressionParameters.from_level(level, source_size=most, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=sized)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=sized).compress

    def sizes(self, text: str) -> list[int]:
        raw = words_of(text)
        if len(raw) <= self.short:
            return [len(compress(raw)) for compress in self.short_text]
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(compress(b)) for b in blocks) for compress in self.long_text]

    def settled(self, text: str, among: list[int]) -> int | None:
        """Which of these languages a short text's triples speak for, if they do clearly."""
        raw = words_of(text)
        if len(raw) > self.short:
            return None
        if self.counts is None:
            self.counts = [Counter(triples(x)) for x in self.content.values()]
            self.different = len(set().union(*self.counts))
        own = triples(raw)
        known = [x for x in own if any(x in c for c in self.counts)]
        if len(known) < KNOWN * len(own):
            return None
        weight = {i: sum(math.log((self.counts[i][x] + 0.5) / (self.counts[i].total() + 0.5 * self.different)) for x in known) for i in among}
        first, second, *_ = sorted(among, key=lambda i: (-weight[i], i))
        return first if weight[first] - weight[second] >= LEAD else None


    def verdict(self, text: str | None, names: list[str], narrow: float) -> tuple[str, float, float, bool]:
        """The language, its score, the margin as a share of the second size, and whether it is clear."""
        if text is None or not names:
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(text)
        order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
        low = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * low
        # each byte of gap counts as a bit of evidence
        score = 1 / sum(math.exp(-0.7 * min(900, s - low)) for s in sizes)
        best, least = order[0], max(1, narrow * second)
        clear = second - low >= least
        if not clear and (spoken := self.settled(text, [i for i in order if sizes[i] - low < least])) is not None:
            best, clear = spoken, True
        return names[best], score, (second - low) / max(1, second), clear


def identify(
    docs: DataFrame, content: dict[str, bytes], text_col: str = "text", level: int = 3, block: int = 8192, narrow: float = 0.002
) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin (share of the second size) and rejected. One narrow pass.

    Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)
    key = zlib.crc32(repr((content, level, block)).encode())

    @F.pandas_udf("best string, score double, margin double, clear boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, held = list(shared.value), kept(("language", key), lambda: Judge(shared.value, level, block))
        for texts in batches:
            yield pd.DataFrame([held.verdict(t, names, narrow) for t in texts], columns=["best", "score", "margin", "clear"])
        del held
        release()

    judge = judge.asNondeterministic()  # else a filter on its result has it run twice
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn("_judged", judge(F.when(has_letter, F.col(text_col))))
        .withColumn("lang_pred", F.col("_judged.best"))
        .withColumn("score", F.col("_judged.score"))
        .withColumn("margin", F.col("_judged.margin"))
        .withColumn("rejected", ~F.col("_judged.clear"))
        .drop("_judged")
    )
