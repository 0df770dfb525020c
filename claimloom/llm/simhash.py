"""Document fingerprints by SimHash, in DataFrame functions only.

The terms of a text are its lower-cased words; a term weighs its number of code points, once for each time it
occurs. Each term's 128-bit hash votes with that weight on every bit. Two bits share one 64-bit sum (a text of at
most 2^31 bytes cannot overflow 32 bits of votes), so 64 partial sums next to the scan make a fingerprint.

``near_pairs`` finds all fingerprints within a Hamming radius by permuted block tables: the bits are cut into
blocks, and for each choice of blocks - radius of them a table is keyed by those blocks, since fingerprints that
differ in at most ``radius`` bits agree on at least that many blocks.

``with_next`` gives each document the next one in descending order of ids, in a ring: ids are cut into ranges, each
range's first document is also dealt to the range before it, and a window runs inside each range. Ids that are far from
even are cut into ranges of about equal rows instead.

Null texts are empty. A text without words has the fingerprint of no votes: all zeros. Rows that repeat an id follow
each other in the ring. Rows with a null id have no next document. An empty table gives none.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 128
RANGE_ROWS = 4096
MOST_RANGES = 1 << 20
MOST_PARTS = 10_000
BROADCAST_RANGES = 500_000
_LANES = 0x0000000100000001
_MARK = "\n"


def _hex(value: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(value), width, "0"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, digest: bool = False) -> DataFrame:
    """Per distinct keys (longs): fingerprint (hex), f1 and f2 (its halves) and, if asked, the text's SHA-256.

    Rows with the same keys must hold the same text: their votes add up and leave every majority as it is.
    """
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # a first element that is no word carries the digest and keeps texts without words
    mark = F.concat(F.lit(_MARK), F.sha2(F.col(text_col).cast("binary"), 256) if digest else F.lit(""))
    terms = texts.select(*keys, F.explode(F.concat(F.array(mark), words)).alias("w"))
    is_word = ~F.col("w").startswith(_MARK)
    votes = terms.select(
        *keys,
        F.when(is_word, F.char_length("w").cast("long")).otherwise(F.lit(0).cast("long")).alias("weight"),
        F.xxhash64("w").alias("h1"),
        F.xxhash64("w", F.lit(1)).alias("h2"),
        *((F.when(~is_word, F.conv(F.substring("w", 2 + 15 * i, 15), 16, 10).cast("long")).alias(f"d{i}")) for i in range(5 if digest else 0)),
    )
    half = lambda h, j: F.sum(F.col("weight") * F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)))
    summed = votes.groupBy(*keys).agg(
        F.sum("weight").alias("all"),
        *(half(h, j).alias(f"{h}_{j}") for h in ("h1", "h2") for j in range(32)),
        *(F.max(f"d{i}").alias(f"d{i}") for i in range(5 if digest else 0)),
    )

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            low, high = F.col(f"{h}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{j}", 32)
            for lane, at in ((low, j), (high, j + 32)):
                out = out.bitwiseOR(F.when(2 * lane > F.col("all"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
        return out

    out = summed.select(
        *keys, bits("h1").alias("f1"), bits("h2").alias("f2"),
        *([F.concat(*(_hex(F.col(f"d{i}"), 15 if i < 4 else 4) for i in range(5))).alias("sha256")] if digest else []),
    )
    return out.withColumn("fingerprint", F.concat(_hex(F.col("f1"), 16), _hex(F.col("f2"), 16)))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """In how many bits two fingerprints differ."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of different fingerprints (rows with f1, f2) within ``radius`` bits: a1, a2, b1, b2, distance, each pair once."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def mask(start: int, stop: int, half: int) -> int:
        m = sum(1 << (b - 64 * half) for b in range(start, stop) if b // 64 == half)
        return m - (1 << 64) if m >= 1 << 63 else m

    tables = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        masks = [0, 0]
        for half in (0, 1):
            total = sum(mask(edges[c], edges[c + 1], half) & ((1 << 64) - 1) for c in chosen)
            masks[half] = total - (1 << 64) if total >= 1 << 63 else total
        tables.append(F.struct(F.lit(number).alias("t"), *(F.col(f"f{h + 1}").bitwiseAND(F.lit(masks[h]).cast("long")).alias(f"k{h}") for h in (0, 1))))
    keyed = prints.select("f1", "f2").distinct().select("f1", "f2", F.explode(F.array(*tables)).alias("x")).select("f1", "f2", "x.*")
    left = keyed.select("t", "k0", "k1", F.col("f1").alias("a1"), F.col("f2").alias("a2"))
    right = keyed.select("t", "k0", "k1", F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    ordered = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    apart = distance(*(F.col(c) for c in ("a1", "a2", "b1", "b2")))
    return left.join(right, ["t", "k0", "k1"]).where(ordered & (apart <= radius)).select("a1", "a2", "b1", "b2", apart.alias("distance")).distinct()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """b (the range), doc_id, text, place (position among its range's rows), next_id, next_text; dealt to partitions by b."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    span = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n"), F.count("*").alias("all")).first()
    ranges, loose = (max(1, min(MOST_RANGES, ceil(k / RANGE_ROWS))) for k in (span.n, span.all - span.n))
    number = F.lit(None).cast("long")
    if span.n:
        width = -(-(span.high - span.low + 1) // ranges)
        number = F.floor((F.col("doc_id") - F.lit(span.low)) / F.lit(width))
        fullest = rows.where("doc_id is not null").groupBy(number.alias("b")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if fullest > 8 * max(RANGE_ROWS, span.n // ranges):  # ids are far from even: ranges of equal rows, written as they are numbered
            parts = min(ranges, MOST_PARTS)
            ranged = rows.where("doc_id is not null").repartitionByRange(parts, "doc_id").withColumn("b", F.spark_partition_id().cast("long"))
            rows = written(ranged, "ranges").unionByName(rows.where("doc_id is null").withColumn("b", F.lit(None).cast("long")))
            number = F.col("b")
    # rows without an id are spread over ranges of their own, below 0
    placed = rows.withColumn("b", F.coalesce(number.cast("long"), F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(loose))))
    heads = placed.where("b >= 0").groupBy("b").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.desc("b"))  # one row per range
    last = heads.agg(F.min("b")).first()[0]
    heads = heads.select("head", F.coalesce(F.lag("b").over(order), F.lit(last)).cast("long").alias("also"))
    if ranges <= BROADCAST_RANGES:
        heads = F.broadcast(heads)  # one row a range
    dealt = placed.join(heads, F.col("doc_id") == F.col("head"), "left").select(
        "doc_id", "text", F.explode(F.expr("if(also is null, array(struct(b, false as guest)), array(struct(b, false as guest), struct(also as b, true as guest)))")).alias("x")
    ).select("doc_id", "text", "x.b", "x.guest")
    inside = Window.partitionBy("b").orderBy("guest", F.desc("doc_id"), F.xxhash64("text"))
    after = lambda c: F.when(F.col("b") >= 0, F.lead(c).over(inside))
    return dealt.select(
        "b", "doc_id", "text", "guest", F.row_number().over(inside).alias("place"), after("doc_id").alias("next_id"), after("text").alias("next_text")
    ).where("not guest").drop("guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is replaced by the start of the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (0 to 1).
    """
    pairs = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # substr() counts code points; nothing follows a row without an id
    edited = F.when(F.col("next_text").isNull(), F.col("text")).otherwise(
        F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - third), F.col("next_text").substr(F.lit(1), third))
    )
    # keys begin with the range by which rows are dealt already, so that votes are summed where the texts are
    both = pairs.select(
        "b", "doc_id", "place", "next_id", F.xxhash64("text").alias("h"), F.xxhash64("next_text").alias("next_h"), "n_chars",
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).cast("long").alias("kind"), edited.alias("t")))).alias("x"),
    ).select("b", "doc_id", "place", "next_id", "h", "next_h", "n_chars", "x.kind", "x.t")
    prints = fingerprints(both, ["b", "doc_id", "place", "next_id", "h", "next_h", "n_chars", "kind"], "t", digest=True)
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    rows = written(  # small rows, read twice
        prints.groupBy("b", "doc_id", "place", "next_id", "h", "next_h", "n_chars")
        .agg(*(pick(c, k).alias(f"{c}_{k}") for c in ("f1", "f2") for k in (0, 1)), pick("sha256", 1).alias("edited_sha256")),
        "fingerprints",
    )
    following = rows.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("f1_0").alias("g1"), F.col("f2_0").alias("g2")).distinct()
    like = lambda *x: F.lit(1.0) - distance(*(F.col(c) for c in x)) / F.lit(float(BITS))
    return rows.join(following, ["next_id", "next_h"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat(_hex(F.col("f1_0"), 16), _hex(F.col("f2_0"), 16)).alias("fingerprint"),
        F.concat(_hex(F.col("f1_1"), 16), _hex(F.col("f2_1"), 16)).alias("edited_fingerprint"),
        like("f1_0", "f2_0", "f1_1", "f2_1").alias("near_edited"),
        like("f1_0", "f2_0", "g1", "g2").alias("near_next"),
    )
