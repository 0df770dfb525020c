"""From documents to packed training sequences.

Stages: language identification, near-duplicate removal, mixing of sources, packing. Each takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import jaccard_join, language_id, mixing, packing
from claimloom.llm.common import written
from claimloom.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or whose language is not clear go; ``lang`` becomes the predicted one where it is null.

    Null and empty texts have no letter and go. Repeated rows are judged alike; rows without an id are judged as all others.
    Without a labelled document nothing can be told, so all go. An empty table stays empty.
    """
    content = language_id.sample_texts(docs, F.lit(True))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text")  # so that no name clashes
    kept = language_id.identify(held, content).where(~F.col("rejected"))
    own = lambda c: F.coalesce(F.col("_doc.lang"), F.col("lang_pred")).alias("lang") if c == "lang" else F.col(f"_doc.`{c}`").alias(c)
    return kept.select(*map(own, docs.columns))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, similarity of 0.8 or more) the one with the smallest id stays.

    Rows without an id stay; rows that repeat an id are one document and stay together. Texts without words are near
    nothing and stay.
    """
    found = jaccard_join.jaccard_components(docs, width=5, num=80, den=100)
    go = found.where("component_id <> doc_id").select(F.lit(False).alias("without"), F.col("doc_id").alias("going"))
    # rows without an id are dealt by their text, so that they don't meet in one task
    key = F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))
    return docs.join(go, (key == go["going"]) & (docs["doc_id"].isNull() == go["without"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares: documents are repeated or left out by their Poisson draw.

    A null source is a source of its own; rows that repeat an id draw alike, those without an id as one. Texts do not matter.
    """
    return mixing.mix(docs, weights=None, scale=1.0, seed="pipeline").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their identifiers.

    A null or empty text is its end identifier alone; every row is a document, whatever repeats. No documents give no pieces.
    """
    return packing.pack(docs, str(TOKENIZER), window=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", identify_language),
    ("near copies", remove_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_documents),
]

#: Compression and tokenizing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
