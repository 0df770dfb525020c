"""The claims table and how a frame becomes one.

A claim asserts a value for (subject, key, scope) with a confidence, a validity interval [valid_from, valid_to) and a
transaction time, all in epoch milliseconds; an open interval has a null end. ``ord`` keeps the read order that
stable ranking and first-wins rules need: read rows by (recorded_seq, id), appended rows behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import values as V
from .functions.confidence import point

EVIDENCE = "array<struct<kind:string,claim_id:string,document_id:string,offset_start:bigint,offset_end:bigint,method:string,uri:string,content_hash:string>>"
ORDER = "struct<stage:int,seq:bigint,tie:string>"

#: Column name -> type, in the order of the table.
CLAIM_COLUMNS = {
    "corpus_id": "string", "id": "string", "subject": "string", "key": "string", "scope": "map<string,string>", "scope_hash": "string",
    "value_json": "string", "value_text": "string", "value_hash": "string", "dist": "string", "alpha": "double", "beta": "double", "p": "double",
    "raw": "double", "effective": "double", "valid_from": "bigint", "valid_to": "bigint", "recorded": "bigint", "recorded_seq": "bigint",
    "status": "string", "source": "string", "workflow": "string", "run_id": "string", "evidence": EVIDENCE, "tags": "array<string>", "ord": ORDER,
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


STATUSES = ("candidate", "provisional", "validated", "deprecated")
TRIPLE = ("subject", "key", "scope_hash")
DAY_MS = 86_400_000


def order_of(stage: int, seq: Column, tie: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), seq.cast("bigint").alias("seq"), tie.alias("tie"))


def cite(claim_id: Column, method: Column | None = None, content_hash: Column | None = None) -> Column:
    """An evidence reference to a claim."""
    given = {"kind": F.lit("claim"), "claim_id": claim_id, "method": method, "content_hash": content_hash}
    kinds = dict(f.split(":") for f in EVIDENCE.removeprefix("array<struct<").removesuffix(">>").split(","))
    return F.struct(*((given.get(n) if given.get(n) is not None else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def as_claims(df: DataFrame, corpus_id: str = "default", text: str | None = None) -> DataFrame:
    """Fill in what a frame of partial claims lacks: hashes, texts, defaults and order.

    Needs id, subject, key and value_json; takes what else is there. ``text``: the column with the string that every
    value is, where it is at hand, so that it need not be parsed out of its JSON.
    """
    have = set(df.columns)
    null = lambda c: F.lit(None).cast(CLAIM_COLUMNS[c])
    given = lambda c, default: F.col(c).cast(CLAIM_COLUMNS[c]) if c in have else default.cast(CLAIM_COLUMNS[c])
    base = df.withColumn("value_json", V.canonical_json(F.col("value_json"))).withColumn("scope", given("scope", F.create_map().cast("map<string,string>")))
    built = base.select(
        given("corpus_id", F.lit(corpus_id)).alias("corpus_id"), "id", "subject", "key", "scope", V.scope_hash(F.col("scope")).alias("scope_hash"),
        "value_json", (F.col(text) if text else V.value_text(F.col("value_json"))).alias("value_text"), V.short_hash(F.col("value_json")).alias("value_hash"),
        given("dist", F.when(F.lit("alpha" in have), "beta").otherwise("scalar")).alias("dist"),
        given("alpha", null("alpha")).alias("alpha"), given("beta", null("beta")).alias("beta"),
        given("p", F.lit(None) if "alpha" in have else F.lit(1.0)).alias("p"), given("effective", null("effective")).alias("effective"),
        given("valid_from", F.lit(0)).alias("valid_from"), given("valid_to", null("valid_to")).alias("valid_to"),
        given("recorded", F.col("valid_from") if "valid_from" in have else F.lit(0)).alias("recorded"),
        given("recorded_seq", F.lit(0)).alias("recorded_seq"),
        given("status", F.lit("validated")).alias("status"), given("source", F.lit("imported")).alias("source"), given("workflow", null("workflow")).alias("workflow"), given("run_id", null("run_id")).alias("run_id"),
        given("evidence", F.array()).alias("evidence"), given("tags", F.array()).alias("tags"),
    )
    return built.withColumn("raw", point()).withColumn("ord", order_of(0, F.col("recorded_seq"), F.col("id"))).select(*CLAIM_COLUMNS)


def beta_claims(df: DataFrame) -> DataFrame:
    return df.where("dist = 'beta'")
