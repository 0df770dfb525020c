"""Importers: JSON lines, mapped rows of public datasets, tab-separated files and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_claims

MAPPERS = ("jsonl", "conceptnet", "icews")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line, value VARIANT or null, malformed); blank lines are left out. One narrow pass, split by file blocks."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The same for lines at hand, in the column ``value``."""
    lines = lines.where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return lines.select(F.col("value").alias("line"), parsed.alias("record"), (~is_object).alias("malformed"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("record", f"$.{path}", kind)


def map_records(rows: DataFrame, mapper: str = "jsonl", corpus_id: str = "default") -> DataFrame:
    """Claims of well-formed lines; the id hashes the line, so a repeated import gives the same ids."""
    good = rows.where(~F.col("malformed"))
    ident = F.concat(F.lit("in-"), F.substring(F.sha2("line", 256), 1, 24)).alias("id")
    whole = F.to_json(F.try_variant_get("record", "$.value", "variant"))
    if mapper == "jsonl":
        number = _get("confidence", "double")
        typed = _get("confidence.distribution")
        body = good.select(
            ident, _get("subject").alias("subject"), _get("key").alias("key"), F.coalesce(whole, F.lit("null")).alias("value_json"),
            F.coalesce(_get("scope", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("scope"),
            F.coalesce(typed, F.lit("scalar")).alias("dist"), _get("confidence.parameters.alpha", "double").alias("alpha"), _get("confidence.parameters.beta", "double").alias("beta"),
            F.when(F.coalesce(typed, F.lit("scalar")) == "scalar", F.coalesce(number, _get("confidence.parameters.p", "double"), F.lit(1.0))).alias("p"),
            F.coalesce(_get("valid.from", "bigint"), F.lit(0)).alias("valid_from"), _get("valid.to", "bigint").alias("valid_to"),
            F.coalesce(_get("status"), F.lit("validated")).alias("status"), F.coalesce(_get("source"), F.lit("imported")).alias("source"),
            F.coalesce(_get("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        )
    elif mapper == "conceptnet":
        body = good.select(
            ident, _get("start").alias("subject"), _get("rel").alias("key"), F.to_json(F.try_variant_get("record", "$.end", "variant")).alias("value_json"),
            F.lit("scalar").alias("dist"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get("weight", "double"), F.lit(1.0)))).alias("p"),
        )
    elif mapper == "icews":
        body = good.select(
            ident, _get("subject").alias("subject"), _get("relation").alias("key"), F.to_json(F.try_variant_get("record", "$.object", "variant")).alias("value_json"),
            F.lit("scalar").alias("dist"), F.lit(1.0).alias("p"), _get("timestamp", "bigint").alias("valid_from"),
        )
    else:
        raise ValueError(f"unknown mapper {mapper!r}; there are {', '.join(MAPPERS)}")
    named = body.where("subject is not null and key is not null")
    return as_claims(named.withColumn("corpus_id", F.lit(corpus_id)).withColumn("recorded_seq", F.monotonically_increasing_id()), corpus_id)


def import_summary(rows: DataFrame) -> DataFrame:
    """One row: total, well_formed, skipped."""
    return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("malformed")).alias("well_formed"), F.count_if("malformed").alias("skipped"))


def event_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (subject, relation, object, ISO date) as records of the mapper ``icews``: JSON lines in column value."""
    rows = spark.read.csv(path, sep="\t", schema="subject string, relation string, object string, day string", quote="")
    ms = F.unix_date(F.to_date(F.try_to_timestamp("day"))) * F.lit(86_400_000).cast("bigint")
    return rows.where("subject is not null and object is not null").select(F.to_json(F.struct("subject", "relation", "object", ms.alias("timestamp"))).alias("value"))


def edge_tsv(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Tab-separated edges (uri, relation, start, end, JSON with weight) between terms of one language, as JSON lines."""
    rows = spark.read.csv(path, sep="\t", schema="uri string, rel string, a string, b string, extra string", quote="")
    term = lambda c: F.regexp_extract(c, rf"^/c/{language}/([^/]+)", 1)
    weight = F.coalesce(F.try_variant_get(F.try_parse_json("extra"), "$.weight", "double"), F.lit(1.0))
    kept = rows.select(term(F.col("a")).alias("start"), F.regexp_replace("rel", "^/r/", "").alias("rel"), term(F.col("b")).alias("end"), weight.alias("weight"))
    return kept.where("start <> '' and end <> ''").select(F.to_json(F.struct("start", "rel", "end", "weight")).alias("value"))


def transcript_claims(meetings: DataFrame, corpus_id: str = "meetings") -> DataFrame:
    """Claims from sentences of the form SUBJECT | KEY | VALUE in rows (id, title, date ISO, sentences array<struct<speaker,text>>)."""
    said = meetings.select("id", "date", F.posexplode("sentences").alias("n", "s"))
    part = lambda i: F.trim(F.regexp_extract("s.text", r"^\s*([^|]+)\|([^|]+)\|(.+)$", i))
    rows = said.select("id", "date", "n", part(1).alias("subject"), part(2).alias("key"), part(3).alias("text"), F.col("s.speaker").alias("speaker")).where("subject <> ''")
    body = rows.select(
        F.concat_ws("-", F.lit("talk"), "id", F.lpad(F.col("n").cast("string"), 6, "0")).alias("id"), "subject", "key",
        F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)").alias("value_json"),
        (F.unix_date(F.to_date("date")) * F.lit(86_400_000).cast("bigint")).alias("valid_from"), F.col("n").cast("bigint").alias("recorded_seq"),
        F.array(F.concat(F.lit("speaker:"), F.coalesce("speaker", F.lit("unknown")))).alias("tags"), F.lit("llm").alias("source"),
    )
    return as_claims(body, corpus_id)
