"""Claims derived from the star-schema, event, document and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import let
from ..schema import as_claims

#: The evaluation clock of the registered queries: 2024-01-11, 19:06:40 UTC.
CLOCK = 1_705_000_000_000
SOURCES = ("manual", "verification", "workflow", "heuristic", "llm", "imported")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp's own clock face, whatever the session's time zone."""
    second = F.date_part(F.lit("SECOND"), ts).cast("double")
    return F.unix_date(F.to_date(ts)) * F.lit(86_400_000).cast("bigint") + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(second * 1000 + 1e-6).cast("bigint")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").withColumns({"k": k, "ms": epoch_ms(F.col("ts"))})


def _fields(k: Column) -> dict[str, Column]:
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (k % 6 + 1).cast("int"))
    return {
        "id": F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 10, "0")),
        "subject": F.concat(F.lit("user:"), F.col("user_id").cast("string")),
        "key": F.concat(F.lit("event."), F.col("event_type")),
        "alpha": (1 + k % 7).cast("double"),
        "beta": (1 + k % 5).cast("double"),
        "valid_from": F.col("ms"),
        "valid_to": F.when(k % 10 == 0, F.col("ms") + 604_800_000),
        "recorded": F.col("ms") + (k % 5) * 3_600_000,
        "recorded_seq": F.col("event_id"),
        "status": F.when(k % 20 == 0, "deprecated").when(k % 20 == 1, "candidate").otherwise("validated"),
        "source": source,
        "tags": F.array(F.col("event_type"), F.concat(F.lit("bucket:"), (k % 3).cast("string"))),
    }


def events_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per event; the value is an object (amount, k, v, won)."""
    rows = _events(spark, sf_dir)
    k = F.col("k")
    won = lambda k: F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    fields = lambda k: F.struct(F.col("value").alias("amount"), k.alias("k"), (k % 4).alias("v"), won(k).alias("won"))
    value = F.to_json(let(k, fields), {"ignoreNullFields": "false"})  # filters put k's own expression wherever it is named
    scope = F.when(k % 2 == 0, F.create_map(F.lit("entityId"), F.concat(F.lit("user-"), F.col("user_id").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return as_claims(rows.select(*(c.alias(n) for n, c in _fields(k).items()), scope.alias("scope"), value.alias("value_json")), "events")


def events_beliefs(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """The same events asserting k % 4 without a scope, so that they contradict; ``by_day`` makes ties."""
    rows = _events(spark, sf_dir)
    if by_day:
        rows = rows.withColumn("ms", F.col("ms") - F.col("ms") % 86_400_000)
    k = F.col("k")
    return as_claims(rows.select(*(c.alias(n) for n, c in _fields(k).items()), (k % 4).cast("string").alias("value_json")), "events")


def docs_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject: the source; key: the language; value: the text."""
    rows = read(spark, sf_dir, "documents")
    quoted = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    return as_claims(
        rows.select(
            F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"),
            F.col("source").alias("subject"),
            F.concat(F.lit("doc."), F.col("lang")).alias("key"),
            quoted.alias("value_json"),
            F.lit(0).alias("valid_from"),
            F.col("doc_id").alias("recorded_seq"),
            "text",
        ),
        "documents",
        text="text",
    )


def convo_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject: the conversation; key: the role; value: the turn's text."""
    rows = read(spark, sf_dir, "conversations")
    quoted = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    return as_claims(
        rows.select(
            F.concat(F.lit("turn-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"),
            F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("subject"),
            F.concat(F.lit("turn."), F.col("role")).alias("key"),
            quoted.alias("value_json"),
            F.col("turn").alias("valid_from"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("recorded_seq"),
            "text",
        ),
        "conversations",
        text="text",
    )


def vec_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject: the label; value: the vector's number; with the column ``embedding``."""
    rows = read(spark, sf_dir, "embeddings")
    claims = as_claims(
        rows.select(
            F.concat(F.lit("vec-"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"),
            F.concat(F.lit("label:"), F.col("label").cast("string")).alias("subject"),
            F.lit("vec.id").alias("key"),
            F.col("vec_id").cast("string").alias("value_json"),
            F.col("vec_id").alias("recorded_seq"),
        ),
        "vectors",
    )
    return claims.join(rows.select(F.col("vec_id").alias("recorded_seq"), "embedding"), "recorded_seq")


def orders_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per order, which cites the customer's order before it."""
    name = lambda c: F.concat(F.lit("ord-"), F.lpad(c.cast("string"), 10, "0"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = read(spark, sf_dir, "orders").withColumn("before", before)
    cite = F.expr(
        "if(before is null, array(), array(named_struct('kind','claim','claim_id',concat('ord-', lpad(cast(before as string), 10, '0')),'document_id',cast(null as string),"
        "'offset_start',cast(null as bigint),'offset_end',cast(null as bigint),'method',cast(null as string),'uri',cast(null as string),'content_hash',cast(null as string))))"
    )
    return as_claims(
        rows.select(
            name(F.col("o_orderkey")).alias("id"),
            F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("subject"),
            F.lit("order.status").alias("key"),
            F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("value_json"),
            epoch_ms(F.col("o_orderdate")).alias("valid_from"),
            F.col("o_orderkey").alias("recorded_seq"),
            cite.alias("evidence"),
        ),
        "orders",
    )


def name_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and nations as subjects, for census and reconciliation."""
    parts = read(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("id"), F.col("p_name").alias("subject"), F.col("p_type").alias("key"),
        F.col("p_size").cast("string").alias("value_json"), F.lit(0).alias("valid_from"), F.col("p_partkey").alias("recorded_seq"),
    )
    nations = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0")).alias("id"), F.col("n_name").alias("subject"), F.lit("nation.region").alias("key"),
        F.col("n_regionkey").cast("string").alias("value_json"), F.lit(0).alias("valid_from"), (F.col("n_nationkey") + 10_000_000).cast("bigint").alias("recorded_seq"),
    )
    return as_claims(parts.unionByName(nations), "names")


def brand_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject: the brand; value: the part's name."""
    rows = read(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("id"), F.col("p_brand").alias("subject"), F.lit("part.name").alias("key"),
        F.concat(F.lit('"'), "p_name", F.lit('"')).alias("value_json"), F.lit(0).alias("valid_from"), F.col("p_partkey").alias("recorded_seq"),
    )
    return as_claims(rows, "brands")


#: Aliases with a chain, a cycle, a tie, a self-alias and a malformed one: (variant, value, valid_from).
ALIAS_ROWS = [
    ("event.view", '"event.click"', 10), ("event.click", '"event.touch"', 10), ("event.old", '"event.view"', 5), ("event.old", '"event.click"', 9),
    ("c1", '"c2"', 1), ("c2", '"c1"', 1), ("tail", '"c1"', 1), ("tied", '"event.view"', 3), ("tied", '"event.click"', 3), ("self", '"self"', 1), ("bad", "7", 1), ("to-tied", '"tied"', 2),
]


def alias_claims(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f"alias-{i:03}", f"key:{v}", "alias-of", x, t, i) for i, (v, x, t) in enumerate(ALIAS_ROWS)], "id string, subject string, key string, value_json string, valid_from bigint, recorded_seq bigint")
    return as_claims(rows, "events")
