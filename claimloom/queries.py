"""The registered queries of the claims engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import confidence as C
from .operators import aggregation as A
from .operators import combination, composition, contradiction, joins, provenance, ranking, temporal
from .operators import predicates as P
from .sources import views
from .sources.views import CLOCK, events_beliefs, events_claims

DAY = 86_400_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The claims of the events, as SQL: ``claims`` has the value's fields as columns.
CLAIMS_SQL = f"""
    raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events),
    claims AS (
        SELECT 'ev-' || lpad(event_id::VARCHAR, 10, '0') AS id, 'user:' || user_id AS subject, 'event.' || event_type AS key,
            CASE WHEN k % 2 = 0 THEN 'user-' || user_id END AS entity, value AS amount, k, k % 4 AS v,
            CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS won, (1 + k % 7)::DOUBLE AS alpha, (1 + k % 5)::DOUBLE AS beta,
            (1 + k % 7)::DOUBLE / (2 + k % 7 + k % 5) AS point, ms AS valid_from, CASE WHEN k % 10 = 0 THEN ms + 604800000 END AS valid_to,
            ms + (k % 5) * 3600000 AS recorded, event_id AS seq,
            CASE k % 20 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'candidate' ELSE 'validated' END AS status,
            CASE k % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'verification' WHEN 2 THEN 'workflow' WHEN 3 THEN 'heuristic' WHEN 4 THEN 'llm' ELSE 'imported' END AS source,
            CASE k % 6 WHEN 0 THEN 1.3 WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 WHEN 4 THEN 0.7 ELSE 0.6 END::DOUBLE AS weight,
            event_type, k % 3 AS bucket, ms - ms % {DAY} AS day
        FROM raw)
"""


def register(name: str, sql: str | None = None, claims: bool = True):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {CLAIMS_SQL} {sql}" if claims else sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# selection


@register("sigma_compound", "SELECT id, subject FROM claims WHERE key IN ('event.click', 'event.purchase') AND status IN ('validated', 'candidate') AND NOT (point <= 0.4) AND (valid_from <= 1705000000000 AND (valid_to IS NULL OR 1705000000000 < valid_to))")
def sigma_compound(spark, d):
    p = P.and_(P.key_in(["event.click", "event.purchase"]), P.status_in(["validated", "candidate"]), P.not_(P.not_(P.confidence_gt(0.4))), P.valid_at(CLOCK))
    return P.sigma(events_claims(spark, d), p).select("id", "subject")


@register("sigma_value_path", "SELECT id, v FROM claims WHERE v IN (1, 3) AND k > 50 AND amount > 20")
def sigma_value_path(spark, d):
    p = P.and_(P.value_in("v", [1, 3]), P.value_gt("k", 50), P.value_gt("amount", 20))
    return P.sigma(events_claims(spark, d), p).select("id", F.get_json_object("value_json", "$.v").cast("bigint").alias("v"))


@register("sigma_value_null", "SELECT id, won IS NULL AS is_null FROM claims WHERE won IS NULL OR v = 0")
def sigma_value_null(spark, d):
    rows = P.sigma(events_claims(spark, d), P.and_(P.value_exists("won"), P.or_(P.value_null("won"), P.value_eq("v", 0))))
    return rows.select("id", P.value_null("won").alias("is_null"))


@register("sigma_value_regex", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(^|\\s)(the|la|der)\\s')", claims=False)
def sigma_value_regex(spark, d):
    rows = views.convo_claims(spark, d).withColumn("value_json", F.concat(F.lit('{"text":'), "value_json", F.lit("}")))
    found = P.sigma(rows, P.value_regex("text", r"(^|\s)(the|la|der)\s"))
    return found.select(F.floor(F.col("recorded_seq") / 1000).alias("conv_id"), (F.col("recorded_seq") % 1000).alias("turn"))


@register("sigma_matches", "SELECT id FROM claims WHERE v = 2 AND won = true")
def sigma_matches(spark, d):
    return P.sigma(events_claims(spark, d), P.value_matches({"v": 2, "won": True})).select("id")


@register("sigma_tags", "SELECT id FROM claims WHERE event_type = 'error' OR bucket = 2")
def sigma_tags(spark, d):
    return P.sigma(events_claims(spark, d), P.tag_in(["error", "bucket:2"])).select("id")


@register("sigma_scope", "SELECT id, entity FROM claims WHERE entity = 'user-7' OR entity IS NULL AND recorded > 1706000000000")
def sigma_scope(spark, d):
    p = P.or_(P.scope_eq("entityId", "user-7"), P.and_(P.not_(P.scope_eq("entityId", "user-7")), F.expr("cardinality(scope) = 0"), P.recorded_after(1_706_000_000_000)))
    return P.sigma(events_claims(spark, d), p).select("id", F.try_element_at("scope", F.lit("entityId")).alias("entity"))


@register("sigma_subject_status", "SELECT id FROM claims WHERE subject IN ('user:1', 'user:2', 'user:3') AND status <> 'deprecated'")
def sigma_subject_status(spark, d):
    return P.sigma(events_claims(spark, d), P.and_(P.subject_in(["user:1", "user:2", "user:3"]), P.not_(P.status_eq("deprecated")))).select("id")


# projection, time, decay


@register("pi_fields", "SELECT id, subject, key, status FROM claims")
def pi_fields(spark, d):
    return temporal.pi(events_claims(spark, d), ["id", "subject", "key", "status"]).drop("ord")


@register("tau_valid", "SELECT id FROM claims WHERE valid_from <= 1705000000000 AND (valid_to IS NULL OR 1705000000000 < valid_to)")
def tau_valid(spark, d):
    return temporal.tau_valid(events_claims(spark, d), CLOCK).select("id")


@register("tau_recorded", "SELECT id FROM claims WHERE recorded <= 1705000000000")
def tau_recorded(spark, d):
    return temporal.tau_recorded(events_claims(spark, d), CLOCK).select("id")


KNOWN = "valid_from <= 1705000000000 AND (valid_to IS NULL OR 1705000000000 < valid_to) AND recorded <= 1705000000000"


@register("tau_known", f"SELECT id FROM claims WHERE {KNOWN}")
def tau_known(spark, d):
    return temporal.tau_known(events_claims(spark, d), CLOCK).select("id")


AGE = "greatest(0, 1705000000000 - recorded) / 86400000.0"


def _decayed(policy):
    return lambda spark, d: temporal.delta(events_claims(spark, d), policy, CLOCK).select("id", r6("effective").alias("effective"))


register("decay_exponential", f"SELECT id, round(point * pow(0.5, {AGE} / 7), 6) AS effective FROM claims")(_decayed(temporal.exponential(7)))
register("decay_linear", f"SELECT id, round(point * greatest(0, 1 - 0.125::DOUBLE * {AGE}), 6) AS effective FROM claims")(_decayed(temporal.linear(0.125)))
register("decay_step", f"SELECT id, round(point * CASE WHEN {AGE} >= 5 THEN 0 ELSE 1 END, 6) AS effective FROM claims")(_decayed(temporal.step(5)))


@register("decay_then_confidence", f"SELECT subject, count(*) AS n FROM claims WHERE {KNOWN} AND point * pow(0.5, {AGE} / 7) > 0.3 GROUP BY subject")
def decay_then_confidence(spark, d):
    rows = temporal.delta(temporal.tau_known(events_claims(spark, d), CLOCK), temporal.exponential(7), CLOCK)
    return P.sigma(rows, P.confidence_gt(0.3)).groupBy("subject").agg(F.count("*").alias("n"))


@register("suppression", "SELECT id FROM claims WHERE point * pow(0.5, (1705000000000 - recorded) / 604800000.0) >= 0.2")
def suppression(spark, d):
    return temporal.suppress(events_claims(spark, d), 0.2, 604_800_000, CLOCK).select("id")


# ranking

TOKENS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda x: x <> ''))"
JACCARD_SQL = """
    CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0
    ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END
"""
QUERY = "the and of in that is for"
_Q = "['the', 'and', 'of', 'in', 'that', 'is', 'for']"
DOCS_SQL = f"""
    WITH t AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS a FROM documents),
    s AS (SELECT doc_id, {JACCARD_SQL.format(a="a", b=_Q)} AS score FROM t)
"""


def _docs_ranked(spark, d):
    return ranking.rho(views.docs_claims(spark, d), "jaccard", QUERY, ordered=False)


@register("rho_jaccard", f"{DOCS_SQL} SELECT doc_id, round(score, 6) AS score FROM s", claims=False)
def rho_jaccard(spark, d):
    return _docs_ranked(spark, d).select(F.col("recorded_seq").alias("doc_id"), r6("score").alias("score"))


@register("rho_exact", "SELECT id, CASE WHEN v = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM claims")
def rho_exact(spark, d):
    return ranking.rho(events_beliefs(spark, d), "exact", 2, ordered=False).select("id", "score")


@register("top_k", f"{DOCS_SQL} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10", claims=False)
def top_k(spark, d):
    return ranking.top_k(_docs_ranked(spark, d), 10).select(F.col("recorded_seq").alias("doc_id"), r6("score").alias("score"))


@register("relevance_floor", f"{DOCS_SQL} SELECT doc_id FROM s WHERE score >= 0.03", claims=False)
def relevance_floor(spark, d):
    return ranking.relevance_floor(_docs_ranked(spark, d), 0.03).select(F.col("recorded_seq").alias("doc_id"))


@register("abstain_below_top", f"{DOCS_SQL} SELECT doc_id FROM s WHERE (SELECT max(score) FROM s) >= 0.9 UNION ALL SELECT doc_id + 1000000 FROM s WHERE (SELECT max(score) FROM s) >= 0.01", claims=False)
def abstain_below_top(spark, d):
    strict = ranking.abstain_below_top(_docs_ranked(spark, d), 0.9).select(F.col("recorded_seq").alias("doc_id"))
    return strict.unionByName(ranking.abstain_below_top(_docs_ranked(spark, d), 0.01).select((F.col("recorded_seq") + 1_000_000).alias("doc_id")))


@register("rank_blend", "SELECT id, round(0.5 * CASE WHEN v = 2 THEN 1 ELSE 0 END + 0.5 * pow(0.5, greatest(0, 1705000000000 - valid_from) / (90 * 86400000.0)), 6) AS score FROM claims")
def rank_blend(spark, d):
    return ranking.rank_blend(events_beliefs(spark, d), ranking.exact, 2, CLOCK, ordered=False).select("id", r6("score").alias("score"))


@register("rank_blend_confidence", "SELECT id, round(0.4 * CASE WHEN v = 2 THEN 1 ELSE 0 END + 0.4 * pow(0.5, greatest(0, 1705000000000 - valid_from) / (90 * 86400000.0)) + 0.2 * point, 6) AS score FROM claims")
def rank_blend_confidence(spark, d):
    return ranking.rank_blend_confidence(events_beliefs(spark, d), 2, CLOCK, 0.4, 0.4, 0.2, ordered=False).select("id", r6("score").alias("score"))


UNIT = [1.0 if i % 2 else 0.5 for i in range(64)]
COSINE_SQL = f"(1 + list_cosine_similarity(embedding::DOUBLE[], {UNIT}::DOUBLE[])) / 2"


@register("rho_cosine", f"SELECT vec_id, round({COSINE_SQL}, 6) AS score FROM embeddings", claims=False)
def rho_cosine(spark, d):
    return ranking.rho_by(views.vec_claims(spark, d), ranking.cosine_over("embedding", UNIT), None, ordered=False).select(F.col("recorded_seq").alias("vec_id"), r6("score").alias("score"))


@register("hybrid_max", f"SELECT vec_id, round(greatest(CASE WHEN vec_id = 7 THEN 1 ELSE 0 END, {COSINE_SQL}), 6) AS score FROM embeddings", claims=False)
def hybrid_max(spark, d):
    fn = ranking.hybrid_max(ranking.exact, ranking.cosine_over("embedding", UNIT))
    return ranking.rho_by(views.vec_claims(spark, d), fn, 7, ordered=False).select(F.col("recorded_seq").alias("vec_id"), r6("score").alias("score"))


# provenance

GAMMA_SQL = """
    WITH RECURSIVE o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderstatus FROM orders),
    reach AS (
        SELECT o_orderkey AS k, 0 AS depth FROM o WHERE o_orderstatus = 'F'
        UNION ALL SELECT o.before, depth + 1 FROM reach JOIN o ON o.o_orderkey = reach.k WHERE o.before IS NOT NULL AND depth < 2)
    SELECT 'ord-' || lpad(k::VARCHAR, 10, '0') AS id, min(depth)::INTEGER AS depth FROM reach GROUP BY k
"""


@register("gamma_depth2", GAMMA_SQL, claims=False)
def gamma_depth2(spark, d):
    claims = views.orders_claims(spark, d)
    start = claims.where("value_text = 'F'").withColumn("score", F.lit(1.0))
    return provenance.gamma(start, claims, 2).select("id", "depth")


# contradictions

CLUSTER_SQL = """,
    g AS (SELECT subject, key, v, count(*) AS n, sum(alpha) - (count(*) - 1) AS a, sum(beta) - (count(*) - 1) AS b, min(seq) AS first FROM claims WHERE point > 0.3 GROUP BY ALL),
    c AS (SELECT *, count(*) OVER (PARTITION BY subject, key) AS vals FROM g QUALIFY vals > 1)
"""


@register("clusters", f"{CLUSTER_SQL} SELECT subject, key, sum(n)::BIGINT AS total_claims, count(*) AS distinct_values, round(max(a / (a + b)), 6) AS best_mean FROM c GROUP BY ALL")
def clusters(spark, d):
    return contradiction.clusters(events_beliefs(spark, d), 0.3).select("subject", F.col("canonical_key").alias("key"), "total_claims", "distinct_values", r6("best_mean").alias("best_mean"))


@register("agreement_ratio", f"{CLUSTER_SQL} SELECT subject, key, round(max(n)::DOUBLE / sum(n), 6) AS agreement_ratio, arg_max(v, (a / (a + b), -first))::VARCHAR AS best_value FROM c GROUP BY ALL")
def agreement_ratio(spark, d):
    return contradiction.clusters(events_beliefs(spark, d), 0.3).select("subject", F.col("canonical_key").alias("key"), r6("agreement_ratio").alias("agreement_ratio"), "best_value")


@register("value_groups", f"{CLUSTER_SQL} SELECT subject, key, v::VARCHAR AS value_json, n, round(a, 6) AS alpha, round(b, 6) AS beta FROM c")
def value_groups(spark, d):
    return contradiction.value_groups(events_beliefs(spark, d), 0.3).select("subject", F.col("canonical_key").alias("key"), "value_json", "n", r6("alpha").alias("alpha"), r6("beta").alias("beta"))


@register("pairs", """,
    e AS (SELECT * FROM claims WHERE point > 0.7), f AS (SELECT subject, key, v, min(seq) AS first FROM e GROUP BY ALL),
    p AS (SELECT e.*, f.first FROM e JOIN f USING (subject, key, v))
    SELECT l.id AS left_id, r.id AS right_id FROM p l JOIN p r ON l.subject = r.subject AND l.key = r.key AND l.v <> r.v AND l.first < r.first""")
def pairs(spark, d):
    return contradiction.pairs(events_beliefs(spark, d), 0.7).select("left_id", "right_id")


def _statuses(df: DataFrame) -> DataFrame:
    return df.where("key <> 'contradiction.flag' and id like 'ev-%'").select("id", "status")


OTHER_SQL = """,
    e AS (SELECT *, {m} AS m FROM claims WHERE point > 0.3),
    l AS (SELECT DISTINCT a.id FROM e a JOIN e b ON a.subject = b.subject AND a.key = b.key AND a.v <> b.v AND b.m > a.m)
    SELECT c.id, CASE WHEN l.id IS NOT NULL THEN 'deprecated' ELSE c.status END AS status FROM claims c LEFT JOIN l USING (id)
"""


@register("resolve_older", OTHER_SQL.format(m="day"))
def resolve_older(spark, d):
    return _statuses(contradiction.resolve_deprecate_older(events_beliefs(spark, d, by_day=True), 0.3, CLOCK))


@register("resolve_flags", """,
    e AS (SELECT * FROM claims WHERE point > 0.3),
    l AS (SELECT DISTINCT a.id FROM e a JOIN e b ON a.subject = b.subject AND a.key = b.key AND a.v <> b.v AND b.day > a.day),
    w AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM l)),
    f AS (SELECT subject, key, v, min(seq) AS first FROM w GROUP BY ALL), x AS (SELECT w.*, f.first FROM w JOIN f USING (subject, key, v))
    SELECT a.id AS left_id, b.id AS right_id FROM x a JOIN x b ON a.subject = b.subject AND a.key = b.key AND a.v <> b.v AND a.day = b.day AND a.first < b.first""")
def resolve_flags(spark, d):
    rows = contradiction.resolve_deprecate_older(events_beliefs(spark, d, by_day=True), 0.3, CLOCK).where("key = 'contradiction.flag'")
    return rows.select(F.get_json_object("value_json", "$.left").alias("left_id"), F.get_json_object("value_json", "$.right").alias("right_id"))


@register("resolve_lower", OTHER_SQL.format(m="point"))
def resolve_lower(spark, d):
    return _statuses(contradiction.resolve_deprecate_lower(events_beliefs(spark, d), 0.3, CLOCK))


MINORITY_SQL = """,
    n AS (SELECT subject, key, v, count(*) AS n FROM claims WHERE point > 0.3 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject, key ORDER BY n DESC, substr(sha256(v::VARCHAR), 1, 16)) AS r, count(*) OVER (PARTITION BY subject, key) AS vals FROM n QUALIFY vals > 1)
    SELECT c.id, CASE WHEN point > 0.3 AND r > 1 THEN 'deprecated' {extra} ELSE status END AS status FROM claims c LEFT JOIN k USING (subject, key, v)
"""


@register("resolve_minority", MINORITY_SQL.format(extra=""))
def resolve_minority(spark, d):
    return _statuses(contradiction.resolve_deprecate_minority(events_beliefs(spark, d), 0.3, CLOCK))


@register("resolve_consensus", MINORITY_SQL.format(extra="WHEN point > 0.3 AND r = 1 THEN 'validated'"))
def resolve_consensus(spark, d):
    return _statuses(contradiction.resolve_promote_consensus(events_beliefs(spark, d), 0.3, CLOCK))


@register("resolve_synthesize", """,
    g AS (SELECT subject, key, v, sum(alpha) - (count(*) - 1) AS a, sum(beta) - (count(*) - 1) AS b, sum(weight) AS w, min(seq) AS first FROM claims WHERE point > 0.5 GROUP BY ALL)
    SELECT subject, key, round(sum(w * a) / sum(w), 6) AS alpha, round(sum(w * b) / sum(w), 6) AS beta, arg_max(v, (a / (a + b), -first))::VARCHAR AS value_json
    FROM g GROUP BY subject, key HAVING count(*) = 2""")
def resolve_synthesize(spark, d):
    rows = contradiction.resolve_synthesize_belief(events_beliefs(spark, d), 0.5, CLOCK).where("id like 'fused-%'")
    return rows.select("subject", "key", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "value_json")


@register("cardinality_collisions", "SELECT subject, key, count(DISTINCT v) AS values FROM claims WHERE status <> 'deprecated' AND key <> 'event.error' GROUP BY ALL HAVING count(DISTINCT v) > 1")
def cardinality_collisions(spark, d):
    return contradiction.cardinality_collisions(events_beliefs(spark, d), {"event.error": "multi"}).select("subject", F.col("canonical_key").alias("key"), "values")


# combination


def _deduped(rule):
    return lambda spark, d: combination.dedupe(events_beliefs(spark, d), rule).select("id", "subject", "key", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "members")


FIRST = "min(id) AS id, subject, key"
register("dedupe_weighted_avg", f"SELECT {FIRST}, round(sum(weight * alpha) / sum(weight), 6) AS alpha, round(sum(weight * beta) / sum(weight), 6) AS beta, count(*) AS members FROM claims GROUP BY subject, key")(_deduped("weighted_avg"))
register("dedupe_evidence_pooled", f"SELECT {FIRST}, round(sum(alpha) - (count(*) - 1), 6) AS alpha, round(sum(beta) - (count(*) - 1), 6) AS beta, count(*) AS members FROM claims GROUP BY subject, key")(_deduped("evidence_pooled"))
BEST = "SELECT id, subject, key, alpha, beta, count(*) OVER (PARTITION BY subject, key) AS members FROM claims QUALIFY row_number() OVER (PARTITION BY subject, key ORDER BY {0} DESC, id) = 1"
register("dedupe_max_mean", BEST.format("point"))(_deduped("max_mean"))
register("dedupe_max_conc", BEST.format("alpha + beta"))(_deduped("max_concentration"))
register("dedupe_dempster", f""",
    o AS (SELECT *, (alpha - 1) / (alpha + beta) AS b, (beta - 1) / (alpha + beta) AS dd, 2 / (alpha + beta) AS u FROM claims),
    m AS (SELECT {FIRST}, product(u) AS u, product(b + u) - product(u) AS b, product(dd + u) - product(u) AS dd, count(*) AS members FROM o GROUP BY subject, key)
    SELECT id, subject, key, round((b * 2 / u + 1) / ((b + dd) * 2 / u + 2), 6) AS mean, members FROM m""")(
    lambda spark, d: combination.dedupe(events_beliefs(spark, d), "dempster").select("id", "subject", "key", r6(C.mean(F.col("alpha"), F.col("beta"))).alias("mean"), "members")
)

SIMILAR_SQL = f"""
    WITH RECURSIVE t AS (
        SELECT 'turn-' || lpad(conv_id::VARCHAR, 8, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS id, conv_id, role, turn, {TOKENS_SQL.format("text")} AS a FROM conversations),
    e AS (SELECT x.id AS i, y.id AS j FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.role = y.role
          WHERE {JACCARD_SQL.format(a="x.a", b="y.a")} >= 0.15),
    r AS (SELECT id AS i, id AS j FROM t UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
    c AS (SELECT i AS id, min(j) AS c FROM r GROUP BY i),
    m AS (SELECT c.c, t.id, t.turn, count(*) OVER (PARTITION BY c.c) AS members FROM c JOIN t USING (id) QUALIFY row_number() OVER (PARTITION BY c.c ORDER BY turn DESC, t.id) = 1)
    SELECT id, members FROM m
"""


@register("dedupe_similarity", SIMILAR_SQL, claims=False)
def dedupe_similarity(spark, d):
    return combination.dedupe(views.convo_claims(spark, d), "weighted_avg", cutoff=0.15).select("id", "members")


@register("synthesize_as", "SELECT subject, round(sum(weight * alpha) / sum(weight), 6) AS alpha, round(sum(weight * beta) / sum(weight), 6) AS beta, count(*) AS members FROM claims GROUP BY subject")
def synthesize_as(spark, d):
    rows = combination.synthesize_as(events_beliefs(spark, d), "user", "event.summary", "weighted_avg", by=["subject"])
    return rows.select("subject", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "members")


# joins and override

EVIDENCE_SQL = """
    WITH o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderstatus FROM orders),
    l AS (SELECT * FROM o WHERE o_orderstatus = 'F'), r AS (SELECT * FROM o WHERE o_orderstatus = 'O'),
    m AS (SELECT l.o_orderkey AS a, r.o_orderkey AS b FROM l JOIN r ON l.before = r.o_orderkey UNION ALL SELECT l.o_orderkey, r.o_orderkey FROM l JOIN r ON r.before = l.o_orderkey
          UNION ALL SELECT l.o_orderkey, r.o_orderkey FROM l JOIN r ON l.before = r.before)
    SELECT DISTINCT 'ord-' || lpad(k::VARCHAR, 10, '0') AS id FROM (SELECT a AS k FROM m UNION ALL SELECT b FROM m)
"""


def _sides(spark, d):
    claims = events_claims(spark, d)
    return claims.where(P.key_eq("event.purchase") & P.value_eq("v", 1)), claims.where(P.key_eq("event.error") & P.value_eq("v", 3))


SIDES_SQL = ", l AS (SELECT * FROM claims WHERE key = 'event.purchase' AND v = 1), r AS (SELECT * FROM claims WHERE key = 'event.error' AND v = 3)"


@register("join_subject", f"{SIDES_SQL} SELECT id FROM l WHERE subject IN (SELECT subject FROM r) UNION ALL SELECT id FROM r WHERE subject IN (SELECT subject FROM l)")
def join_subject(spark, d):
    return joins.join_subject(*_sides(spark, d)).select("id")


@register("join_scope", ", l AS (SELECT * FROM claims WHERE key = 'event.purchase'), r AS (SELECT * FROM claims WHERE key = 'event.error' AND amount > 40) SELECT id FROM l WHERE entity IN (SELECT entity FROM r WHERE entity IS NOT NULL) UNION ALL SELECT id FROM r WHERE entity IN (SELECT entity FROM l WHERE entity IS NOT NULL)")
def join_scope(spark, d):
    claims = events_claims(spark, d)
    return joins.join_scope(claims.where(P.key_eq("event.purchase")), claims.where(P.key_eq("event.error") & P.value_gt("amount", 40))).select("id")


@register("join_evidence", EVIDENCE_SQL, claims=False)
def join_evidence(spark, d):
    claims = views.orders_claims(spark, d)
    return joins.join_evidence(claims.where("value_text = 'F'"), claims.where("value_text = 'O'")).select("id")


@register("override", ", l AS (SELECT * FROM claims WHERE status = 'candidate'), r AS (SELECT * FROM claims WHERE status = 'validated') SELECT id FROM l UNION ALL SELECT id FROM r WHERE (subject, key) NOT IN (SELECT (subject, key) FROM l)")
def override(spark, d):
    claims = events_beliefs(spark, d)
    return joins.override(claims.where("status = 'candidate'"), claims.where("status = 'validated'")).select("id")


# aggregation


@register("alpha_count_where", "SELECT count(*) FILTER (v = 1) AS n FROM claims")
def alpha_count_where(spark, d):
    return A.alpha(events_claims(spark, d), A.count_where(P.value_eq("v", 1)))


@register("alpha_sum_avg", "SELECT key AS group_key, round(sum(amount), 4) AS total, round(avg(CASE WHEN won IS NULL THEN 0 ELSE won::INT END), 6) AS mean_won FROM claims GROUP BY key")
def alpha_sum_avg(spark, d):
    core = {"total": F.round(A.sum_of("value.amount")["value"], 4), "mean_won": F.round(A.avg_of("value.won")["value"], 6)}
    return A.group_by(events_claims(spark, d), "key", core)


@register("alpha_min_max", "SELECT key AS group_key, min(amount) AS least, max(k)::DOUBLE AS most, min(subject) AS first, max(source) AS last FROM claims GROUP BY key")
def alpha_min_max(spark, d):
    """Of numbers and of texts."""
    core = {"least": A.min_of("value.amount")["value"], "most": A.max_of("value.k")["value"], "first": A.min_of("subject")["text"], "last": A.max_of("source")["text"]}
    return A.group_by(events_claims(spark, d), "key", core)


@register("alpha_group_scope", "SELECT entity AS group_key, count(*) AS n FROM claims WHERE entity IS NOT NULL GROUP BY entity")
def alpha_group_scope(spark, d):
    return A.group_by(events_claims(spark, d), "scope.entityId", A.count())


@register("alpha_group_value", "SELECT v::VARCHAR AS group_key, count(*) AS n FROM claims GROUP BY v")
def alpha_group_value(spark, d):
    return A.group_by(events_claims(spark, d), "value.v", A.count())


@register("alpha_group_rate", "SELECT subject AS group_key, (count(*) FILTER (v = 1) + 1)::DOUBLE AS alpha, (count(*) FILTER (v <> 1 AND amount > 10) + 1)::DOUBLE AS beta FROM claims GROUP BY subject")
def alpha_group_rate(spark, d):
    return A.group_by(events_claims(spark, d), "subject", A.rate(P.value_eq("v", 1), P.value_gt("amount", 10)))


WILSON = "CASE WHEN n <= 0 THEN 0 ELSE (h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((h / n * (1 - h / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) END"
RATES_SQL = ", b AS (SELECT subject, count(*) FILTER (won)::DOUBLE AS h, count(*) FILTER (won IS NOT NULL)::DOUBLE AS n FROM claims GROUP BY subject)"


@register("binary_rate_wilson", f"{RATES_SQL} SELECT subject AS group_key, h + 1 AS alpha, n - h + 1 AS beta, round({WILSON}, 6) AS wilson FROM b")
def binary_rate_wilson(spark, d):
    rows = A.group_by(events_claims(spark, d), "subject", A.binary_rate("value.won"))
    hits = F.col("alpha") - 1
    return rows.withColumn("wilson", r6(C.wilson_lower(hits, hits + F.col("beta") - 1)))


def _reweighted(make, core=None):
    def run(spark, d):
        claims = events_claims(spark, d)
        aggregates = A.group_by(claims, "subject", core() if core else A.binary_rate("value.won"))
        scored = claims.withColumn("score", P.value_eq("v", 2).cast("double") + 0.5)
        return A.join_aggregate(scored, aggregates, "subject", make(aggregates)).select("id", r6("score").alias("score"))

    return run


SCORED_SQL = "(CASE WHEN v = 2 THEN 1 ELSE 0 END + 0.5)"
COUNTS_SQL = ", b AS (SELECT subject, count(*) AS n FROM claims GROUP BY subject)"
register("join_aggregate_wilson", f"{RATES_SQL} SELECT id, round({SCORED_SQL} * {WILSON}, 6) AS score FROM claims JOIN b USING (subject)")(_reweighted(lambda _: A.wilson_floor))
register("reweight_mean", f"{RATES_SQL} SELECT id, round({SCORED_SQL} * (h + 1) / (n + 2), 6) AS score FROM claims JOIN b USING (subject)")(_reweighted(lambda _: A.multiply_mean))
register("reweight_multiply", f"{COUNTS_SQL} SELECT id, round({SCORED_SQL} * n, 6)::DOUBLE AS score FROM claims JOIN b USING (subject)")(_reweighted(lambda _: A.multiply, A.count))
register("reweight_normalize", f"{COUNTS_SQL} SELECT id, round({SCORED_SQL} * n / (SELECT max(n) FROM b), 6)::DOUBLE AS score FROM claims JOIN b USING (subject)")(_reweighted(A.normalize, A.count))
register("reweight_boost", f"{COUNTS_SQL} SELECT id, round({SCORED_SQL} + n * 0.1, 6)::DOUBLE AS score FROM claims JOIN b USING (subject)")(_reweighted(lambda _: A.boost(0.1), A.count))


# composition


def _few(spark, d):
    return ranking.rho(views.convo_claims(spark, d), "jaccard", QUERY, ordered=False)


FEW_SQL = f"""
    WITH t AS (SELECT conv_id, turn, text, {TOKENS_SQL.format("text")} AS a FROM conversations),
    s AS (SELECT conv_id * 1000 + turn AS place, text, {JACCARD_SQL.format(a="a", b=_Q)} AS score FROM t),
    c AS (SELECT {{0}} AS body FROM s)
    SELECT '{{1}}' AS format, substr(body, 1, 1600) AS content, ceil(least(length(body), 1600) / 4.0)::INTEGER AS token_count FROM c
"""


@register("kappa_markdown", FEW_SQL.format("string_agg('- ' || text, chr(10) ORDER BY score DESC, place)", "markdown"), claims=False)
def kappa_markdown(spark, d):
    return composition.kappa(_few(spark, d), "markdown", 400, dedup_threshold=1.01)


@register("kappa_text", FEW_SQL.format("string_agg(text, chr(10) ORDER BY score DESC, place)", "text"), claims=False)
def kappa_text(spark, d):
    return composition.kappa(_few(spark, d), "text", 400, dedup_threshold=1.01)


@register("kappa_json")
def kappa_json(spark, d):
    return composition.kappa(_few(spark, d), "json", 400)


@register("kappa_dedup")
def kappa_dedup(spark, d):
    return composition.kappa(_few(spark, d), "xml", 400, dedup_threshold=0.3)
