"""Registered queries of the recipes, the write path, the audit trail and the overlay, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import confidence as C
from .functions import values as V
from .operators import chain, overlay, ranking, temporal, writing
from .operators import predicates as P
from .plans import ast, census, dsl, read
from .queries import AGE, KNOWN, TOKENS_SQL, r6, register
from .sources import records, store, views
from .sources.views import CLOCK, events_beliefs, events_claims

MERGED_SQL = """,
    valid AS (SELECT * FROM claims WHERE valid_from <= 1705000000000 AND (valid_to IS NULL OR 1705000000000 < valid_to)),
    reps AS (SELECT *, max(valid_from) OVER (PARTITION BY subject, key) AS newest FROM (
        SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY subject, key, v ORDER BY valid_from DESC, id) = 1)),
    kept AS (SELECT *, 0.5 * CASE WHEN v = 2 THEN 1 ELSE 0 END + 0.5 * pow(0.5, (1705000000000 - valid_from) / (90 * 86400000.0)) AS score
        FROM reps WHERE valid_from = newest AND status <> 'deprecated')
"""


@register("canonical_read", f"{MERGED_SQL} SELECT id, subject, key, v::VARCHAR AS value_json FROM kept")
def canonical_read(spark, d):
    return read.canonical_read(events_beliefs(spark, d), CLOCK).select("id", "subject", "key", "value_json")


@register("recall_topk", f"{MERGED_SQL} SELECT id, round(score, 6) AS score FROM kept ORDER BY kept.score DESC, id LIMIT 10")
def recall_topk(spark, d):
    rows = read.recall_ranked(events_beliefs(spark, d), 2, CLOCK, fn=ranking.exact)
    return ranking.top_k(rows, 10).select("id", r6("score").alias("score"))


@register("recall_explain", f"""{MERGED_SQL},
    served AS (SELECT id FROM kept WHERE score >= 0.45 ORDER BY score DESC, id LIMIT 10),
    told AS (
        SELECT c.id, CASE WHEN v.id IS NULL THEN 'tau-invalid' WHEN r.id <> c.id THEN 'merged-into' WHEN r.valid_from < r.newest OR r.status = 'deprecated' THEN 'deprecated-by' WHEN k.score < 0.45 THEN 'below-floor' WHEN s.id IS NULL THEN 'over-limit' ELSE 'served' END AS reason,
            r.id AS rep, CASE WHEN r.valid_from < r.newest THEN n.id END AS winner
        FROM claims c LEFT JOIN valid v USING (id) LEFT JOIN reps r ON v.subject = r.subject AND v.key = r.key AND v.v = r.v
        LEFT JOIN reps n ON n.subject = c.subject AND n.key = c.key AND n.valid_from = n.newest LEFT JOIN kept k ON k.id = c.id LEFT JOIN served s ON s.id = c.id)
    SELECT id, reason, CASE reason WHEN 'merged-into' THEN rep WHEN 'deprecated-by' THEN winner END AS target_id FROM told""")
def recall_explain(spark, d):
    rows = read.explain(events_beliefs(spark, d), 2, CLOCK, limit=10, floor=0.45, fn=ranking.exact)
    return rows.select("id", "reason", "target_id")


@register("lineage", "SELECT id, row_number() OVER (ORDER BY valid_from, seq) AS position FROM claims WHERE subject = 'user:3' AND key IN ('event.click', 'event.view')")
def lineage(spark, d):
    rows = read.lineage(events_beliefs(spark, d), "user:3", {"event.click", "event.view"})
    place = F.row_number().over(Window.orderBy("valid_from", "recorded_seq"))  # one subject's history
    return rows.select("id", place.cast("bigint").alias("position"))


@register("alias_map", "SELECT * FROM (VALUES ('event.view', 'event.touch'), ('event.click', 'event.touch'), ('event.old', 'event.touch'), ('to-tied', 'tied')) t(variant, canonical)", claims=False)
def alias_map(spark, d):
    found = read.alias_map(views.alias_claims(spark), CLOCK).map
    return spark.createDataFrame(sorted(found.items()), "variant string, canonical string")


@register("aliased_collisions", """,
    c AS (SELECT *, CASE WHEN key IN ('event.view', 'event.click') THEN 'event.touch' ELSE key END AS ck FROM claims WHERE status <> 'deprecated')
    SELECT subject, ck AS key, count(DISTINCT v) AS values FROM c GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def aliased_collisions(spark, d):
    from .operators.contradiction import cardinality_collisions

    aliases = read.alias_map(views.alias_claims(spark), CLOCK).map
    return cardinality_collisions(events_beliefs(spark, d), aliases=aliases).select("subject", F.col("canonical_key").alias("key"), "values")


@register("coverage", "SELECT * FROM (SELECT 'User' AS entity, (SELECT bool_or(contains(lower(subject || ' ' || key), 'user')) FROM claims) AS supported UNION ALL SELECT 'Zanzibar', (SELECT bool_or(contains(lower(subject || ' ' || key), 'zanzibar')) FROM claims)) t")
def coverage(spark, d):
    return read.coverage(events_beliefs(spark, d), read.entity_tokens("Where did User meet the Zanzibar crew?"))


@register("entity_tokens", """
    SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '\\b(?:[A-Z][a-zA-Z]+|[0-9]+[a-zA-Z]*)\\b')),
        lambda x: x NOT IN ('When', 'Which', 'Who', 'What', 'How', 'Where', 'Why', 'Did', 'Do', 'Does', 'Is', 'Are', 'Was', 'Were', 'The', 'I'))), ' ') AS entities
    FROM documents""", claims=False)
def entity_tokens(spark, d):
    docs = views.read(spark, d, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(read.entity_tokens_col(F.col("text"))), " ").alias("entities"))


# vocabulary reports

NAMES_SQL = f"""
    WITH names AS (SELECT p_name AS subject, p_type AS key FROM part UNION ALL SELECT n_name, 'nation.region' FROM nation),
    v AS (SELECT {{axis}} AS value, count(*) AS n, {TOKENS_SQL.format("{axis}")} AS t FROM names GROUP BY {{axis}}),
    s AS (SELECT a.value AS a, b.value AS b, a.n + b.n AS shared_n, CASE WHEN len(a.t || b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)) END AS score
        FROM v a JOIN v b ON a.value < b.value)
"""


@register("distinct_entities", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT n_name, count(*) FROM nation GROUP BY 1", claims=False)
def distinct_entities(spark, d):
    return census.distinct_entities(views.name_claims(spark, d), "subject", CLOCK)


@register("subject_census", NAMES_SQL.format(axis="subject") + "SELECT a, b, round(score, 6) AS score FROM s ORDER BY s.score DESC, a, b LIMIT 20", claims=False)
def subject_census(spark, d):
    return census.subject_census(views.name_claims(spark, d), CLOCK).select("a", "b", r6("score").alias("score"))


@register("key_census", NAMES_SQL.format(axis="key") + "SELECT a, b, round(score, 6) AS score FROM s ORDER BY s.score DESC, a, b LIMIT 20", claims=False)
def key_census(spark, d):
    return census.key_census(views.name_claims(spark, d), CLOCK).select("a", "b", r6("score").alias("score"))


@register("reconcile", NAMES_SQL.format(axis="key") + f""",
    c AS (SELECT r_name AS value, {TOKENS_SQL.format("r_name")} AS t FROM region UNION ALL SELECT value, t FROM v
          UNION ALL SELECT value || ' EXTRA', list_distinct(t || ['extra']) FROM v),
    m AS (SELECT c.value, v.value AS best, CASE WHEN len(c.t || v.t) = 0 THEN 1.0 ELSE len(list_intersect(c.t, v.t))::DOUBLE / len(list_distinct(c.t || v.t)) END AS score FROM c CROSS JOIN v
          QUALIFY row_number() OVER (PARTITION BY c.value ORDER BY score DESC, v.value) = 1)
    SELECT DISTINCT c.value, best, round(coalesce(score, 0), 6) AS score, CASE WHEN coalesce(score, 0) >= 0.9 THEN 'reuse' WHEN coalesce(score, 0) <= 0.5 THEN 'new' ELSE 'uncertain' END AS disposition
    FROM c LEFT JOIN m USING (value)""", claims=False)
def reconcile(spark, d):
    claims = views.name_claims(spark, d)
    keys = census.distinct_entities(claims, "key", CLOCK)
    wanted = views.read(spark, d, "region").select(F.col("r_name").alias("value")).unionByName(keys.select("value"))
    wanted = wanted.unionByName(keys.select(F.concat("value", F.lit(" EXTRA")).alias("value")))
    return census.reconcile(wanted, claims, "key", CLOCK).select("value", "best", r6("score").alias("score"), "disposition")


def _paired_sql(source: str) -> str:
    """All pairs of claims (id, subject, tokens a), with both detectors of merged subjects: ``split`` and ``leaked``."""
    return f"""
    WITH RECURSIVE t AS ({source}),
    p AS (SELECT x.id AS x, x.subject AS sx, y.id AS y, y.subject AS sy, len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(x.a || y.a)) AS score FROM t x JOIN t y ON x.id <> y.id),
    sizes AS (SELECT subject, count(*) AS n FROM t GROUP BY subject),
    cut AS (SELECT sx AS subject, (min(score) + max(score)) / 2 AS edge FROM p WHERE sx = sy GROUP BY sx HAVING max(score) - min(score) >= 0.1),
    e AS (SELECT x, y FROM p JOIN cut ON sx = subject WHERE sx = sy AND score >= edge),
    r AS (SELECT id AS x, id AS y FROM t WHERE subject IN (SELECT subject FROM cut) UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT x, min(y) AS c FROM r GROUP BY x), k AS (SELECT t.subject, c.c, count(*) AS k FROM c JOIN t ON c.x = t.id GROUP BY ALL),
    split AS (SELECT subject, sum(k)::BIGINT AS n, count(*) AS clusters, count(*) FILTER (k >= 2) AS substantial FROM k JOIN sizes USING (subject) WHERE n >= 4 GROUP BY subject HAVING count(*) FILTER (k >= 2) >= 2),
    own AS (SELECT x, max(score) AS own FROM p WHERE sx = sy GROUP BY x),
    f AS (SELECT x, sx, sy, score FROM p WHERE sx <> sy QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, sy) = 1),
    g AS (SELECT f.*, f.score - coalesce(own, 0) AS gap FROM f LEFT JOIN own USING (x) WHERE f.score > coalesce(own, 0)),
    votes AS (SELECT sx AS subject, sy AS better, count(*) AS votes, max(gap) AS gap FROM g GROUP BY ALL),
    leaked AS (SELECT subject, n, sum(votes)::BIGINT AS affected, arg_max(better, (votes, gap, better)) AS better_subject FROM votes JOIN sizes USING (subject) GROUP BY subject, n HAVING n >= 4 AND sum(votes) < n * 0.5)
"""


BRANDS_SQL = f"SELECT 'part-' || lpad(p_partkey::VARCHAR, 8, '0') AS id, p_brand AS subject, {TOKENS_SQL.format('p_name')} AS a FROM part"


@register("reverse_reconcile_a", _paired_sql(BRANDS_SQL) + "SELECT * FROM split", claims=False)
def reverse_reconcile_a(spark, d):
    return census.value_clusters(views.brand_claims(spark, d), CLOCK)


@register("reverse_reconcile_b", _paired_sql(BRANDS_SQL) + "SELECT subject, n, affected FROM leaked", claims=False)
def reverse_reconcile_b(spark, d):
    return census.misplaced(views.brand_claims(spark, d), CLOCK).select("subject", "n", "affected")


def _alike_sql(axis: str) -> str:
    return f"(SELECT a, b, round(score, 6) AS score, shared_n::BIGINT AS affected FROM ({NAMES_SQL.format(axis=axis)} SELECT a, b, score, shared_n FROM s ORDER BY score DESC, a, b LIMIT 20))"


NAMED_SQL = """
    SELECT 'part-' || lpad(p_partkey::VARCHAR, 8, '0') AS id, p_name AS subject, p_type AS key, p_size::VARCHAR AS v FROM part
    UNION ALL SELECT 'nation-' || lpad(n_nationkey::VARCHAR, 8, '0'), n_name, 'nation.region', n_regionkey::VARCHAR FROM nation
"""


@register("audit_proposals", f"""{_paired_sql(f"SELECT id, subject, [v] AS a FROM ({NAMED_SQL})")}
    SELECT 'key-alias' AS kind, a || '|' || b AS entities, score, affected AS claims_affected FROM {_alike_sql("key")}
    UNION ALL SELECT 'subject-fragmentation', a || '|' || b, score, affected FROM {_alike_sql("subject")}
    UNION ALL SELECT 'cardinality-declare', subject || '|' || key, NULL, count(DISTINCT v) FROM ({NAMED_SQL}) GROUP BY subject, key HAVING count(DISTINCT v) > 1
    UNION ALL SELECT 'subject-over-merge', subject || '|' || better_subject, NULL, 0 FROM leaked
    UNION ALL SELECT 'subject-over-merge', subject, NULL, 0 FROM split""", claims=False)
def audit_proposals(spark, d):
    told = census.audit(views.name_claims(spark, d), CLOCK)
    return told.select("kind", F.array_join("entities", "|").alias("entities"), r6("score").alias("score"), "claims_affected")


# the write path

FOLD_SQL = """,
    items AS (SELECT *, row_number() OVER (PARTITION BY subject, key ORDER BY seq) AS n FROM claims),
    fold AS (
        SELECT subject, key, 0::BIGINT AS n, []::STRUCT(id VARCHAR, v BIGINT, point DOUBLE)[] AS live, NULL::VARCHAR AS id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS conflict, NULL::VARCHAR AS gone FROM (SELECT DISTINCT subject, key FROM items)
        UNION ALL
        SELECT subject, key, n, CASE WHEN outcome = 'committed' AND status = 'validated' THEN kept || [{'id': id, 'v': v, 'point': point}] ELSE kept END, id, outcome, conflict, gone FROM (
            SELECT s.*, CASE WHEN gone IS NULL THEN live ELSE list_filter(live, lambda x: x.id <> gone) END AS kept FROM (
                SELECT i.subject, i.key, i.n, i.id, i.v, i.point, i.status, f.live, c.id AS conflict, %s
                FROM fold f JOIN items i ON i.subject = f.subject AND i.key = f.key AND i.n = f.n + 1,
                LATERAL (SELECT list_filter(f.live, lambda x: x.v <> i.v)[1] AS c)) s))
    SELECT id, outcome, conflict AS conflict_id, gone AS deprecated_id FROM fold WHERE n > 0
"""


def _fold_sql(decision: str) -> str:
    return FOLD_SQL % decision


@register("commit_reject", _fold_sql("CASE WHEN c.point >= i.point THEN 'rejected' ELSE 'committed' END AS outcome, NULL::VARCHAR AS gone"))
def commit_reject(spark, d):
    return writing.decisions(events_beliefs(spark, d), None, "reject_on_contradiction")


@register("commit_resolve_lower", _fold_sql("'committed' AS outcome, CASE WHEN i.point > c.point THEN c.id END AS gone"))
def commit_resolve_lower(spark, d):
    return writing.decisions(events_beliefs(spark, d), None, "accept_and_resolve", "deprecate_lower")


@register("commit_mark", _fold_sql("'committed' AS outcome, NULL::VARCHAR AS gone"))
def commit_mark(spark, d):
    return writing.decisions(events_beliefs(spark, d), None, "accept_but_mark")


@register("commit_conservation", f"""{FOLD_SQL.rpartition("SELECT id, outcome")[0] % "CASE WHEN c.point >= i.point THEN 'rejected' ELSE 'committed' END AS outcome, NULL::VARCHAR AS gone"}
    SELECT key, count(*) FILTER (outcome = 'committed') AS committed, count(*) FILTER (outcome = 'rejected') AS rejected, 0::BIGINT AS duplicate FROM fold WHERE n > 0 GROUP BY key""")
def commit_conservation(spark, d):
    """Every item of a batch has one outcome: counts by key."""
    batch = events_beliefs(spark, d)
    told = writing.commit_batch(batch, None, "reject_on_contradiction")
    return batch.select("id", "key").join(told, "id").groupBy("key").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("committed", "rejected", "duplicate")))


@register("idempotent_batch", "SELECT id, CASE WHEN min(id) OVER w <> id THEN min(id) OVER w END AS duplicate_of FROM claims WINDOW w AS (PARTITION BY key, k)")
def idempotent_batch(spark, d):
    batch = events_claims(spark, d).withColumns({"writer": F.lit("w"), "idempotency_key": F.get_json_object("value_json", "$.k")})
    return writing.idempotent(batch, None, CLOCK).select("id", "duplicate_of")


@register("promote_lifecycle", """,
    q AS (SELECT id, CASE k % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'provisional' ELSE 'deprecated' END AS goal, status FROM claims),
    r AS (SELECT *, list_position(['candidate', 'provisional', 'validated', 'deprecated'], goal) AS g, list_position(['candidate', 'provisional', 'validated', 'deprecated'], status) AS s FROM q)
    SELECT id, goal AS to, CASE WHEN g = 4 OR g > s THEN 'promoted' ELSE 'invalid_transition' END AS outcome FROM r UNION ALL SELECT 'nobody', 'validated', 'not_found'""")
def promote_lifecycle(spark, d):
    claims = events_claims(spark, d)
    k = F.get_json_object("value_json", "$.k").cast("bigint")
    asked = claims.select("id", F.when(k % 3 == 0, "validated").when(k % 3 == 1, "provisional").otherwise("deprecated").alias("to"))
    return writing.promote(claims, asked.unionByName(spark.createDataFrame([("nobody", "validated")], "id string, to string")))


@register("supersede", "SELECT id, CASE WHEN status = 'candidate' THEN 'deprecated' ELSE status END AS status FROM claims UNION ALL SELECT 'new-' || id, 'validated' FROM claims WHERE status = 'candidate'")
def supersede(spark, d):
    claims = events_beliefs(spark, d)
    new = claims.where("status = 'candidate'").withColumns({"supersedes": F.col("id"), "id": F.concat(F.lit("new-"), "id"), "status": F.lit("validated")})
    return writing.supersede(claims, new).select("id", "status")


@register("attribution", f"""{MERGED_SQL},
    told AS (
        SELECT c.id, c.subject, c.key, r.id AS rep,
            CASE WHEN v.id IS NULL THEN 'tau-invalid' WHEN r.id <> c.id THEN 'merged' WHEN r.valid_from < r.newest THEN 'deprecated' ELSE 'served' END AS disposition
        FROM claims c LEFT JOIN valid v USING (id) LEFT JOIN reps r ON v.subject = r.subject AND v.key = r.key AND v.v = r.v),
    gone AS (SELECT subject, key, string_agg(id, ',' ORDER BY id) AS ids FROM told WHERE disposition = 'deprecated' GROUP BY ALL)
    SELECT id, CASE disposition WHEN 'merged' THEN 'duplicate' WHEN 'served' THEN CASE WHEN ids IS NULL THEN 'committed' ELSE 'superseded' END ELSE 'committed' END AS action,
        CASE disposition WHEN 'merged' THEN rep END AS merged_into, CASE disposition WHEN 'served' THEN coalesce(ids, '') ELSE '' END AS deprecated_ids
    FROM told LEFT JOIN gone USING (subject, key)""")
def attribution(spark, d):
    claims = events_beliefs(spark, d)
    return read.attribution(claims, claims, CLOCK).withColumn("deprecated_ids", F.array_join("deprecated_ids", ","))


# the audit trail

REASON = 'line one\n\t"quoted" \\ and \x01'


def _log(spark, d) -> DataFrame:
    """One event a claim, some of them with a reason that JSON must escape."""
    rows = events_beliefs(spark, d)
    none = F.lit(None).cast("string")
    reason = F.when(F.col("value_json") == "1", REASON)
    events = rows.select(F.lit("commit").alias("op"), F.col("key").alias("corpus_id"), F.lit("writer").alias("writer"), F.col("id").alias("claim_id"), none.alias("deprecated_id"), none.alias("to_status"), reason.alias("reason"), "recorded", "recorded_seq")
    return chain.build_chain(events)


CHAIN_SQL = """,
    e AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n,
            '["commit","' || key || '","writer","' || id || '",null,null,' || CASE v WHEN 1 THEN '"line one\\n\\t\\"quoted\\" \\\\ and \\u0001"' ELSE 'null' END || ',' || recorded || ',' || seq || ']' AS body FROM claims),
    h AS (SELECT key, 0::BIGINT AS n, '' AS hash FROM (SELECT DISTINCT key FROM e) UNION ALL SELECT e.key, e.n, sha256(e.body || h.hash) FROM h JOIN e ON e.key = h.key AND e.n = h.n + 1)
"""
BROKEN_SQL = "SELECT key AS corpus_id, count(*) AS entries, count(*) FILTER ({0}) = 0 AS intact, coalesce(min(n) FILTER ({0}), -1) AS broken_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS n FROM claims) GROUP BY key"


@register("hash_chain_verify", ", t AS (SELECT 1) " + BROKEN_SQL.format("key < 'event.d' AND seq % 501 = 77"))
def hash_chain_verify(spark, d):
    """Some corpora have a changed hash here and there, the others are intact."""
    changed = (F.col("corpus_id") < "event.d") & (F.col("recorded_seq") % 501 == 77)
    log = _log(spark, d).withColumn("entry_hash", F.when(changed, F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    return chain.verify_chain(log).fillna(-1, ["broken_at"])


@register("hash_chain", f"{CHAIN_SQL} SELECT h.key AS corpus_id, e.seq AS recorded_seq, h.hash AS entry_hash FROM h JOIN e ON e.key = h.key AND e.n = h.n")
def hash_chain(spark, d):
    return _log(spark, d).select("corpus_id", "recorded_seq", "entry_hash")


@register("hash_chain_tampered", ", t AS (SELECT 1) " + BROKEN_SQL.format("seq > 1000"))
def hash_chain_tampered(spark, d):
    forged = _log(spark, d).withColumn("writer", F.when(F.col("recorded_seq") > 1000, "forger").otherwise(F.col("writer")))
    return chain.verify_chain(forged).fillna(-1, ["broken_at"])


@register("merkle_root", f"""{CHAIN_SQL},
    tree AS (
        SELECT key, list(sha256(unhex('00') || hash::BLOB) ORDER BY n) AS nodes FROM h WHERE n > 0 GROUP BY key
        UNION ALL
        SELECT key, list_transform(range(0, (len(nodes) + 1) // 2), lambda j: CASE WHEN 2 * j + 2 <= len(nodes) THEN sha256(unhex('01' || nodes[2 * j + 1] || nodes[2 * j + 2])) ELSE nodes[2 * j + 1] END)
        FROM tree WHERE len(nodes) > 1)
    SELECT key AS corpus_id, nodes[1] AS root FROM tree WHERE len(nodes) = 1""")
def merkle_root(spark, d):
    return chain.merkle_roots(_log(spark, d))


# the overlay


@register("evidence_update", """,
    u AS (SELECT 'ev-' || lpad((event_id % 500)::VARCHAR, 10, '0') AS id, 0.5 * count(*) FILTER (event_type = 'click') AS a0 FROM events GROUP BY 1),
    o AS (SELECT user_id, 2.0 * count(*) FILTER (event_type IN ('purchase', 'signup')) AS a, 2.0 * count(*) FILTER (event_type = 'error') AS b FROM events GROUP BY 1),
    s AS (SELECT DISTINCT user_id, 'ev-' || lpad((event_id % 500)::VARCHAR, 10, '0') AS id FROM events WHERE event_type = 'view'),
    c AS (SELECT id, sum(a) AS a, sum(b) AS b FROM s JOIN o USING (user_id) GROUP BY id)
    SELECT id, round(alpha + coalesce(a0, 0) + coalesce(a, 0), 6)::DOUBLE AS alpha, round(beta + coalesce(b, 0), 6)::DOUBLE AS beta
    FROM claims LEFT JOIN (SELECT * FROM u WHERE a0 > 0) u USING (id) LEFT JOIN c USING (id) WHERE a0 IS NOT NULL OR a IS NOT NULL""")
def evidence_update(spark, d):
    claims = events_beliefs(spark, d)
    events = views.read(spark, d, "events")
    target = F.concat(F.lit("ev-"), F.lpad((F.col("event_id") % 500).cast("string"), 10, "0"))
    seen = events.select(F.col("user_id").cast("string").alias("episode"), target.alias("claim_id"), "event_type")
    outcomes = events.where("event_type in ('purchase', 'signup', 'error')").select(
        F.col("user_id").cast("string").alias("episode"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("result"), F.lit(None).cast("double").alias("weight")
    )
    rows = overlay.evidence_update(claims, seen.where("event_type = 'click'"), seen.where("event_type = 'view'"), outcomes)
    return rows.select("id", r6("alpha").alias("alpha"), r6("beta").alias("beta"))


BOUND = "{a} / ({a} + {b}) - 1.645 * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
TIER = "CASE WHEN {0} >= 0.65 THEN 'validated' WHEN {0} >= 0.5 THEN 'provisional' ELSE 'candidate' END"


@register("lower_bound_tiers", f"SELECT id, round({BOUND.format(a='alpha', b='beta')}, 6) AS bound, {TIER.format('(' + BOUND.format(a='alpha', b='beta') + ')')} AS tier FROM claims")
def lower_bound_tiers(spark, d):
    return events_beliefs(spark, d).select("id", r6(overlay.bound()).alias("bound"), overlay.tier(overlay.bound()).alias("tier"))


@register("consolidate_plan", f""",
    act AS (SELECT *, count(*) OVER (PARTITION BY subject, key, v) AS members FROM claims WHERE status <> 'deprecated'),
    g AS (SELECT min(id) AS target, sum(weight * alpha) / sum(weight) AS a, sum(weight * beta) / sum(weight) AS b, count(*) AS members FROM act WHERE members >= 3 GROUP BY subject, key, v)
    SELECT 'derive' AS op, target, {TIER.format('(' + BOUND.format(a='a', b='b') + ')')} AS to, members FROM g
    UNION ALL SELECT 'promote', id, 'deprecated', 1 FROM act WHERE members >= 3
    UNION ALL SELECT 'promote', id, tier, 1 FROM (SELECT *, {TIER.format('(' + BOUND.format(a='alpha', b='beta') + ')')} AS tier FROM act WHERE members < 3)
    WHERE list_position(['candidate', 'provisional', 'validated'], tier) > list_position(['candidate', 'provisional', 'validated'], status)""")
def consolidate_plan(spark, d):
    return overlay.plan_consolidation(events_beliefs(spark, d)).select("op", "target", "to", "members")


@register("dream_selection", """,
    d AS (SELECT *, CASE k % 8 WHEN 1 THEN '1' WHEN 2 THEN '3' WHEN 3 THEN '7' WHEN 4 THEN 'deep' END AS level FROM claims WHERE k % 3 < 2)
    SELECT id FROM d WHERE (level IS NULL OR level = '1') AND NOT (k % 4 = 1 AND status = 'candidate') ORDER BY recorded DESC, point DESC, seq LIMIT 200""")
def dream_selection(spark, d):
    """Of two of three runs; some claims are dreams of several depths, some of these unvalidated."""
    k = F.get_json_object("value_json", "$.k").cast("bigint")
    level = F.when(k % 8 == 1, "1").when(k % 8 == 2, "3").when(k % 8 == 3, "7").when(k % 8 == 4, "deep")
    tags = F.when(level.isNull(), F.array(F.lit("dreamy"))).otherwise(F.array(F.lit("x"), F.concat(F.lit("dream-depth:"), level)))
    claims = events_claims(spark, d).withColumns({"tags": tags, "workflow": F.when(k % 4 == 1, overlay.DREAM), "run_id": F.concat(F.lit("run-"), k % 3)})
    return overlay.select_dreams(claims, spark.createDataFrame([("run-0",), ("run-1",), ("run-9",)], "run_id string")).select("id")


# distributions


@register("opinions", "SELECT id, round((alpha - 1) / (alpha + beta), 6) AS belief, round((beta - 1) / (alpha + beta), 6) AS disbelief, round(2 / (alpha + beta), 6) AS uncertainty, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 6) AS variance FROM claims")
def opinions(spark, d):
    o = C.beta_to_opinion(F.col("alpha"), F.col("beta"))
    rows = events_beliefs(spark, d).withColumn("o", o)
    return rows.select("id", r6("o.b").alias("belief"), r6("o.d").alias("disbelief"), r6("o.u").alias("uncertainty"), r6(C.variance(F.col("alpha"), F.col("beta"))).alias("variance"))


@register("extend_to_frame", "SELECT id, round(alpha - 1 + 1, 6) AS a1, round((beta - 1) * 0.6::DOUBLE + 0.6::DOUBLE, 6) AS a2, round((beta - 1) * 0.4::DOUBLE + 0.4::DOUBLE, 6) AS a3 FROM claims")
def extend_to_frame(spark, d):
    x = C.extend_to_frame(F.col("alpha"), F.col("beta"), [0.5, 0.3, 0.2])
    return events_beliefs(spark, d).withColumn("x", x).select("id", *(r6(F.col("x")[i]).alias(f"a{i + 1}") for i in range(3)))


# whole pipelines


@register("worked_query", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS v, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, (epoch_us(o_orderdate) // 1000) AS ms FROM orders),
    s AS (SELECT *, CASE WHEN v = 'F' THEN 1.0 ELSE 0.0 END AS score, pow(0.5, greatest(0, 1705000000000 - ms) / (86400000.0 * 36500)) AS effective FROM o WHERE c % 7 = 3 AND c < 60 AND v IN ('F', 'P')),
    one AS (SELECT before AS k FROM s WHERE before NOT IN (SELECT k FROM s)),
    two AS (SELECT DISTINCT o.before AS k FROM one JOIN o USING (k) WHERE o.before NOT IN (SELECT k FROM s) AND o.before NOT IN (SELECT k FROM one))
    SELECT 'ord-' || lpad(k::VARCHAR, 10, '0') AS id, score::DOUBLE AS score, round(effective, 6) AS effective, 0 AS depth FROM s
    UNION ALL SELECT 'ord-' || lpad(k::VARCHAR, 10, '0'), 0, NULL, 1 FROM one UNION ALL SELECT 'ord-' || lpad(k::VARCHAR, 10, '0'), 0, NULL, 2 FROM two""", claims=False)
def worked_query(spark, d):
    """Valid claims of some subjects, decayed, still confident and of certain values, ranked, with what they cite."""
    tree = ast.pipe(
        "orders",
        ("tau", {"mode": "valid", "at": CLOCK}),
        ("sigma", {"predicate": {"op": "subjectIn", "value": [f"cust:{i}" for i in range(60) if i % 7 == 3]}}),
        ("delta", {"policy": temporal.exponential(36500), "now": CLOCK}),
        ("sigma", {"predicate": {"op": "and", "parts": [{"op": "confidenceGt", "value": 0.3}, {"op": "or", "parts": [{"op": "valueMatches", "value": "F"}, {"op": "valueMatches", "value": "P"}]}]}}),
        ("rho", {"similarity": "jaccard", "query": "f"}),
        ("gamma", {"depth": 2}),
    )
    rows = ast.compile(ast.parse(ast.serialize(tree)), lambda _: views.orders_claims(spark, d))
    return rows.select("id", "score", r6("effective").alias("effective"), "depth")


@register("dsl_count", f"SELECT count(*) AS n FROM claims WHERE key = 'event.click' AND status = 'validated' AND point * pow(0.5, {AGE} / 7) > 0.25")
def dsl_count(spark, d):
    text = "where key = event.click | where status = validated | decay exp 7 | where confidence > 0.25 | count"
    return ast.compile(dsl.parse("events", text, CLOCK), lambda _: events_beliefs(spark, d))


@register("source_half_lives", f"SELECT id, round(point * pow(0.5, {AGE} / CASE source WHEN 'manual' THEN 180 WHEN 'verification' THEN 90 WHEN 'workflow' THEN 60 WHEN 'heuristic' THEN 30 WHEN 'llm' THEN 14 ELSE 60 END), 6) AS effective FROM claims")
def source_half_lives(spark, d):
    half = F.create_map(*(F.lit(x) for pair in temporal.SOURCE_HALF_LIVES.items() for x in pair))[F.col("source")]
    age = F.greatest(F.lit(0), F.lit(CLOCK) - F.col("recorded")) / 86_400_000.0
    return events_beliefs(spark, d).select("id", r6(C.point() * F.pow(F.lit(0.5), age / half)).alias("effective"))


@register("canonical_json", "SELECT event_id AS n, '{\"a\":' || event_id || ',\"b\":[1,true,null]}' AS canonical FROM events", claims=False)
def canonical_json(spark, d):
    rows = views.read(spark, d, "events").select(F.col("event_id").alias("n"))
    return rows.select("n", V.canonical_json(F.concat(F.lit('{ "b" : [1, true, null], "a": '), F.col("n").cast("string"), F.lit("}"))).alias("canonical"))


@register("pushdown_differential", "SELECT id, true AS plain, true AS hinted FROM claims WHERE subject = 'user:9' AND key IN ('event.view', 'event.error') AND v = 1")
def pushdown_differential(spark, d):
    """The same expression with and without hints at its leaf, side by side."""
    claims = events_beliefs(spark, d)
    parts = [{"op": "subjectEq", "value": "user:9"}, {"op": "keyIn", "value": ["event.view", "event.error"]}]
    tree = ast.pipe("events", ("sigma", {"predicate": {"op": "and", "parts": parts}}), ("sigma", {"predicate": {"op": "valueMatches", "value": 1}}))
    asked = lambda _, hints: claims.where(P.and_(P.subject_eq(hints["subject"]), P.key_in(hints["keys"])))
    plain = ast.compile(tree, lambda _: claims).select("id", F.lit(True).alias("plain"))
    hinted = ast.compile(tree, None, asked).select("id", F.lit(True).alias("hinted"))
    return plain.join(hinted, "id", "full").select("id", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("hinted", F.lit(False)).alias("hinted"))


# sources and stores


@register("read_plan", "SELECT id FROM claims WHERE subject = 'user:4' AND key IN ('event.view', 'event.click') AND recorded <= 1705000000000 AND status IN ('validated')")
def read_plan(spark, d):
    plan = store.query_plan(subject="user:4", keys=["event.view", "event.click"], recorded_at_most=CLOCK, statuses=["validated"], run_ids=[])
    return events_beliefs(spark, d).where(plan).select("id")


@register("read_by_ids", "SELECT * FROM (VALUES ('ev-0000000007', 0), ('ev-0000000003', 2)) t(id, position)", claims=False)
def read_by_ids(spark, d):
    return read.read_by_ids(events_beliefs(spark, d), ["ev-0000000007", "nobody", "ev-0000000003"]).select("id", "position")


def _lines(spark, d, text) -> DataFrame:
    events = views.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    bad = F.when(F.col("event_id") % 10 == 0, "not json").when(F.col("event_id") % 10 == 1, "  ").otherwise(text)
    return records.parse_lines(events.select(bad.alias("value")))


GOOD = "event_id % 10 > 1"


@register("import_jsonl", f"SELECT 'u' || user_id AS subject, event_type AS key, count(*) AS n, round(sum((k % 10) / 10.0::DOUBLE), 6) AS p FROM (SELECT DISTINCT user_id, event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE {GOOD}) GROUP BY ALL", claims=False)
def import_jsonl(spark, d):
    record = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("key"), F.col("event_id").alias("value"), ((F.col("k") % 10) / 10.0).alias("confidence")))
    claims = records.map_records(_lines(spark, d, record), "jsonl")
    return claims.groupBy("subject", "key").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("p"))


@register("import_edges", f"SELECT 'u' || user_id AS subject, event_id AS n, least(1, greatest(0, (k - 50) / 20.0::DOUBLE)) AS p FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE {GOOD}", claims=False)
def import_edges(spark, d):
    record = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("start"), F.col("event_type").alias("rel"), F.col("event_id").alias("end"), ((F.col("k") - 50) / 20.0).alias("weight")))
    return records.map_records(_lines(spark, d, record), "conceptnet").select("subject", F.col("value_json").cast("bigint").alias("n"), "p")


@register("import_summary", "SELECT count(*) FILTER (event_id % 10 <> 1) AS total, count(*) FILTER (event_id % 10 > 1) AS well_formed, count(*) FILTER (event_id % 10 = 0) AS skipped FROM events", claims=False)
def import_summary(spark, d):
    return records.import_summary(_lines(spark, d, F.to_json(F.struct("event_id"))))


@register("consolidated_statuses", f"""
    , act AS (SELECT *, count(*) OVER (PARTITION BY subject, key, v) AS members FROM claims WHERE status <> 'deprecated'),
    t AS (SELECT id, members, {TIER.format('(' + BOUND.format(a='alpha', b='beta') + ')')} AS tier FROM act)
    SELECT c.id, CASE WHEN members >= 3 THEN 'deprecated' WHEN list_position(['candidate', 'provisional', 'validated'], tier) > list_position(['candidate', 'provisional', 'validated'], status) THEN tier ELSE status END AS status
    FROM claims c LEFT JOIN t USING (id)""")
def consolidated_statuses(spark, d):
    claims = events_beliefs(spark, d)
    return overlay.apply_plan(claims, overlay.plan_consolidation(claims), CLOCK).where("id like 'ev-%'").select("id", "status")
