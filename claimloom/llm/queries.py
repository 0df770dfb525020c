"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard_join, language_id, mixing, packing, simhash, suffix_tree, token_counts, topk, url_filters

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int, key: str = "doc_id"):
    """crc32 of an id as text, modulo ``of``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The words that the SQL was written with, which stays as it is: net/de/ and example.net/de/8 contradict the contract.
SQL_URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    made = chat.format_preferences(*chat.swapped_answers(table(spark, sf_dir, "conversations")))
    return made.withColumns({c: spans(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), str(TOKENIZER), window=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary"
    )


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree.score_texts(table(spark, sf_dir, "documents"), train=fold(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(3) == 1
    content = language_id.sample_texts(docs, ~held_out)
    return language_id.identify(docs, content).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=None, scale=1.0, seed="mix")
    return mixed.select(
        "doc_id", "source", "lang", "text", "n_chars", F.col("_copy").alias("copy"), F.col("_copies").alias("copies"), F.round("_place", 12).alias("place")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(TOKENIZER), limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_topk": op2_topk,
    "op3_fingerprints": op3_fingerprints,
    "op4_chat": op4_chat,
    "op5_packing": op5_packing,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_counts": op10_token_counts,
}



def _url_sql() -> str:
    """The template tree level by level, with the settings that ``judge_urls`` has by default."""
    fits = lambda rule: f"(r.host = '{rule.partition('/')[0]}' OR ends_with(r.host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    longest = sorted(SQL_URL_RULES, key=lambda r: -len(r[1]))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(rule)} THEN '{of((verdict, rule))}'" for verdict, rule in longest) + " END"
    levels = ""
    for d in range(5):
        levels += f"""
        c{d} AS (SELECT host, p, s[{d + 1}] AS x, sum(n) AS n, sum(m) AS m, sum(b) AS b FROM l{d} WHERE len(s) > {d} GROUP BY ALL),
        w{d} AS (SELECT *, count(*) OVER k AS kids, sum(n) OVER k AS all_n, sum(m) OVER k AS all_m, sum(b) OVER k AS all_b FROM c{d} WINDOW k AS (PARTITION BY host, p)),
        y{d} AS (SELECT host, p, x, CASE WHEN kids > 1 AND ((kids > 20 AND n < 0.02::DOUBLE * all_n) OR m = 0 OR all_m = m
            OR abs(b / greatest(m, 1) - (all_b - b) / greatest(all_m - m, 1)) <= 2.58::DOUBLE * sqrt((all_b + 1) / (all_m + 2) * (1 - (all_b + 1) / (all_m + 2)) * (1 / greatest(m, 1) + 1 / greatest(all_m - m, 1))))
            THEN '*' ELSE x END AS y FROM w{d}),
        l{d + 1} AS (SELECT l.host, shape, n, m, b, s, l.p || coalesce('/' || y, '') AS p FROM l{d} l LEFT JOIN y{d} y ON l.host = y.host AND l.p = y.p AND l.s[{d + 1}] = y.x),"""
    return rf"""
        WITH urls AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
                regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM urls),
        shaped AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(path, '(?i)[0-9a-f]*[0-9][0-9a-f]{{11,}}', '#', 'g'), '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), '/') AS shape FROM parts),
        known AS (SELECT doc_id AS page_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
        l0 AS (SELECT host, shape, count(*) AS n, count(bad) AS m, count(*) FILTER (bad) AS b, CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/') END AS s, '' AS p
            FROM shaped LEFT JOIN known USING (page_id) GROUP BY host, shape),{levels}
        named AS (SELECT *, p || CASE WHEN len(s) > 5 THEN '/**' ELSE '' END AS template FROM l5),
        prior AS (SELECT coalesce(sum(b) / nullif(sum(m), 0), 0) AS q FROM l0),
        judged AS (SELECT host, template, sum(m) AS m, (sum(b) + max(q) * 20) / (sum(m) + 20) AS purity FROM named, prior GROUP BY host, template)
        SELECT page_id, r.host, path, {case(lambda r: r[1])} AS rule, coalesce({case(lambda r: r[0])}, CASE WHEN j.m > 0 AND purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
            j.template, round(purity, 9) AS purity
        FROM (SELECT * FROM shaped) r JOIN named t ON r.host = t.host AND r.shape = t.shape JOIN judged j ON t.host = j.host AND t.template = j.template
    """


ORACLES: dict[str, str] = {
    "op1_url_filters": _url_sql(),
    "op2_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op4_chat": """
        WITH t AS (
            SELECT conv_id, turn, replace(replace(coalesce(role, 'user'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS role,
                replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS text FROM conversations WHERE conv_id IS NOT NULL),
        answers AS (SELECT conv_id, max(turn) AS stop FROM t WHERE role = 'assistant' GROUP BY conv_id),
        texts AS (SELECT t.conv_id, max(text) AS answer FROM t JOIN answers a ON t.conv_id = a.conv_id AND t.turn = a.stop WHERE role = 'assistant' GROUP BY t.conv_id),
        told AS (SELECT t.*, a.stop FROM t LEFT JOIN answers a USING (conv_id) WHERE a.stop IS NULL OR t.turn <= a.stop),
        sides AS (
            SELECT 'a' AS side, conv_id, turn, role, text FROM told
            UNION ALL
            SELECT 'b', told.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = stop THEN coalesce(x.answer, '') ELSE text END
            FROM told LEFT JOIN texts x ON x.conv_id = xor(told.conv_id, 1)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) AS pos FROM sides),
        common AS (
            SELECT a.conv_id, coalesce(min(a.pos) FILTER (a.role <> b.role OR a.text <> b.text) - 1, count(*)) AS k
            FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND a.pos = b.pos WHERE a.side = 'a' AND b.side = 'b' GROUP BY a.conv_id),
        drawn AS (SELECT p.*, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM placed p JOIN common USING (conv_id)),
        ends AS (SELECT *, sum(CASE WHEN pos > k THEN length(shown) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY pos) AS edge FROM drawn),
        joined AS (
            SELECT conv_id, side, max(k) AS k,
                coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos <= k), '') AS prompt,
                coalesce(string_agg(shown, '' ORDER BY pos) FILTER (pos > k), '') AS rest,
                coalesce(string_agg((edge - length(text) - 11)::BIGINT || '-' || (edge - 1)::BIGINT, ',' ORDER BY pos)
                         FILTER (pos > k AND role = 'assistant'), '') AS mask
            FROM ends GROUP BY conv_id, side)
        SELECT a.conv_id AS pair_id, a.k::INTEGER AS common_turns, a.prompt, a.rest AS chosen, b.rest AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask
        FROM joined a JOIN joined b USING (conv_id) WHERE a.side = 'a' AND b.side = 'b'
    """,
    "op8_mixing": """
        WITH sized AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS all_n, count(*) OVER () AS sources FROM documents GROUP BY source),
        rates AS (SELECT source, all_n / (sources * n) AS rate FROM sized),
        drawn AS (
            SELECT d.*, r.rate, ('0x' || substr(md5('mix:' || d.doc_id || '/0'), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
        counted AS (
            SELECT *, (SELECT count(*) FROM (SELECT k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (ORDER BY k) AS cdf
                       FROM range(0, 120) t(k)) WHERE cdf <= u) AS copies FROM drawn)
        SELECT doc_id, source, lang, text, n_chars, c::INTEGER AS copy, copies::INTEGER AS copies,
               round(('0x' || substr(md5('mix:' || doc_id || '#' || c), 1, 13))::BIGINT / 4503599627370496.0, 12) AS place
        FROM (SELECT *, unnest(range(0, copies)) AS c FROM counted WHERE copies > 0)
    """,
    "op9_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        e AS (SELECT doc_id, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT i, j, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS i, doc_id AS j FROM n UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i)
        SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, (SELECT min(j) FROM l WHERE l.i = n.doc_id AND same)) AS class_id,
               (SELECT count(*) FROM l WHERE l.i = n.doc_id) AS n_links, (SELECT min(j) FROM r WHERE r.i = n.doc_id) AS component_id
        FROM n
    """,
}
