import math
import random
from collections import Counter

import pytest
from helpers import cite, claims, ids
from pyspark.sql import functions as F

from claimloom.functions import confidence as C
from claimloom.functions import values as V
from claimloom.operators import aggregation as A
from claimloom.operators import combination, composition, contradiction, joins, provenance, ranking, temporal
from claimloom.operators import predicates as P
from claimloom.queries import QUERIES
from claimloom.sources.views import events_claims

DAY = 86_400_000


def test_canonical_values():
    assert V.canonical({"b": 1.0, "a": [True, None, "x"]}) == '{"a":[true,null,"x"],"b":1}'
    assert V.canonical_number(1e21) == "1e+21" and V.canonical_number(0.1) == "0.1" and V.canonical_number(-0.0) == "0"
    with pytest.raises(ValueError):
        V.variant_path("a..b")


def test_value_predicates(spark):
    rows = claims(spark, [{"value": {"n": 5, "s": "abc", "z": None, "l": [1, {"x": 2}]}}, {"value": {"n": "5"}}, {"value": 7}])
    assert ids(rows.where(P.value_eq("n", 5))) == ["c000"]
    assert ids(rows.where(P.not_(P.value_eq("n", 5)))) == ["c001", "c002"]
    assert ids(rows.where(P.value_null("z"))) == ["c000"] and ids(rows.where(P.value_exists("z"))) == ["c000"]
    assert ids(rows.where(P.value_eq("l[1].x", 2))) == ["c000"]
    assert ids(rows.where(P.value_matches({"l": [1, {"x": 2}]}))) == ["c000"]
    assert ids(rows.where(P.value_matches({"l": [1]}))) == []
    assert ids(rows.where(P.value_matches(7))) == ["c002"]
    assert ids(rows.where(P.and_(P.value_eq("s", "abc"), P.value_gt("n", 4)))) == ["c000"]
    with pytest.raises(Exception, match="no number"):
        rows.where(P.value_gt("n", 4)).collect()
    with pytest.raises(Exception, match="no string"):
        rows.where(P.value_regex("n", "5")).collect()


def test_empty_lists_and_logic(spark):
    rows = claims(spark, [{}, {}])
    assert ids(rows.where(P.key_in([]))) == [] and ids(rows.where(P.tag_in([]))) == []
    assert len(ids(rows.where(P.and_()))) == 2 and ids(rows.where(P.or_())) == []


def test_time_slices_and_decay(spark):
    rows = claims(spark, [{"valid_from": 0, "valid_to": 10}, {"valid_from": 5, "recorded": 20}, {"valid_from": 11}])
    assert ids(temporal.tau_valid(rows, 5)) == ["c000", "c001"] and ids(temporal.tau_valid(rows, 10)) == ["c001"]
    assert ids(temporal.tau_known(rows, 10)) == [] and ids(temporal.tau_known(rows, 20)) == ["c001", "c002"]
    aged = temporal.delta(claims(spark, [{"recorded": 0}]), temporal.exponential(30), 90 * DAY).first()
    assert aged.effective == pytest.approx(0.1125)
    twice = temporal.delta(temporal.delta(claims(spark, [{"recorded": 0}]), temporal.step(1), 90 * DAY), temporal.none(), 90 * DAY).first()
    assert twice.effective == pytest.approx(0.9)  # the last policy holds


def test_blend_and_ranking(spark):
    rows = claims(spark, [{"value": "red apple"}, {"value": "green pear", "valid_from": 99_000}])
    first = ranking.rank_blend(rows.where("id = 'c000'"), ranking.jaccard, "zebra", 99_000).first()
    assert first.score == pytest.approx(0.4999955876242226)
    assert [r.id for r in ranking.rho(rows, "jaccard", "green pear").collect()] == ["c001", "c000"]
    assert ranking.rho(rows, "exact", "red apple").first().score == 1.0
    assert ranking.abstain_below_top(ranking.rho(rows, "jaccard", "zebra"), 0.5).count() == 0
    for bad in (lambda: ranking.rank_blend(rows, ranking.jaccard, "x", 0, alpha=2), lambda: ranking.relevance_floor(rows, 2), lambda: ranking.similarity("nope")):
        with pytest.raises((ValueError, KeyError)):
            bad()


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([0.0, 0.0], 1), ([1.0, 0.0], 2)], "v array<double>, i int")
    got = {r.i: r.s for r in rows.select("i", ranking.cosine_over("v", [0.0, 0.0])().alias("s")).collect()}
    assert got == {1: 1.0, 2: 0.5}
    missing = spark.createDataFrame([(None,)], "v array<double>")
    with pytest.raises(Exception, match="no embedding"):
        missing.select(ranking.cosine_over("v", [1.0, 0.0])()).collect()


def test_gamma_and_cycles(spark):
    rows = claims(spark, [{"id": "a", "evidence": cite("b")}, {"id": "b", "evidence": cite("c", "a")}, {"id": "c", "evidence": cite("d")}, {"id": "d"}])
    start = rows.where("id = 'a'").withColumn("score", F.lit(1.0))
    assert {r.id: r.depth for r in provenance.gamma(start, rows, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert provenance.would_create_cycle(rows, "d", ["b"]) and not provenance.would_create_cycle(rows, "x", ["a"])


def test_clusters_agreement(spark):
    rows = claims(spark, [{"value": v} for v in (1, 1, 1, 2, 3)])
    got = contradiction.clusters(rows, 0.5).first()
    assert got.agreement_ratio == pytest.approx(0.6) and got.distinct_values == 3
    assert contradiction.clusters(claims(spark, [{"value": 1}, {"value": 1}]), 0.5).count() == 0
    assert contradiction.pairs(rows, 0.5).count() == 7
    assert contradiction.clusters(rows, 0.5, cardinality={"k.a": "multi"}).count() == 0
    with pytest.raises(ValueError):
        contradiction.clusters(rows, 0.5, cardinality={"k.a": "some"})
    with pytest.raises(Exception, match="mixed"):
        contradiction.clusters(claims(spark, [{"value": 1}, {"value": 1, "p": 0.9}, {"value": 2}]), 0.5).collect()


def test_resolutions(spark):
    rows = claims(spark, [{"value": 1, "valid_from": 1}, {"value": 2, "valid_from": 5}, {"value": 3, "valid_from": 5}])
    out = contradiction.resolve_deprecate_older(rows, 0.5, now=9)
    assert {r.id: r.status for r in out.where("id like 'c%'").collect()} == {"c000": "deprecated", "c001": "validated", "c002": "validated"}
    assert out.where("key = 'contradiction.flag'").count() == 1  # the tie
    lower = contradiction.resolve_deprecate_lower(claims(spark, [{"value": 1, "alpha": 3}, {"value": 2}]), 0.5)
    assert lower.where("status = 'deprecated'").first().id == "c000"
    minority = contradiction.resolve_promote_consensus(claims(spark, [{"value": 1, "status": "candidate"}, {"value": 1}, {"value": 2}]), 0.5)
    assert {r.id: r.status for r in minority.collect()} == {"c000": "validated", "c001": "validated", "c002": "deprecated"}
    assert contradiction.resolve_flag_for_review(rows, 0.5).where("key = 'contradiction.flag'").count() == 3
    with pytest.raises(KeyError):
        contradiction.resolution("nope")


def test_pair_free_resolution_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [{"subject": f"s{rng.randrange(12)}", "value": rng.randrange(3), "valid_from": rng.randrange(6)} for _ in range(150)]
    got = {r.id: r.status for r in contradiction.resolve_deprecate_older(claims(spark, rows), 0.5, flags=False).collect()}
    for i, a in enumerate(rows):
        loses = any(b["subject"] == a["subject"] and b["value"] != a["value"] and b["valid_from"] > a["valid_from"] for b in rows)
        assert got[f"c{i:03}"] == ("deprecated" if loses else "validated")


@pytest.mark.parametrize(("rule", "want"), [("evidence_pooled", (7, 4)), ("weighted_avg", (3, 2)), ("max_mean", (3, 2))])
def test_pooling_golden(spark, rule, want):
    got = combination.dedupe(claims(spark, [{"alpha": 3, "beta": 2}] * 3), rule).first()
    assert (got.alpha, got.beta, got.members) == (pytest.approx(want[0]), pytest.approx(want[1]), 3)


def test_rules(spark):
    two = claims(spark, [{"alpha": 9, "beta": 1}, {"alpha": 80, "beta": 20}])
    assert combination.dedupe(two, "max_mean").first().alpha == 9 and combination.dedupe(two, "max_concentration").first().alpha == 80
    same = combination.dedupe(claims(spark, [{"alpha": 4, "beta": 3}, {"alpha": 1, "beta": 1}]), "dempster").first()
    assert (same.alpha, same.beta) == (pytest.approx(4), pytest.approx(3))  # a vacuous opinion changes nothing
    with pytest.raises(Exception, match="total conflict"):
        combination.dedupe(claims(spark, [{"alpha": 1e9, "beta": 1}, {"alpha": 1, "beta": 1e9}]), "dempster").collect()
    with pytest.raises(C.RemovedRule):
        combination.dedupe(two, "rule_max_confidence")
    with pytest.raises(Exception, match="scalar"):
        combination.dedupe(claims(spark, [{"p": 0.5}, {"p": 0.7}]), "evidence_pooled").collect()


def test_similarity_dedupe_is_single_link(spark):
    texts = ["a b c d", "a b c e", "a b e f", "x y z"]
    rows = claims(spark, [{"value": t, "valid_from": i} for i, t in enumerate(texts)])
    kept = combination.dedupe(rows, "weighted_avg", cutoff=0.6)
    assert ids(kept) == ["c002", "c003"]  # the chain's latest, and the rest
    into = {r.member_id: r.survivor_id for r in combination.merged_into(rows, kept, 0.6).collect()}
    assert into == {"c000": "c002", "c001": "c002"}


def test_order_does_not_matter(spark):
    rows = claims(spark, [{"subject": f"s{i % 5}", "value": i % 3, "alpha": 1 + i % 7, "beta": 1 + i % 4} for i in range(60)])
    one, many = (combination.dedupe(rows.repartition(n), "dempster").select("id", F.round("alpha", 9)).orderBy("id").collect() for n in (1, 17))
    assert one == many


def test_joins(spark):
    left = claims(spark, [{"id": "a", "subject": "x", "evidence": cite("q")}, {"id": "b", "subject": "y", "scope": {"entityId": "1"}}])
    right = claims(spark, [{"id": "p", "subject": "x", "evidence": cite("b")}, {"id": "q", "subject": "z"}, {"id": "r", "subject": "z", "evidence": cite("q"), "scope": {"entityId": "1"}}])
    assert ids(joins.join_subject(left, right)) == ["a", "p"]
    assert ids(joins.join_scope(left, right)) == ["b", "r"]
    assert ids(joins.join_evidence(left, right)) == ["a", "b", "p", "q", "r"]
    assert ids(joins.override(left, right)) == ["a", "b", "q"] or ids(joins.override(left, right)) == ["a", "b", "q", "r"]
    assert ids(joins.override(left, left)) == ["a", "b"]


def test_cycles_at_any_depth(spark):
    chain = claims(spark, [{"id": f"n{i}", "evidence": cite(f"n{i + 1}")} for i in range(130)])
    assert provenance.would_create_cycle(chain, "n129", ["n0"]) and not provenance.would_create_cycle(chain, "other", ["n0"]) and provenance.would_create_cycle(chain, "n1", ["n1"])


def test_aggregation(spark):
    rows = claims(spark, [{"value": v} for v in (True, None, "", " 12 ", "x", 3.5, [1])])
    assert A.alpha(rows, A.sum_of("value")).first().value == pytest.approx(16.5)
    assert A.alpha(rows.limit(0), A.avg_of("value")).first().value == 0
    assert A.alpha(claims(spark, [{"subject": "b"}, {"subject": "a"}]), A.min_of("subject")).first().text == "a"
    texts = claims(spark, [{"value": "pear"}, {"value": "fig"}])
    assert A.alpha(texts, A.max_of("value")).first().asDict() == {"value": None, "text": "pear"}
    assert A.alpha(claims(spark, [{"value": 3}, {"value": "12"}, {"value": "x"}]), A.max_of("value")).first().asDict() == {"value": 12.0, "text": None}
    rate = A.alpha(claims(spark, [{"value": {"w": w}} for w in (True, True, False, None)]), A.binary_rate("value.w")).first()
    assert (rate.alpha, rate.beta) == (3, 2)
    assert {r.group_key: r.n for r in A.group_by(rows, "value", A.count()).collect()}.get("12") is None
    low = spark.range(1).select(C.wilson_lower(F.lit(22.0), F.lit(30.0)).alias("a"), C.wilson_lower(F.lit(1.0), F.lit(1.0)).alias("b"), C.wilson_lower(F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert low.a == pytest.approx(0.555, abs=1e-3) and low.b == pytest.approx(0.207, abs=1e-3) and low.c == 0


def test_distributions_and_lines(spark):
    from claimloom.plans.render import lines

    rows = claims(spark, [{"id": "a", "alpha": 9, "beta": 1, "value": {"x": 1}}, {"id": "b", "p": 0.25, "value": "tea", "status": "candidate"}])
    told = {r.id: (r.s, r.v) for r in rows.select("id", C.serialized_params().alias("s"), C.spread().alias("v")).collect()}
    assert told["a"][0] == '{"alpha":9.0,"beta":1.0}' and told["a"][1] == pytest.approx(9 / 1100) and told["b"] == ('{"p":0.25}', 0.0)
    back = rows.select(C.deserialized_params(C.serialized_params()).alias("x")).where("x.alpha = 9").first().x
    assert (back.alpha, back.beta, back.p) == (9, 1, None) and C.distribution("beta").fields == ("alpha", "beta")
    with pytest.raises(C.UnknownDistribution):
        C.distribution("gaussian")
    with pytest.raises(Exception, match="no distribution gaussian"):
        rows.withColumn("dist", F.lit("gaussian")).select(C.serialized_params()).collect()
    text = lambda df: [r.line for r in lines(df).collect()]
    assert text(rows) == ['s k.a = {"x":1}  [validated p=0.900]', 's k.a = "tea"  [candidate p=0.250]']
    assert text(A.group_by(rows, "status", A.count())) == ["candidate: 1", "validated: 1"] and text(A.alpha(rows, A.count())) == ["2"]
    assert text(rows.select("id").where("id = 'a'")) == ['{"id":"a"}'] and text(composition.kappa(ranking.rho(rows, "jaccard", "tea"), "text", 1)) == ["tea\n"]


def test_opinions(spark):
    o = spark.range(1).select(C.beta_to_opinion(F.lit(1.0), F.lit(1.0)).alias("o"), C.extend_to_frame(F.lit(3.0), F.lit(2.0), [0.5, 0.3, 0.2]).alias("x")).first()
    assert (o.o.b, o.o.d, o.o.u) == (0, 0, 1) and o.x == pytest.approx([3, 1.2, 0.8])
    back = spark.range(1).select(C.opinion_to_beta(F.lit(0.4), F.lit(0.2), F.lit(0.4)).alias("b")).first().b
    assert (back.alpha, back.beta) == (pytest.approx(3), pytest.approx(2))
    with pytest.raises(Exception, match="dogmatic"):
        spark.range(1).select(C.opinion_to_beta(F.lit(1.0), F.lit(0.0), F.lit(0.0))).collect()


def test_composition(spark):
    rows = ranking.rho(claims(spark, [{"value": "a <b> & c"}, {"value": "a b c"}, {"value": "q"}, {"value": {"k": 1}}]), "jaccard", "a b c")
    xml = composition.kappa(rows, "xml", 100).first()
    assert xml.content.startswith("<context>\n<claim score=\"1\">a &lt;b&gt; &amp; c</claim>") and xml.content.count("<claim") == 3
    assert composition.kappa(rows, "text", 1).first().content == "a <b"
    assert composition.parse_context(composition.kappa(rows, "json", 100).first().content)[-1] == {"value": {"k": 1}, "score": 0}
    assert composition.count_tokens("😀") == 1 and math.isclose(len(composition._cut("a😀b", 3)), 2)
    with pytest.raises(ValueError):
        composition.kappa(rows, "pdf")


def test_composition_reads_past_copies(spark):
    """Groups of copies and near copies above the largest head of the ranking do not hide what comes after them."""
    same = " ".join(f"w{i}" for i in range(30))
    text = F.when(F.col("ord") < 270_000, F.lit(same)).when(F.col("ord") < 540_000, F.concat(F.lit(same + " x"), F.col("ord").cast("string"))).otherwise(F.lit("the last claim"))
    rows = spark.range(0, 540_001, 1, 4).select(F.col("id").alias("ord"), F.when(F.col("id") < 540_000, 1.0).otherwise(0.5).alias("score"))
    rows = rows.withColumn("value_text", text).withColumn("value_json", F.concat(F.lit('"'), text, F.lit('"')))
    assert composition.kappa(rows, "text", 400).first().content == f"{same}\nthe last claim"
    assert composition.kappa(rows, "text", 400, dedup_threshold=1.01).first().content == "\n".join([same] * 20)[:1600]


# sizes


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_groups_equal_brute_force(spark, monkeypatch):
    """Groups in one task and in blocks, copies, empty and null values, and an id that occurs in two groups."""
    monkeypatch.setattr(combination, "BLOCK_MEMBERS", 6)
    rng = random.Random(3)
    rows = [(f"c{i:03}", rng.choice("aab"), " ".join(rng.choice("klmnopqrst") for _ in range(rng.randrange(7)))) for i in range(60)]
    rows += [(f"d{i:03}", f"s{i // 3}", rng.choice(["x y", "x z", "w", "", None])) for i in range(30)] + [("c000", "s0", "x y"), ("c001", "s0", "x y z"), ("c001", "s1", None)]
    df = spark.createDataFrame(rows, "id string, subject string, value_text string").withColumns({"key": F.lit("k"), "scope_hash": F.lit("_")})
    for cutoff in (0.15, 0.6, 1.0):
        label = {r[0]: r[0] for r in rows}
        sets = [(i, s, set(t.split())) for i, s, t in rows if t is not None]
        near = [(i, j) for i, s, a in sets for j, z, b in sets if s == z and (len(a & b) / len(a | b) if a | b else 1.0) >= cutoff]
        while any(label[i] != label[j] for i, j in near):
            for i, j in near:
                label[i] = label[j] = min(label[i], label[j])
        sizes = Counter(label.values())
        got = [tuple(r) for r in combination.similar_groups(df, cutoff).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {i: c for i, c in label.items() if sizes[c] > 1}


def test_small_groups_take_no_rounds(spark, monkeypatch):
    """What fits one task is clustered there: no pairs by tokens, no iteration."""
    monkeypatch.setattr(combination, "components", None)
    rows = claims(spark, [{"value": "a b c"}, {"value": "a b d"}, {"value": "x"}])
    assert sorted(tuple(r) for r in combination.similar_groups(rows, 0.4).collect()) == [("c000", "c000"), ("c001", "c000")]


def test_scores_read_a_text_once(spark):
    """A floor on the score is pushed to the scan; there it must name the text's tokens once, and parse no JSON."""
    plan = _plan(QUERIES["relevance_floor"](spark, "/root/testdata/sf0.001"))
    assert plan.count("split(") == 1 and "parseJson" not in plan


def test_value_predicates_parse_a_value_once(spark):
    """Each predicate on a value parses it once (and the view makes its JSON once for that), however often it names it."""
    rows = events_claims(spark, "/root/testdata/sf0.001")
    for p in (P.value_gt("k", 50), P.value_in("v", [1, 3]), P.value_eq("v", 2), P.value_matches({"v": 2, "won": True})):
        plan = _plan(P.sigma(rows, p).select("recorded_seq"))
        assert plan.count("parseJson") == 2 and plan.count("get_json_object") == 1
