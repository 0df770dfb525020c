import hashlib

import pytest
from helpers import cite, claims, ids
from pyspark.sql import functions as F

from claimloom.engine import Engine, UndeclaredScope, UnavailableTiers
from claimloom.operators import chain, overlay, ranking, temporal, writing
from claimloom.plans import ast, census, derive, dsl, read
from claimloom.sources import records, views
from claimloom.sources.store import ClaimStore, UnknownCorpus
from claimloom.streaming import subscriptions

DAY = 86_400_000


def _acceptance(spark):
    block = "lineage-block"
    return claims(spark, [
        {"id": "1", "subject": block, "key": f"{block}.evidence"}, {"id": "2", "subject": block, "key": f"{block}.schema", "evidence": cite("1")},
        {"id": "3", "subject": "user", "key": "user.pref"}, {"id": "4", "subject": block, "key": f"{block}.low", "alpha": 1, "beta": 9},
        {"id": "5", "subject": block, "key": f"{block}.deprecated", "status": "deprecated"}, {"id": "6", "subject": block, "key": f"{block}.stale", "recorded": -90 * DAY},
    ])


def test_acceptance_pipeline(spark):
    tree = ast.pipe(
        "c",
        ("tau", {"mode": "now", "at": 0}),
        ("sigma", {"predicate": {"op": "subjectEq", "value": "lineage-block"}}),
        ("delta", {"policy": temporal.exponential(30), "now": 0}),
        ("sigma", {"predicate": {"op": "and", "parts": [{"op": "statusEq", "value": "validated"}, {"op": "confidenceGt", "value": 0.7}]}}),
        ("rho", {"similarity": "jaccard", "query": "1"}),
        ("gamma", {"depth": 2}),
    )
    assert ast.parse(ast.serialize(tree)) == tree
    rows = _acceptance(spark)
    assert ids(ast.compile(tree, lambda _: rows)) == ["1", "2"]
    done = ast.node("kappa", tree, format="xml", max_tokens=12000)
    assert ast.compile(done, lambda _: rows).first().content.count("<claim") == 1  # equal values are shown once


def test_expressions_refuse(spark):
    for bad in ('{"op":"nope"}', '{"op":"resolve","rule":"keep_both","source":{"op":"leaf","corpus":"c"}}', "{}"):
        with pytest.raises(ast.UnsupportedOperation):
            ast.parse(bad)
    with pytest.raises(ast.UnsupportedOperation):
        ast.predicate({"op": "nope"})
    assert ast.pushed_hints({"op": "keyIn", "value": []}) == {}


def test_dsl(spark):
    rows = _acceptance(spark)
    run = lambda text: ast.compile(dsl.parse("c", dsl.normalize(text), 0), lambda _: rows)
    assert run("where subject = user | count").first().n == 1
    assert run("where confidence > 0.5 | decay none | as text 100").first().token_count > 0
    with pytest.raises(dsl.UnknownClause):
        run("order by x")


def test_aliases(spark):
    found = read.alias_map(views.alias_claims(spark), 100)
    assert found.map == {"event.view": "event.touch", "event.click": "event.touch", "event.old": "event.touch", "to-tied": "tied"}
    assert found.self_aliases == ["self"] and len(found.warnings) == 3
    assert found.family("event.view") == {"event.touch", "event.view", "event.click", "event.old"}


def test_recall_and_explain_agree(spark):
    rows = claims(spark, [
        {"id": "old", "subject": "Ada", "key": "ada.city", "value": "Ada lives in Paris", "valid_from": 1},
        {"id": "new", "subject": "Ada", "key": "ada.city", "value": "Rome since May", "valid_from": 5 * DAY},
        {"id": "again", "subject": "Ada", "key": "ada.city", "value": "Rome since May", "valid_from": 4 * DAY},
        {"id": "later", "subject": "Ada", "key": "ada.job", "value": "pilot", "valid_from": 99 * DAY},
        {"id": "job", "subject": "Ada", "key": "ada.job", "value": "baker", "valid_from": 2},
    ])
    out = read.recall(rows, "Where does Ada of Oslo live? Rome", 10 * DAY)
    assert [r.id for r in out.matches.collect()] == ["new", "job"]
    assert dict(out.coverage) == {"Ada": True, "Oslo": False, "Rome": True} and not out.abstained and "Rome since May" in out.content
    told = {r.id: (r.disposition, r.reason, r.target_id) for r in read.explain(rows, "Where does Ada of Oslo live? Rome", 10 * DAY).collect()}
    assert told == {
        "old": ("deprecated", "deprecated-by", "new"), "new": ("served", "served", None), "again": ("merged", "merged-into", "new"),
        "later": ("dropped", "tau-invalid", None), "job": ("served", "served", None),
    }
    counts = read.stage_counts(read.explain(rows, "Where does Ada of Oslo live? Rome", 10 * DAY)).first().asDict()
    assert counts == {"candidates": 5, "after_tau": 4, "after_dedupe": 3, "after_contradiction": 2, "ranked": 2, "after_knobs": 2, "served": 2}
    assert read.recall(rows, "zebra", 10 * DAY, least_top=0.9).abstained
    assert read.parse_as_of("2024-01-01") == 1_704_067_200_000
    with pytest.raises(ValueError):
        read.parse_as_of("soon")


def test_census_and_reconcile(spark):
    rows = claims(spark, [{"subject": s} for s in ("red apple", "red apple", "green apple", "blue whale")])
    assert [(r.a, r.b) for r in census.subject_census(rows, 1).collect()] == [("green apple", "red apple"), ("blue whale", "green apple"), ("blue whale", "red apple")]
    wanted = spark.createDataFrame([("red apple",), ("moon",), ("red apple pie",)], "value string")
    got = {r.value: r.disposition for r in census.reconcile(wanted, rows, "subject", 1).collect()}
    assert got == {"red apple": "reuse", "moon": "new", "red apple pie": "uncertain"}
    told = census.audit(claims(spark, [{"subject": "red apple", "value": v} for v in (1, 2, 2)] + [{"subject": "apple", "key": "k.b"}]), 1, corpus="c").collect()
    assert [(r.kind, r.entities, r.claims_affected, r.score and round(r.score, 3)) for r in told] == [
        ("subject-fragmentation", ["apple", "red apple"], 4, 0.5), ("key-alias", ["k.a", "k.b"], 4, 0.333), ("cardinality-declare", ["red apple", "k.a"], 2, None),
    ]
    assert told[-1].suggested_action == 'declare_cardinality("c", {"k.a": "multi"})' and "2 values" in told[-1].detail


def test_census_equals_all_pairs(spark, monkeypatch):
    """Whatever level the search stops at, the list is that of all pairs: with names without tokens, and filled up with unlike ones."""
    import random

    rng = random.Random(4)
    words = ["red", "green", "apple", "user", "x", "whale"]
    tokens = lambda n: set("".join(c if c.isalnum() or c == "_" else " " for c in n.lower()).split())
    score = lambda a, b: len(tokens(a) & tokens(b)) / len(tokens(a) | tokens(b)) if tokens(a) | tokens(b) else 1.0
    for names in (
        {" ".join(rng.choices(words, k=rng.randint(1, 4))) + f" {rng.randint(0, 9)}" for _ in range(60)} | {"---", "!!!", "??"},
        {f"user:{i}" for i in range(12)}, {f"only{i}" for i in range(30)}, {"a-b", "b a", "c"}, {f"{c}?" for c in "-+*/"},
    ):
        want = sorted(((-score(a, b), a, b) for a in names for b in names if a < b))[:20]
        got = census.subject_census(claims(spark, [{"subject": n} for n in sorted(names)]), 1).collect()
        assert [(-r.score, r.a, r.b) for r in got] == pytest.approx(want) if not want else [(r.a, r.b) for r in got] == [w[1:] for w in want]


def test_attribution_and_dispositions(spark):
    rows = [
        {"id": "old", "value": "Paris", "valid_from": 1}, {"id": "new", "value": "Rome", "valid_from": 5}, {"id": "again", "value": "Rome", "valid_from": 4},
        {"id": "near", "value": "Rome since", "valid_from": 3}, {"id": "alone", "key": "k.b", "valid_from": 2}, {"id": "later", "value": "Oslo", "valid_from": 99},
    ]
    ledger = claims(spark, rows)
    told = {r.id: (r.action, r.merged_into, r.deprecated_ids) for r in read.attribution(ledger, ledger, 10).collect()}
    assert told == {
        "old": ("committed", None, []), "new": ("superseded", None, ["old"]), "again": ("duplicate", "new", []), "near": ("merged", "new", []),
        "alone": ("committed", None, []), "later": ("committed", None, []),
    }
    kinds = {r.id: r.disposition for r in read.dispositions(ledger, 10).collect()}
    assert kinds["later"] == "tau-invalid" and kinds["old"] == "deprecated" and kinds["alone"] == "served"


def test_over_merged_subject(spark):
    rows = claims(spark, [{"subject": "mix", "value": v} for v in ("cat fur paw", "cat fur tail", "tax form due", "tax form late")])
    assert [r.subject for r in census.value_clusters(rows, 1).collect()] == ["mix"]
    leaked = claims(spark, [{"subject": "a", "value": v} for v in ("cat fur paw", "cat fur tail", "cat fur ear", "tax form due")] + [{"subject": "b", "value": "tax form due now"}])
    got = census.misplaced(leaked, 1).first()
    assert (got.subject, got.better_subject, got.affected) == ("a", "b", 1)


def _fold(rows, policy, rule="deprecate_lower"):
    """Item by item, as a ledger would take them."""
    live, out = {}, {}
    for r in rows:
        mine = live.setdefault(r["subject"], {})
        point = r["alpha"] / (r["alpha"] + 1)
        conflict = next((i for i, (v, _) in mine.items() if v != r["value"]), None)
        outcome = "committed"
        if conflict is not None and policy == "reject_on_contradiction" and mine[conflict][1] >= point:
            outcome = "rejected"
        if conflict is not None and policy == "accept_and_resolve" and rule == "deprecate_lower" and point > mine[conflict][1]:
            del mine[conflict]
        if outcome == "committed":
            mine[r["id"]] = (r["value"], point)
        out[r["id"]] = outcome, conflict
    return out


def test_folding_equal_values_is_linear():
    """10^5 claims of one triple take seconds at most, under every policy."""
    import time

    import pandas as pd

    n = 100_000
    for policy in ("reject_on_contradiction", "accept_and_resolve", "accept_but_mark"):
        values = ["a"] * (n - 2000) + [f"v{i % 1000}" for i in range(2000)]
        batch = pd.DataFrame({"subject": "s", "key": "k", "scope_hash": "_", "id": [f"i{i}" for i in range(n)], "value_hash": values, "status": "validated", "point": 0.5, "recorded_seq": range(n), "candidate": True})
        began = time.perf_counter()
        out = pd.concat(writing.decide(policy)(iter([batch])))
        assert time.perf_counter() - began < 10 and len(out) == n and out.conflict_id[n - 1 :].iloc[0] == "i0"


@pytest.mark.parametrize("policy", ["reject_on_contradiction", "accept_and_resolve", "accept_but_mark"])
def test_commit_equals_one_by_one(spark, policy):
    import random

    rng = random.Random(5)
    rows = [{"id": f"i{i:03}", "subject": f"s{rng.randrange(8)}", "value": rng.randrange(3), "alpha": rng.randrange(1, 9)} for i in range(120)]
    batch = claims(spark, rows)
    told = writing.decisions(batch, None, policy)
    assert {r.id: (r.outcome, r.conflict_id) for r in told.collect()} == _fold(rows, policy)
    ledger = writing.apply_commit(batch, None, told, policy)
    marks = sum(c is not None for _, c in _fold(rows, policy).values()) if policy == "accept_but_mark" else 0
    assert ledger.count() == sum(o == "committed" for o, _ in _fold(rows, policy).values()) + marks


def test_idempotency_and_promotion(spark):
    batch = claims(spark, [{"id": "a"}, {"id": "b"}, {"id": "c"}]).withColumns({"writer": F.lit("w"), "idempotency_key": F.expr("if(id = 'c', null, 'k')")})
    told = writing.commit_batch(batch, None, "always_accept", now=10)
    assert {r.id: r.outcome for r in told.collect()} == {"a": "committed", "b": "duplicate", "c": "committed"}
    record = spark.createDataFrame([("default", "w", "k.a", "k", "zz", 5)], "corpus_id string, writer string, key string, idempotency_key string, claim_id string, created bigint")
    assert writing.idempotent(batch, record, 10).where("id = 'a'").first().duplicate_of == "zz"
    assert writing.idempotent(batch, record, 10 + DAY).where("id = 'a'").first().duplicate_of is None
    asked = spark.createDataFrame([("a", "deprecated"), ("b", "candidate"), ("x", "validated")], "id string, to string")
    assert {r.id: r.outcome for r in writing.promote(batch, asked).collect()} == {"a": "promoted", "b": "invalid_transition", "x": "not_found"}
    gone = batch.withColumn("status", F.lit("deprecated"))
    assert {r.id: r.outcome for r in writing.promote(gone, asked).collect()} == {"a": "promoted", "b": "invalid_transition", "x": "not_found"}


def test_chain_and_merkle(spark):
    rows = [("commit", f"c{i % 2}", "w", f"id{i}", None, None, None, i, i) for i in range(11)]
    log = chain.build_chain(spark.createDataFrame(rows, "op string, corpus_id string, writer string, claim_id string, deprecated_id string, to_status string, reason string, recorded bigint, recorded_seq bigint"))
    assert all(r.intact for r in chain.verify_chain(log).collect())
    broken = chain.verify_chain(log.withColumn("reason", F.expr("if(recorded_seq = 5, 'x', reason)"))).where("corpus_id = 'c1'").first()
    assert not broken.intact and broken.broken_at == 2
    hashes = [r.entry_hash.encode() for r in log.where("corpus_id = 'c0'").orderBy("recorded_seq").collect()]
    assert chain.merkle_roots(log).where("corpus_id = 'c0'").first().root == chain.merkle_root(hashes).hex()
    assert chain.merkle_root([]) == bytes(32) and chain.merkle_root([b"x"]) == hashlib.sha256(b"\x00x").digest()
    report = chain.audit_report(log, signer=lambda root: root[:4])[0]
    assert report.intact and len(report.signature) == 8 and not report.tamper_evident


def test_chain_over_buckets_with_escapes(spark, monkeypatch):
    """Texts that JSON escapes, many buckets and several levels of a tree."""
    import json

    monkeypatch.setattr(chain, "BUCKET", 4)
    monkeypatch.setattr(chain, "FAN", 4)
    reasons = ["plain", 'a "quote" and \\', "line\nbreak\ttab", "\x00\x01\x1f", "é 😀", None]
    rows = [("commit", f"c{i % 3}", "w", f"id{i}", None, None, reasons[i % 6], i, i * 3) for i in range(70)]
    schema = "op string, corpus_id string, writer string, claim_id string, deprecated_id string, to_status string, reason string, recorded bigint, recorded_seq bigint"
    log = chain.build_chain(spark.createDataFrame(rows, schema)).cache()
    assert {(r.corpus_id, r.entries, r.intact, r.broken_at) for r in chain.verify_chain(log).collect()} == {("c0", 24, True, None), ("c1", 23, True, None), ("c2", 23, True, None)}
    last = ""
    for r in sorted(log.where("corpus_id = 'c1'").collect(), key=lambda r: r.recorded_seq):
        text = json.dumps([getattr(r, f) for f in chain.EVENT_FIELDS], separators=(",", ":"), ensure_ascii=False)
        assert r.prev_hash == last
        last = hashlib.sha256((text + last).encode()).hexdigest()
        assert r.entry_hash == last
    for at in (0, 5, 22):
        seq = sorted(r[8] for r in rows if r[1] == "c1")[at]
        forged = log.withColumn("reason", F.when((F.col("corpus_id") == "c1") & (F.col("recorded_seq") == seq), "x").otherwise(F.col("reason")))
        assert {r.corpus_id: r.broken_at for r in chain.verify_chain(forged).collect()} == {"c0": None, "c1": at, "c2": None}
        cut = log.where((F.col("corpus_id") != "c1") | (F.col("recorded_seq") != seq))
        assert {r.corpus_id: r.broken_at for r in chain.verify_chain(cut).collect()}["c1"] == (at if at < 22 else None)
    for r in chain.merkle_roots(log).collect():
        assert r.root == chain.merkle_root([x.entry_hash.encode() for x in log.where(F.col("corpus_id") == r.corpus_id).orderBy("recorded_seq").collect()]).hex()


def test_dreams_signals_and_cycles(spark):
    tags = {"a": [], "b": ["dream-depth:2"], "c": ["dream-depth:3"], "d": ["dream-depth:many"], "e": ["x", "dream-depth:1"], "f": ["dream:deep", "dreamy"]}
    rows = claims(spark, [{"id": i, "tags": t, "recorded": n, "status": "candidate" if i in "ef" else "validated"} for n, (i, t) in enumerate(tags.items())])
    rows = rows.withColumns({"workflow": F.when(F.col("id") == "e", "dream"), "run_id": F.when(F.col("id") == "a", "r2").otherwise("r1")})
    runs = lambda *x: spark.createDataFrame([(r,) for r in x], "run_id string")
    assert [r.id for r in overlay.select_dreams(rows).collect()] == ["f", "b", "a"]
    assert [r.id for r in overlay.select_dreams(rows, runs("r1")).collect()] == ["f", "b"] and overlay.select_dreams(rows, runs()).count() == 0
    asked = spark.createDataFrame([("i", "s.k", ["a", "b"], '"v"'), ("j", "s.k", ["zz"], '"v"'), ("k", "nodot", ["a"], '"v"'), ("l", "s.k", [], '"v"')], "id string, key string, cites array<string>, value_json string")
    told = overlay.admit_insights(asked, overlay.select_dreams(rows))
    got = {r.id: r for r in told.collect()}
    assert {i: r.reason for i, r in got.items()} == {"i": None, "j": "cites not in selected set", "k": "invalid key", "l": "cites not in selected set"}
    assert got["i"].tags == ["dream-depth:3"] and got["i"].subject == "s" and [e.claim_id for e in got["i"].evidence] == ["a", "b"]
    made = overlay.admitted_claims(told, overlay.DREAM, 9).first()
    assert (made.id, made.status, made.workflow, made.alpha, made.beta, made.recorded) == ("i", "candidate", "dream", 1.0, 3.0, 9)
    assert {r.reason for r in overlay.admit_summaries(asked, rows, None).collect()} == {"episode has no runs"}
    assert overlay.admit_summaries(asked, rows, "r7").where("admitted").first().run_id == "r7"

    buffer = overlay.SignalBuffer(spark, cap=3)
    buffer.usage("e1", ["a", "a"])
    buffer.outcome("e1", "success", 0.5)
    buffer.surfaced("e1", ["b"])
    buffer.usage("e2", ["b"])
    with pytest.raises(overlay.BufferFull):
        buffer.usage("e2", ["b"])
    got = {r.id: r.alpha for r in overlay.evidence_update(rows, *buffer.frames("e1")).collect()}
    assert got == {"a": 10.0, "b": 10.0}
    seen = []
    broken = overlay.Cycle(lambda plans, key: 1 / 0, [lambda episode, b: "plan"])
    assert broken.run("e1", buffer)["errors"] and buffer.frames("e1")[0].count() == 2
    cycle = overlay.Cycle(lambda plans, key: seen.append((plans, key)) or len(plans), [lambda episode, b: cycle.run(episode, b)["errors"]])
    assert cycle.run("e1", buffer) == {"applied": 1, "errors": []} and seen == [([["a cycle is running"]], "e1:1")]
    assert buffer.frames("e1")[0].count() == 0 and buffer.frames("e2")[0].count() == 1


def test_commits_are_whole(spark, tmp_path):
    """What a failed transaction wrote is never seen; a later one is."""
    from claimloom.schema import CLAIM_COLUMNS

    store = ClaimStore(spark, str(tmp_path / "db"), "c")
    rows = claims(spark, [{"id": "a"}]).select(*CLAIM_COLUMNS)
    with pytest.raises(ZeroDivisionError), store.transact() as whole:
        whole.insert(rows)
        whole.set_status(spark.createDataFrame([("c", "a", "deprecated")], "corpus_id string, id string, to string"), 1)
        1 / 0
    assert store.claims().count() == 0 and store.max_seq() == 0
    with store.transact() as whole:
        whole.insert(rows)
        assert store.claims().count() == 0
    assert [r.status for r in store.claims().collect()] == ["validated"]
    store.insert(claims(spark, [{"id": "b", "subject": "t"}]).select(*CLAIM_COLUMNS))  # an append by itself
    narrow = F.col("subject") == "t"
    assert ids(store.claims(narrow, narrow)) == ["b"] and store.claims().count() == 2
    moved = claims(spark, [{"id": "b", "subject": "u", "seq": 9}]).select(*CLAIM_COLUMNS)
    store.insert(moved)
    assert store.claims(narrow, narrow).count() == 0  # found by its old subject, left out by its last


def test_remember(spark, tmp_path):
    now = [1_000]
    engine = Engine(ClaimStore(spark, str(tmp_path / "db")), lambda: now[0])
    one = lambda i, v: spark.createDataFrame([(i, "Ada", "ada.city", f'"{v}"')], "id string, subject string, key string, value_json string")
    tell = lambda i, v: engine.remember("notes", one(i, v)).first()
    assert (tell("a", "Paris").action, engine.list_corpora()) == ("committed", ["notes"])
    now[0] = 2_000
    second = tell("b", "Rome")
    assert (second.outcome, second.action, second.deprecated_ids) == ("committed", "superseded", ["a"])
    now[0] = 3_000
    assert (tell("c", "Rome").action, engine.inspect_corpus("notes")["claims"]) == ("superseded", {"validated": 3})
    engine.create_corpus("logged", tiers=("claims", "audit"), scope_fields=[])
    many = spark.createDataFrame([(f"m{i:02}", "Ada", f"ada.k{i}", "1") for i in range(30)], "id string, subject string, key string, value_json string")
    engine.remember("logged", many)
    engine.remember("logged", one("z", "Rome"))
    log = engine.verify("logged").first()
    assert log.intact and log.entries == 31
    tree = ast.pipe("notes", ("sigma", {"predicate": {"op": "subjectEq", "value": "Ada"}}), ("rho", {"similarity": "jaccard", "query": "rome"}))
    assert ast.leaf_hints(tree) == {"subject": "Ada"} and [r.id for r in engine.query(tree).collect()] == ["b", "c", "a"]


def test_overlay(spark):
    rows = claims(spark, [{"id": "a"}, {"id": "b", "p": 0.9}])
    pairs = lambda *x: spark.createDataFrame(list(x), "episode string, claim_id string")
    outcomes = spark.createDataFrame([("e", "success", 0.5), ("e", "failure", None)], "episode string, result string, weight double")
    got = {r.id: (r.alpha, r.beta) for r in overlay.evidence_update(rows, pairs(("e", "a"), ("e", "a")), pairs(("e", "b"), ("e", "b")), outcomes).collect()}
    assert got["a"] == (10.0, 1.0) and got["b"] == (pytest.approx(2.8), pytest.approx(2.2))
    plan = overlay.plan_consolidation(claims(spark, [{"value": 1}] * 3 + [{"value": 2, "status": "candidate", "alpha": 90, "beta": 1}])).collect()
    assert sorted((r.op, r.target, r.to) for r in plan) == [("derive", "c000", "validated"), ("promote", "c000", "deprecated"), ("promote", "c001", "deprecated"), ("promote", "c002", "deprecated"), ("promote", "c003", "validated")]
    many = claims(spark, [{"value": 1}] * 3 + [{"value": 2, "status": "candidate", "alpha": 90, "beta": 1}])
    after = overlay.apply_plan(many, overlay.plan_consolidation(many), 5)
    assert after.count() == 5 and after.where("status = 'deprecated'").count() == 3 and overlay.plan_counts(many, overlay.plan_consolidation(many)).first().applied == 4
    insight = spark.createDataFrame([("i", "a.b", ["a"]), ("j", "a.b", ["zz"]), ("k", "Bad", ["a"])], "id string, key string, cites array<string>")
    assert {r.id: r.admitted for r in overlay.admit_insights(insight, rows).collect()} == {"i": True, "j": False, "k": False}


def test_engine_round_trip(spark, tmp_path):
    now = [1_000]
    engine = Engine(ClaimStore(spark, str(tmp_path / "db")), lambda: now[0])
    engine.create_corpus("c", policy="accept_and_resolve", scope_fields=["entityId"], tiers=("claims", "audit"))
    with pytest.raises(UnknownCorpus):
        engine.claims("nope")
    with pytest.raises(UnavailableTiers):
        engine.create_corpus("d", tiers=("magic",))
    with pytest.raises(UndeclaredScope):
        engine.commit_batch("c", claims(spark, [{"scope": {"x": "1"}}]))
    engine.commit_batch("c", claims(spark, [{"id": "a", "value": "tea", "alpha": 3}, {"id": "b", "value": "rye bread", "key": "k.b"}]))
    now[0] = 2_000
    told = engine.commit_batch("c", claims(spark, [{"id": "n", "value": "coffee", "valid_from": 5}]))
    assert told.first().deprecated_id == "a"
    assert {r.id: r.status for r in engine.claims("c").collect()} == {"a": "deprecated", "b": "validated", "n": "validated"}
    assert engine.verify("c").first().intact and engine.verify("c").first().entries == 3
    assert [r.id for r in engine.recall("c", "coffee").matches.collect()][0] == "n" and engine.recall("zz", "x") is None
    assert engine.q("c", "where status = validated | count").first().n == 2
    assert [r.id for r in engine.read_by_ids("c", ["n", "zz", "b"]).collect()] == ["n", "b"]
    tree = ast.pipe("c", ("sigma", {"predicate": {"op": "keyEq", "value": "k.b"}}), ("synthesize", {"subject": "s", "key": "k.c", "rule": "weighted_avg"}))
    _, made = engine.derive(tree)
    assert engine.replay(made) == "exact"
    engine.commit_batch("c", claims(spark, [{"id": "z", "value": "white bread", "key": "k.b", "alpha": 2}]))
    assert engine.replay(made) == "mismatch"
    assert derive.replay(derive.Derivation(made.expression, "c", 0, ["gone"], ["x"], 0, {}, "h"), engine.claims) == "missing_inputs"
    assert derive.replay(derive.Derivation(made.expression, "c", 0, [], [], 0, {"cosine": "9"}), engine.claims) == "unavailable_models"
    assert engine.promote("c", spark.createDataFrame([("n", "deprecated")], "id string, to string")).first().outcome == "promoted"
    assert engine.history("c", "s").count() == 4
    engine.delete_corpus("c")
    assert engine.list_corpora() == []


def test_ingest_staging_and_embeddings(spark, tmp_path):
    import numpy as np

    from claimloom.functions.embedding import Embedder, embedder, register_embedder, warm, with_embeddings
    from claimloom.operators.predicates import UnsupportedPredicate, route_value_predicates
    from claimloom.plans.ingest import ingest

    engine = Engine(ClaimStore(spark, str(tmp_path / "db")), lambda: 1_000, log_path=str(tmp_path / "log"))
    engine.create_corpus("c")
    engine.staging.emit("first", claims(spark, [{"id": "a", "subject": "Red Apple", "value": "sweet"}]))
    assert engine.staging.list() == ["first"] and engine.promote_staged("c", "first").first().outcome == "committed" and not engine.staging.discard("first")
    done = ingest(engine, "c", spark.range(1), lambda _: claims(spark, [{"id": "b", "subject": "red-apple", "value": "sour", "key": "k.b"}, {"id": "d", "subject": "moon", "value": "far"}]))
    assert {r.id: r.subject for r in engine.claims("c").collect()} == {"a": "Red Apple", "b": "Red Apple", "d": "moon"} and done.outcomes.count() == 2
    engine.supersede("c", "a", claims(spark, [{"id": "e", "subject": "Red Apple", "value": "bitter"}]))
    assert engine.claims("c", statuses=["deprecated"]).first().id == "a"
    _, made = engine.commit_derived(ast.pipe("c", ("sigma", {"predicate": {"op": "subjectEq", "value": "moon"}}), ("synthesize", {"subject": "moon", "key": "k.s", "rule": "weighted_avg"})))
    assert made.inputs == ["d"] and engine.claims("c", key="k.s").first().evidence[0].claim_id == "d"
    engine.recall("c", "moon")
    assert spark.read.json(str(tmp_path / "log")).first().query == "moon"
    letters = Embedder("letters", "1", 2, lambda texts: np.array([[len(t), 1.0] for t in texts]))
    register_embedder(letters)
    assert embedder("letters") is letters
    rows = with_embeddings(claims(spark, [{"value": "ab"}, {"value": "ab"}, {"value": "abc"}]), warm(spark.createDataFrame([("ab",), ("ab",), ("abc",)], "text string"), letters))
    assert sorted(r.embedding[0] for r in rows.collect()) == [2, 2, 3]
    with pytest.raises(UnsupportedPredicate):
        route_value_predicates({"op": "and", "parts": [{"op": "valueNear", "path": "x"}]})


def test_imports(spark, tmp_path):
    lines = ['{"subject":"s","key":"k","value":{"b":1,"a":2},"confidence":0.7,"tags":["t"]}', "", "nonsense", '{"start":"cat","rel":"IsA","end":"animal","weight":3}', '{"subject":"a","relation":"meets","object":"b","timestamp":5}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = records.json_lines(spark, str(tmp_path / "x.jsonl"))
    assert records.import_summary(rows).first().asDict() == {"total": 4, "well_formed": 3, "skipped": 1}
    plain = records.map_records(rows, "jsonl").where("key = 'k'").first()
    assert plain.value_json == '{"a":2,"b":1}' and plain.p == 0.7 and plain.tags == ["t"]
    assert records.map_records(rows, "conceptnet").first().p == 1.0 and records.map_records(rows, "icews").first().valid_from == 5
    (tmp_path / "e.tsv").write_text("a\tmeets\tb\t2024-01-02\n")
    assert '"timestamp":1704153600000' in records.event_tsv(spark, str(tmp_path / "e.tsv")).first().value
    (tmp_path / "n.tsv").write_text('/a/x\t/r/IsA\t/c/en/cat\t/c/en/animal\t{"weight": 2.0}\n/a/y\t/r/IsA\t/c/fr/chat\t/c/fr/animal\t{}\n')
    assert records.edge_tsv(spark, str(tmp_path / "n.tsv")).count() == 1
    meeting = spark.createDataFrame([("m", "t", "2024-01-02", [("Ann", "X | x.y | says \"hi\""), ("Bob", "hello")])], "id string, title string, date string, sentences array<struct<speaker:string,text:string>>")
    got = records.transcript_claims(meeting).collect()
    assert [(r.subject, r.key, r.value_text) for r in got] == [("X", "x.y", 'says "hi"')]


def test_streams_equal_batches(spark, tmp_path):
    from claimloom.schema import CLAIM_COLUMNS

    log = str(tmp_path / "log")
    rows = claims(spark, [{"subject": f"s{i % 3}", "value": i // 6, "recorded": i} for i in range(12)]).select(*CLAIM_COLUMNS)
    for part in range(4):
        rows.where(F.col("recorded_seq") % 4 == part).coalesce(1).write.mode("append").parquet(log)
    out = {"match": [], "change": []}
    stream = subscriptions.claim_log(spark, log, files_per_trigger=1)
    q = subscriptions.deliver(subscriptions.on_every_match(stream, "sub", F.col("value_json") == "1"), lambda df, _: out["match"].extend(r.delivery_id for r in df.collect()), str(tmp_path / "cp1"))
    q.awaitTermination()
    assert len(set(out["match"])) == rows.where("value_json = '1'").count()
    q = subscriptions.deliver(subscriptions.on_transition(stream), lambda df, _: out["change"].extend(r.subject for r in df.collect()), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert sorted(out["change"]) == ["s0", "s1", "s2"]  # once for each subject
    gone = rows.where("recorded_seq < 6 and subject = 's1'").withColumns({"status": F.lit("deprecated"), "recorded": F.col("recorded") + 100})
    gone.coalesce(1).write.mode("append").parquet(log)
    q = subscriptions.deliver(subscriptions.on_transition(stream), lambda df, _: out["change"].extend((r.subject, r.was, r.became) for r in df.collect()), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert out["change"][3:] == [("s1", "contested", "agreed")]


def test_registered_queries_have_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "recall_topk" in entry.queries()
    assert ranking.similarity("exact")
