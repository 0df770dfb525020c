"""Serializable expressions over the operators, compiled to a lazy DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators import aggregation, combination, composition, contradiction, joins, provenance, ranking, temporal
from ..operators import predicates as P


class UnsupportedOperation(ValueError):
    """The expression has an operation that does not exist or lacks a field."""


@dataclass(frozen=True)
class Node:
    op: str
    source: "Node | None" = None
    args: dict = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash(serialize(self))


#: Operation -> fields it needs.
FIELDS = {
    "leaf": ("corpus",), "sigma": ("predicate",), "tau": ("mode", "at"), "delta": ("policy", "now"), "pi": ("fields",), "rho": ("similarity", "query"),
    "blend": ("query", "now"), "gamma": ("depth",), "kappa": ("format", "max_tokens"), "combine": ("rule",), "synthesize": ("subject", "key", "rule"),
    "resolve": ("rule", "threshold"), "aggregate": ("core",), "override": ("right",), "join": ("kind", "right"), "floor": ("least",), "abstain": ("least",), "limit": ("n",),
}


def node(op: str, source: Node | None = None, **args) -> Node:
    if op not in FIELDS:
        raise UnsupportedOperation(f"unknown operation {op!r}")
    missing = [f for f in FIELDS[op] if f not in args]
    if missing or (op == "leaf") != (source is None):
        raise UnsupportedOperation(f"{op} lacks {', '.join(missing) or 'its source'}")
    return Node(op, source, args)


def pipe(corpus: str, *stages: tuple[str, dict]) -> Node:
    out = node("leaf", corpus=corpus)
    for op, args in stages:
        out = node(op, out, **args)
    return out


def _plain(n: Node) -> dict:
    return {"op": n.op} | {k: _plain(v) if isinstance(v, Node) else v for k, v in n.args.items()} | ({"source": _plain(n.source)} if n.source else {})


def serialize(n: Node) -> str:
    return json.dumps(_plain(n), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _node(d: dict) -> Node:
    if not isinstance(d, dict) or "op" not in d:
        raise UnsupportedOperation("an expression needs op")
    args = {k: _node(v) if isinstance(v, dict) and k == "right" else v for k, v in d.items() if k not in ("op", "source")}
    return node(d["op"], _node(d["source"]) if "source" in d else None, **args)


def parse(text: str) -> Node:
    return _node(json.loads(text))


_PREDICATES = {
    "subjectEq": P.subject_eq, "subjectIn": P.subject_in, "keyEq": P.key_eq, "keyIn": P.key_in, "statusEq": P.status_eq, "statusIn": P.status_in,
    "confidenceGt": P.confidence_gt, "tagIn": P.tag_in, "validAt": P.valid_at, "recordedAfter": P.recorded_after, "valueExists": P.value_exists,
    "valueNull": P.value_null, "valueMatches": P.value_matches,
}
_PATH_PREDICATES = {
    "scopeEq": P.scope_eq, "valueEq": P.value_eq, "valueGt": P.value_gt, "valueGe": P.value_ge, "valueLt": P.value_lt, "valueLe": P.value_le, "valueIn": P.value_in, "valueRegex": P.value_regex,
}


def predicate(p: dict) -> Column:
    """A predicate from its JSON form: {"op": ..., "value": ...}, with "path" for values and scopes, "parts" for and, or, not."""
    op = p["op"]
    if op in ("and", "or"):
        return (P.and_ if op == "and" else P.or_)(*map(predicate, p["parts"]))
    if op == "not":
        return P.not_(predicate(p["parts"][0]))
    if op in _PREDICATES:
        return _PREDICATES[op](p["value"])
    if op in _PATH_PREDICATES:
        return _PATH_PREDICATES[op](p["path"], p["value"])
    raise UnsupportedOperation(f"unknown predicate {op!r}")


def pushed_hints(p: dict) -> dict:
    """Subject and keys that top-level conjuncts pin down; empty lists pin nothing down."""
    out: dict = {}
    for part in p["parts"] if p["op"] == "and" else [p]:
        if part["op"] == "subjectEq":
            out["subject"] = part["value"]
        elif part["op"] == "keyEq":
            out["keys"] = [part["value"]]
        elif part["op"] == "keyIn" and part["value"]:
            out["keys"] = list(part["value"])
    return out


CORES = {
    "count": lambda a: aggregation.count(), "sum": lambda a: aggregation.sum_of(a["path"]), "avg": lambda a: aggregation.avg_of(a["path"]),
    "min": lambda a: aggregation.min_of(a["path"]), "max": lambda a: aggregation.max_of(a["path"]), "binaryRate": lambda a: aggregation.binary_rate(a["path"]),
    "countWhere": lambda a: aggregation.count_where(predicate(a["predicate"])), "rate": lambda a: aggregation.rate(predicate(a["hit"]), predicate(a["trial"])),
}


def leaf_hints(n: Node) -> dict:
    """What the selections right above the leaf pin down; the predicates still run, so any part of them is sound."""
    out: dict = {}
    while n.source:
        out = pushed_hints(n.args["predicate"]) | out if n.op == "sigma" else {}
        n = n.source
    return out


def compile(n: Node, load, hinted=None) -> DataFrame:  # noqa: A001
    """The expression as a DataFrame; ``load`` gives a corpus's claims by name. Nothing runs here but what γ and κ must.

    ``hinted``: gives the claims of a corpus that agree with hints (subject, keys), for leaves with selections on them.
    """
    a = n.args
    if n.op == "leaf":
        return load(a["corpus"])
    if hinted and n.op == "sigma" and (hints := leaf_hints(n)) and not hasattr(load, "narrowed"):
        def narrow(corpus: str) -> DataFrame:
            return hinted(corpus, hints)

        narrow.narrowed = True
        return P.sigma(compile(n.source, narrow), predicate(a["predicate"]))
    rows = compile(n.source, load, hinted)
    match n.op:
        case "sigma":
            return P.sigma(rows, predicate(a["predicate"]))
        case "tau":
            return {"valid": temporal.tau_valid, "recorded": temporal.tau_recorded, "known": temporal.tau_known, "now": temporal.tau_now}[a["mode"]](rows, a["at"])
        case "delta":
            return temporal.delta(rows, a["policy"], a["now"])
        case "pi":
            return temporal.pi(rows, a["fields"])
        case "rho":
            return ranking.rho(rows, a["similarity"], a["query"], ordered=False)
        case "blend":
            return ranking.rank_blend(rows, ranking.similarity(a.get("similarity", "jaccard")), a["query"], a["now"], a.get("alpha", 0.5), a.get("half_life_days", 90), ordered=False)
        case "gamma":
            return provenance.gamma(rows, load(_corpus(n)), a["depth"])
        case "kappa":
            return composition.kappa(rows, a["format"], a["max_tokens"], a.get("dedup", 0.9))
        case "combine":
            return combination.dedupe(rows, a["rule"], a.get("cutoff"), a.get("similarity", "jaccard"))
        case "synthesize":
            return combination.synthesize_as(rows, a["subject"], a["key"], a["rule"])
        case "resolve":
            return contradiction.resolution(a["rule"])(rows, a["threshold"], a.get("now", 0), a.get("aliases"), a.get("cardinality"))
        case "aggregate":
            core = CORES[a["core"]](a)
            return aggregation.group_by(rows, a["by"], core) if a.get("by") else aggregation.alpha(rows, core)
        case "override":
            return joins.override(rows, compile(a["right"], load, hinted))
        case "join":
            return {"subject": joins.join_subject, "scope": joins.join_scope, "evidence": joins.join_evidence}[a["kind"]](rows, compile(a["right"], load, hinted))
        case "floor":
            return ranking.relevance_floor(rows, a["least"])
        case "abstain":
            return ranking.abstain_below_top(rows, a["least"])
        case "limit":
            return ranking.top_k(rows, a["n"]) if "score" in rows.columns else rows.orderBy("ord").limit(a["n"])
    raise UnsupportedOperation(n.op)


def _corpus(n: Node) -> str:
    while n.source:
        n = n.source
    return n.args["corpus"]
