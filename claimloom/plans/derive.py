"""Derived claims that record their own query, and the replay of such queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import settled
from ..operators.ranking import _registry as similarities
from .ast import Node, compile, parse, serialize  # noqa: A004

VERSION = "1"
EPSILON = 1e-9
INLINE = 10_000
STATUSES = ("exact", "mismatch", "missing_inputs", "unavailable_models", "integrity_unknown", "failed")


@dataclass
class Derivation:
    """Where a derived claim comes from."""

    expression: str
    corpus: str
    corpus_state: int
    inputs: list[str]
    input_hashes: list[str]
    clock: int
    versions: dict[str, str] = field(default_factory=dict)
    value_hash: str = ""
    raw: float = 0.0
    #: More than ``INLINE`` inputs stand in a written table of (id, value_hash) instead of the lists.
    inputs_table: str | None = None


def resolves(n: Node) -> bool:
    """Whether an expression resolves contradictions without aliases of its own."""
    return (n.op == "resolve" and "aliases" not in n.args) or (n.source is not None and resolves(n.source))


def stamp(n: Node, threshold: float, now: int, aliases: dict[str, str] | None = None, cardinality: dict[str, str] | None = None) -> Node:
    """Fill in what a resolve node leaves to the corpus: threshold, clock, aliases and cardinality. What it says itself stays."""
    args = dict(n.args)
    if n.op == "resolve":
        args.setdefault("threshold", threshold)
        args.setdefault("now", now)
        if aliases:
            args.setdefault("aliases", aliases)
        if cardinality:
            args.setdefault("cardinality", cardinality)
    return Node(n.op, stamp(n.source, threshold, now, aliases, cardinality) if n.source else None, args)


def _used(n: Node) -> set[str]:
    own = {n.args["similarity"]} if n.op in ("rho", "combine") and n.args.get("similarity") else {"jaccard"} if n.op == "blend" else set()
    return own | (_used(n.source) if n.source else set())


def _source(n: Node) -> Node:
    return n.source or n


def derive(n: Node, load, clock: int) -> tuple[DataFrame, Derivation]:
    """The representative (last claim in order) of an expression, as one row, and its provenance.

    The inputs listed are the claims that reach the last operation: a derivation is a judgement on those. Up to ``INLINE``
    of them are listed, more are written to the shared folder.
    """
    if n.op == "kappa" or n.op == "aggregate":
        raise ValueError(f"{n.op} gives no claim to derive")
    out = compile(n, load)
    last = out.orderBy(F.desc("score"), "ord") if "score" in out.columns else out.orderBy(F.desc("ord"))
    row = settled(last.limit(1), "derived")
    head = row.select("id", "value_hash", "raw").first()
    if head is None:
        raise ValueError("the expression gives no claim")
    table = settled(compile(_source(n), load).select("id", "value_hash"), "inputs")
    few = table.limit(INLINE + 1).count() <= INLINE
    inputs = table.orderBy("id").collect() if few else []
    corpus = serialize(n)
    leaf = n
    while leaf.source:
        leaf = leaf.source
    state = load(leaf.args["corpus"]).agg(F.max("recorded_seq")).first()[0] or 0
    versions = {name: VERSION for name in sorted(_used(n))}
    return row, Derivation(corpus, leaf.args["corpus"], state, [r.id for r in inputs], [r.value_hash for r in inputs], clock, versions, head.value_hash, head.raw, None if few else table.inputFiles()[0].rpartition("/")[0])


def replay(d: Derivation, load) -> str:
    """Evaluate a derivation's query again under its clock and compare; one of STATUSES."""
    if any(name not in similarities or v != VERSION for name, v in d.versions.items()):
        return "unavailable_models"
    try:
        claims = load(d.corpus)
        if d.inputs or d.inputs_table:
            spark = claims.sparkSession
            listed = spark.read.parquet(d.inputs_table).toDF("id", "was") if d.inputs_table else spark.createDataFrame(list(zip(d.inputs, d.input_hashes)), "id string, was string")
            wanted = listed.dropDuplicates(["id"])
            there = wanted.join(claims.select("id", "value_hash"), "id", "left").agg(F.count("*").alias("all"), F.count("value_hash").alias("n"), F.count_if(F.col("was") != F.col("value_hash")).alias("other")).first()
            if there.n < there["all"]:
                return "missing_inputs"
            if there.other:
                return "mismatch"
        if not d.value_hash:
            return "integrity_unknown"
        _, again = derive(parse(d.expression), load, d.clock)
    except Exception:  # any failure of a stored query is an answer here
        return "failed"
    return "exact" if again.value_hash == d.value_hash and abs(again.raw - d.raw) <= EPSILON else "mismatch"
