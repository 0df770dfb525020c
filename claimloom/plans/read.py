"""The canonical read, aliases, recall and its explanation.

A canonical read slices by validity, merges near-identical restatements, lets the newest of contradicting values win
and drops what is deprecated, a flag or an alias. Only the alias map comes to the driver: it is the corpus's hand-made
vocabulary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import point
from ..operators import combination, composition, contradiction, ranking
from ..operators import predicates as P
from ..operators.graph import settled
from ..operators.temporal import tau_valid
from ..schema import TRIPLE

ALIAS_KEY, ALIAS_SUBJECT, FLAG_KEY = "alias-of", "key:", "contradiction.flag"
#: How a read merges restatements: rule, similarity and cutoff.
DEDUPE = {"rule": "weighted_avg", "fn": "jaccard", "cutoff": 0.5}
#: Words that begin questions and are no entities.
ENTITY_STOPWORDS = {"When", "Which", "Who", "What", "How", "Where", "Why", "Did", "Do", "Does", "Is", "Are", "Was", "Were", "The", "I"}
_ENTITY = r"(?<![A-Za-z0-9_])(?:[A-Z][a-zA-Z]+|[0-9]+[a-zA-Z]*)(?![A-Za-z0-9_])"


def is_alias() -> Column:
    return (F.col("key") == ALIAS_KEY) & F.col("subject").startswith(ALIAS_SUBJECT)


@dataclass
class Aliases:
    map: dict[str, str] = field(default_factory=dict)
    self_aliases: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def family(self, key: str) -> set[str]:
        """The canonical key and all variants that lead to it."""
        canonical = self.map.get(key, key)
        return {canonical, *(v for v, c in self.map.items() if c == canonical)}


def alias_map(claims: DataFrame, t: int) -> Aliases:
    """Aliases valid at ``t``, followed to their ends. Ties, malformed and meta-aliases and cycles drop out."""
    rows = contradiction.resolve_deprecate_older(tau_valid(claims.where(is_alias()), t), threshold=0, flags=False).where("status <> 'deprecated'")
    out, direct, tied = Aliases(), {}, set()
    groups: dict[str, list] = {}
    for r in rows.select("subject", "value_json", "value_text", "ord").orderBy("ord").collect():
        groups.setdefault(r.subject.removeprefix(ALIAS_SUBJECT), []).append(r)
    for variant, found in groups.items():
        value, canonical = found[0].value_json, found[0].value_text
        if len(found) > 1:
            tied.add(variant)
            out.warnings.append(f'ambiguous alias: variant "{variant}" has several claims that tie')
        elif not value.startswith('"') or not canonical:
            out.warnings.append(f'malformed alias of "{variant}": a non-empty string is needed')
        elif variant == canonical:
            out.self_aliases.append(variant)
        elif any(x == ALIAS_KEY or x.startswith(ALIAS_SUBJECT) for x in (variant, canonical)):
            out.warnings.append(f'alias of an alias: "{variant}" to "{canonical}"')
        else:
            direct[variant] = canonical
    cycles: set[str] = set()
    for variant in direct:
        path = [variant]
        while (step := direct.get(path[-1])) is not None and step not in path:
            path.append(step)
        if step is not None:
            cycles.update(path[path.index(step) :])
            cycles.add(variant)  # a tail that runs into a cycle has no end either
        elif variant not in cycles:
            out.map[variant] = path[-1]
    out.map = {v: c for v, c in out.map.items() if v not in cycles}
    if cycles:
        out.warnings.append(f"aliases in a cycle or leading into one: {', '.join(sorted(cycles))}")
    return out


def restated(claims: DataFrame, t: int, dedupe: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is valid at ``t``, its clusters of restatements (written) and their survivors."""
    how = DEDUPE | (dedupe or {})
    valid = tau_valid(claims, t)
    found = combination.similar_groups(valid, how["cutoff"], how["fn"])
    return valid, found, combination.dedupe(valid, how["rule"], how["cutoff"], how["fn"], found=found)


def kept_of(merged: DataFrame, aliases: dict[str, str] | None = None, cardinality: dict[str, str] | None = None) -> DataFrame:
    """Of survivors: the newest value, nothing deprecated, no flags and no aliases."""
    resolved = contradiction.resolve_deprecate_older(merged, threshold=0, aliases=aliases, cardinality=cardinality, flags=False)
    return resolved.where((F.col("status") != "deprecated") & (F.col("key") != FLAG_KEY) & ~is_alias())


def canonical_read(claims: DataFrame, t: int, aliases: dict[str, str] | None = None, cardinality: dict[str, str] | None = None, dedupe: dict | None = None) -> DataFrame:
    """Valid at ``t``, restatements merged, the newest value kept, nothing deprecated, no flags and no aliases."""
    return kept_of(restated(claims, t, dedupe)[2], aliases, cardinality)


def beaten(merged: DataFrame, aliases: dict[str, str] | None = None, cardinality: dict[str, str] | None = None) -> DataFrame:
    """Survivors of which a newer claim of another value exists: id, winner (the newest one; the smallest id of several)."""
    keyed = contradiction.eligible(merged, 0, aliases, cardinality)
    newest = keyed.groupBy(*contradiction.GROUP, "value_hash").agg(F.max("valid_from").alias("top"), F.min_by("id", F.struct((-F.col("valid_from")).alias("v"), "id")).alias("winner"))
    place = F.row_number().over(Window.partitionBy(*contradiction.GROUP).orderBy(F.desc("top"), "winner"))
    two = newest.withColumn("r", place).where("r <= 2").groupBy(*contradiction.GROUP).agg(F.array_sort(F.collect_list(F.struct("r", "value_hash", "top", "winner"))).alias("w"))
    other = F.when(F.col("w")[0]["value_hash"] != F.col("value_hash"), F.col("w")[0]).otherwise(F.get("w", F.lit(1)))
    return keyed.join(two, contradiction.GROUP).withColumn("o", other).where(F.col("o.top") > F.col("valid_from")).select("id", F.col("o.winner").alias("winner"))


def dispositions(claims: DataFrame, t: int, aliases: dict[str, str] | None = None, cardinality: dict[str, str] | None = None, dedupe: dict | None = None) -> DataFrame:
    """What became of every claim before ranking: id, disposition (tau-invalid, merged, deprecated, served) and target_id."""
    how = DEDUPE | (dedupe or {})
    valid, found, merged = restated(claims, t, dedupe)
    absorbed = combination.merged_into(valid, merged, how["cutoff"], how["fn"], found=found)
    rows = (
        claims.select("id")
        .join(valid.select("id", F.lit(True).alias("valid")), "id", "left")
        .join(absorbed.withColumnsRenamed({"member_id": "id", "survivor_id": "into"}), "id", "left")
        .join(beaten(merged, aliases, cardinality), "id", "left")
    )
    kind = F.when(F.col("valid").isNull(), "tau-invalid").when(F.col("into").isNotNull(), "merged").when(F.col("winner").isNotNull(), "deprecated").otherwise("served")
    return rows.select("id", kind.alias("disposition"), F.coalesce("into", "winner").alias("target_id"))


def attribution(written: DataFrame, ledger: DataFrame, t: int, aliases: dict[str, str] | None = None, cardinality: dict[str, str] | None = None) -> DataFrame:
    """What writing these claims did: id, action (committed, merged, duplicate, superseded), merged_into, deprecated_ids.

    A claim that is merged is a duplicate if its survivor holds the very same value. A claim that is served has
    superseded what is deprecated under its subject, key and scope. ``ledger``: the claims with those written.
    """
    groups = ledger.join(written.select("subject", "key").distinct(), ["subject", "key"], "left_semi")
    told = dispositions(groups, t, aliases, cardinality).join(groups.select("id", *TRIPLE, "value_hash"), "id")
    gone = told.where("disposition = 'deprecated'").groupBy(*TRIPLE).agg(F.array_sort(F.collect_list("id")).alias("gone"))
    target = groups.select(F.col("id").alias("target_id"), F.col("value_hash").alias("theirs"))
    rows = written.select("id").join(told, "id").join(target, "target_id", "left").join(gone, list(TRIPLE), "left")
    action = (
        F.when((F.col("disposition") == "merged") & (F.col("theirs") == F.col("value_hash")), "duplicate")
        .when(F.col("disposition") == "merged", "merged")
        .when((F.col("disposition") == "served") & F.col("gone").isNotNull(), "superseded")
        .otherwise("committed")
    )
    none = F.array().cast("array<string>")
    return rows.withColumn("action", action).select(
        "id", "action", F.when(F.col("action").isin("merged", "duplicate"), F.col("target_id")).alias("merged_into"), F.when(F.col("action") == "superseded", F.col("gone")).otherwise(none).alias("deprecated_ids")
    )


def entity_tokens(text: str) -> list[str]:
    """Capitalised words and numbers of a question, in order."""
    return [w for w in dict.fromkeys(re.findall(_ENTITY, text, re.ASCII)) if w not in ENTITY_STOPWORDS]


def entity_tokens_col(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_ENTITY})"), 1)), F.array(*map(F.lit, sorted(ENTITY_STOPWORDS))))


def coverage(claims: DataFrame, entities: list[str]) -> DataFrame:
    """Rows (entity, supported): whether any claim's subject, key or value contains it, in any case."""
    hay = F.lower(F.concat_ws(" ", "subject", "key", "value_text"))
    found = claims.agg(*(F.bool_or(hay.contains(e.lower())).alias(f"e{i}") for i, e in enumerate(entities)))
    return found.select(F.explode(F.array(*(F.struct(F.lit(e).alias("entity"), F.coalesce(f"e{i}", F.lit(False)).alias("supported")) for i, e in enumerate(entities)))).alias("x")).select("x.*")


def parse_as_of(text: str | None) -> int | None:
    """Epoch milliseconds of an ISO date or instant."""
    if text is None:
        return None
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"invalid date {text!r}") from e
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


@dataclass
class Recall:
    matches: DataFrame
    ranked: DataFrame
    content: str
    top_score: float | None
    abstained: bool
    coverage: list[tuple[str, bool]]
    warnings: list[str]


def selected(claims: DataFrame, subject: str | None = None, family: set[str] | None = None, status: str | None = None, confidence: float | None = None) -> DataFrame:
    parts = [P.subject_eq(subject)] if subject else []
    parts += [P.key_in(sorted(family))] if family else []
    parts += [P.status_eq(status)] if status else []
    parts += [P.confidence_gt(confidence)] if confidence is not None else []
    return claims.where(P.and_(*parts)) if parts else claims


def recall_ranked(claims, query, now, alpha=0.5, half_life_days=90, aliases=None, cardinality=None, fn=ranking.jaccard, dedupe=None) -> DataFrame:
    """The canonical read with its score by similarity and recency, not sorted; alpha 1 ranks by similarity alone."""
    return ranking.rank_blend(canonical_read(claims, now, aliases, cardinality, dedupe), fn, query, now, alpha, half_life_days, ordered=False)


def recall(
    claims: DataFrame, query: str, now: int, *, subject=None, key=None, limit=5, least_top=0.0, floor=0.0, alpha=0.5, half_life_days=90.0,
    cardinality=None, max_tokens=1000, fn=ranking.jaccard, dedupe=None,
) -> Recall:
    """Everything a caller needs to answer from the corpus, with reasons to doubt it."""
    aliases = alias_map(claims, now)
    warnings = list(aliases.warnings)
    rows = selected(claims, subject, aliases.family(key) if key else None)
    merged = settled(restated(rows, now, dedupe)[2], "merged")
    found = settled(ranking.rank_blend(kept_of(merged, aliases.map, cardinality), fn, query, now, alpha, half_life_days, ordered=False), "ranked")
    entities = entity_tokens(query)
    covered = [(r.entity, r.supported) for r in coverage(found, entities).collect()] if entities else []
    missing = [e for e, ok in covered if not ok]
    if missing:
        warnings.append(f"nothing is known about: {', '.join(missing)}")
    for r in contradiction.cardinality_collisions(merged, cardinality, aliases.map).orderBy("subject", "canonical_key").toLocalIterator():
        warnings.append(f"{r.subject} / {r.canonical_key} holds {r['values']} values; the newest is served")
    top = found.agg(F.max("score")).first()[0]
    abstained = top is not None and top < least_top
    kept = ranking.relevance_floor(ranking.abstain_below_top(found, least_top), floor)
    content = composition.kappa(kept, "markdown", max_tokens).first().content
    return Recall(ranking.top_k(kept, limit).withColumn("confidence", point()), found, content, top, abstained, covered, warnings)


def explain(claims: DataFrame, query, now: int, *, limit=5, least_top=0.0, floor=0.0, alpha=0.5, half_life_days=90.0, aliases=None, cardinality=None, fn=ranking.jaccard, dedupe=None) -> DataFrame:
    """What became of every candidate: id, subject, key, disposition, reason, target_id, score.

    Served, merged (into a survivor), deprecated (by a newer claim of another value) or dropped (not valid, a flag or
    alias, abstained, below the floor, beyond the limit). Rows are tagged by joins with each stage's result. What was
    deprecated before has no target.
    """
    how = DEDUPE | (dedupe or {})
    valid, found, merged = restated(claims, now, dedupe)
    merged = settled(merged, "merged")
    absorbed = combination.merged_into(valid, merged, how["cutoff"], how["fn"], found=found)
    ranked = settled(ranking.rank_blend(kept_of(merged, aliases, cardinality), fn, query, now, alpha, half_life_days, ordered=False), "ranked")
    places = ranked.select("id", "score", "ord")
    top = places.agg(F.max("score").alias("top_score"))
    passing = places.where(F.col("score") >= floor).orderBy(F.desc("score"), "ord").limit(limit).select("id", F.lit(True).alias("served"))
    rows = (
        claims.select("id", "subject", "key", is_alias().alias("alias"))
        .join(valid.select("id", F.lit(True).alias("valid")), "id", "left")
        .join(absorbed.withColumnsRenamed({"member_id": "id", "survivor_id": "into"}), "id", "left")
        .join(beaten(merged, aliases, cardinality), "id", "left")
        .join(places.select("id", "score"), "id", "left")
        .join(passing, "id", "left")
        .join(F.broadcast(top))  # one row
    )
    abstain = F.col("top_score") < least_top
    reason = (
        F.when(F.col("valid").isNull(), "tau-invalid")
        .when(F.col("into").isNotNull(), "merged-into")
        .when(F.col("alias") | (F.col("key") == FLAG_KEY), "alias-or-flag")
        .when(F.col("score").isNull(), "deprecated-by")
        .when(abstain, "abstained")
        .when(F.col("score") < floor, "below-floor")
        .when(F.col("served").isNull(), "over-limit")
        .otherwise("served")
    )
    kind = F.when(F.col("reason") == "served", "served").when(F.col("reason") == "merged-into", "merged").when(F.col("reason") == "deprecated-by", "deprecated").otherwise("dropped")
    target = F.when(F.col("reason") == "merged-into", F.col("into")).when(F.col("reason") == "deprecated-by", F.col("winner"))
    return rows.withColumn("reason", reason).select("id", "subject", "key", kind.alias("disposition"), "reason", target.alias("target_id"), "score")


def stage_counts(told: DataFrame) -> DataFrame:
    """How many claims are left after each stage of an explained recall: one row."""
    reached = lambda *gone: F.count_if(~F.col("reason").isin(*gone))
    tau, merged, lost = ("tau-invalid",), ("tau-invalid", "merged-into"), ("tau-invalid", "merged-into", "alias-or-flag", "deprecated-by")
    return told.agg(
        F.count("*").alias("candidates"), reached(*tau).alias("after_tau"), reached(*merged).alias("after_dedupe"), reached(*lost).alias("after_contradiction"),
        reached(*lost).alias("ranked"), reached(*lost, "abstained", "below-floor").alias("after_knobs"), F.count_if(F.col("reason") == "served").alias("served"),
    )


def lineage(claims: DataFrame, subject: str, keys: set[str] | None = None) -> DataFrame:
    """All versions under a subject and key family, oldest validity first."""
    return selected(claims, subject, keys).orderBy("valid_from", "recorded_seq", "id")


def read_by_ids(claims: DataFrame, ids: list[str]) -> DataFrame:
    """Claims by id in the order asked for; unknown ids drop out."""
    wanted = claims.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, position int")
    return claims.join(wanted, "id").orderBy("position")


