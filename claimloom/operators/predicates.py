"""Selection: predicates over claims as columns.

Every predicate is two-valued: a missing field is false, never null, so that ``not_`` means what it says. ``and_``
and ``or_`` evaluate left to right, and what a value predicate raises (a comparison of something that is no number, a
pattern on something that is no string) is raised only if the predicates before it leave the question open.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.confidence import effective


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _among(c: Column, options: Iterable) -> Column:
    options = list(options)
    return _sure(c.isin(options)) if options else F.lit(False)


def subject_eq(v: str) -> Column:
    return _sure(F.col("subject") == v)


def subject_in(vs: Iterable[str]) -> Column:
    return _among(F.col("subject"), vs)


def key_eq(v: str) -> Column:
    return _sure(F.col("key") == v)


def key_in(vs: Iterable[str]) -> Column:
    return _among(F.col("key"), vs)


def scope_eq(field: str, v: str) -> Column:
    return _sure(F.try_element_at("scope", F.lit(field)) == v)


def status_eq(v: str) -> Column:
    return _sure(F.col("status") == v)


def status_in(vs: Iterable[str]) -> Column:
    return _among(F.col("status"), vs)


def confidence_gt(v: float) -> Column:
    return _sure(effective() > v)


def tag_in(vs: Iterable[str]) -> Column:
    vs = list(vs)
    return _sure(F.arrays_overlap("tags", F.array(*map(F.lit, vs)))) if vs else F.lit(False)


def valid_at(t: int) -> Column:
    return _sure(F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.lit(t) < F.col("valid_to")))


def recorded_after(t: int) -> Column:
    return _sure(F.col("recorded") > t)


def and_(*parts: Column) -> Column:
    out = F.lit(True)
    for part in reversed(parts):
        out = F.when(part, out).otherwise(False)
    return out


def or_(*parts: Column) -> Column:
    out = F.lit(False)
    for part in reversed(parts):
        out = F.when(part, True).otherwise(out)
    return out


def not_(part: Column) -> Column:
    return ~part


# predicates over the value


def value_eq(path: str, value) -> Column:
    return _sure(V.json_at(F.col("value_json"), path) == V.canonical(value))


def value_in(path: str, options: Iterable) -> Column:
    return _among(V.json_at(F.col("value_json"), path), map(V.canonical, options))


def value_exists(path: str) -> Column:
    return V.at_path(F.col("value_json"), path).isNotNull()


def value_null(path: str) -> Column:
    return _sure(F.is_variant_null(V.at_path(F.col("value_json"), path)))


def _number(path: str) -> Column:
    wrong = F.raise_error(F.lit(f"value at {path} is missing or no number")).cast("double")
    number = lambda found: F.when(V.kind_of(found) == "number", F.try_variant_get(found, "$", "double")).otherwise(wrong)
    return V.let(V.at_path(F.col("value_json"), path), number)


def value_gt(path: str, n: float) -> Column:
    return _number(path) > n


def value_ge(path: str, n: float) -> Column:
    return _number(path) >= n


def value_lt(path: str, n: float) -> Column:
    return _number(path) < n


def value_le(path: str, n: float) -> Column:
    return _number(path) <= n


def value_regex(path: str, pattern: str) -> Column:
    wrong = F.raise_error(F.lit(f"value at {path} is missing or no string")).cast("string")
    string = lambda found: F.when(V.kind_of(found) == "string", F.try_variant_get(found, "$", "string")).otherwise(wrong)
    return V.let(V.at_path(F.col("value_json"), path), string).rlike(pattern)


def value_matches(pattern) -> Column:
    """Recursive subset match: objects field by field, arrays of equal length item by item, others equal."""

    def fits(root: Column) -> Column:
        conditions: list[Column] = []

        def expand(want, path: str) -> None:
            found = F.try_variant_get(root, V.variant_path(path), "variant") if path else root
            if isinstance(want, dict):
                conditions.append(_sure(V.kind_of(found) == "object"))
                for k, v in want.items():
                    expand(v, f"{path}.{k}" if path else k)
            elif isinstance(want, list):
                conditions.append(_sure(V.kind_of(found) == "array"))
                conditions.append(_sure(F.size(F.try_variant_get(found, "$", "array<variant>")) == len(want)))
                for i, v in enumerate(want):
                    expand(v, f"{path}[{i}]")
            else:
                conditions.append(_sure(V.json_of(found) == V.canonical(want)) if path else _sure(F.col("value_json") == V.canonical(want)))

        expand(pattern, "")
        return and_(*conditions)

    if not isinstance(pattern, (dict, list)):
        return fits(F.lit(None))
    return V.let(F.try_parse_json("value_json"), fits)


#: What a storage level would have to support; here all of it runs natively.
VALUE_PREDICATES = ("valueEq", "valueGt", "valueIn", "valueExists", "valueRegex", "valueMatches", "valueNull", "valueGe", "valueLt", "valueLe")


class UnsupportedPredicate(ValueError):
    """A value predicate that a store cannot evaluate."""


def route_value_predicates(p: dict, supported: tuple[str, ...] = VALUE_PREDICATES) -> set[str]:
    """The value predicates in a JSON predicate; raises on one that is not supported."""
    if p["op"] in ("and", "or", "not"):
        return set().union(*(route_value_predicates(x, supported) for x in p["parts"]))
    used = {p["op"]} if p["op"].startswith("value") else set()
    if used - set(supported):
        raise UnsupportedPredicate(p["op"])
    return used


def typecheck(path: str, fields: dict, op: str) -> str:
    """The declared type at a path of nested dicts; raises if the path or the operation does not fit it."""
    at = fields
    for step in path.replace("[", ".[").split("."):
        if step.startswith("["):
            if not isinstance(at, list):
                raise TypeError(f"{path}: no array is declared at {step}")
            at = at[0]
        elif not isinstance(at, dict) or step not in at:
            raise TypeError(f"{path}: {step!r} is not declared")
        else:
            at = at[step]
    kind = at if isinstance(at, str) else "array" if isinstance(at, list) else "object"
    if op == "valueGt" and kind != "number" or op == "valueRegex" and kind != "string":
        raise TypeError(f"{op} on {path}, which is declared as {kind}")
    return kind


def sigma(claims: DataFrame, predicate: Column) -> DataFrame:
    return claims.where(predicate)
