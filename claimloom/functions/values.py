"""JSON values as columns: canonical text, hashes, paths and tokens.

A value is stored as canonical JSON text (``value_json``): keys sorted, numbers as doubles print. ``value_text`` is the
string itself for string values, else the canonical JSON; tokenising and embedding read that.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATH = re.compile(r"[^.\[\]]+(\[\d+\])*(\.[^.\[\]]+(\[\d+\])*)*")
_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def canonical_number(x: float) -> str:
    """A number as JSON text: whole numbers without fraction, others in shortest form."""
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    mantissa, e, exponent = text.partition("e")
    if not e:
        return text
    power = int(exponent)
    if -7 < power < 21:
        return f"{x:.{max(0, len(mantissa.replace('.', '').lstrip('-')) - 1 - power)}f}"
    return f"{mantissa.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical(value) -> str:
    """Canonical JSON of a Python value."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return canonical_number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"


def canonical_json(text: Column) -> Column:
    """Canonical text of JSON text: sorted keys, whole numbers without fraction. Null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def json_quoted(text: Column) -> Column:
    """A string as JSON text, escaped as ``canonical`` does: quotes, backslashes and control characters."""
    plain = F.regexp_replace(text, r'(["\\])', r"\\$1")
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def scope_hash(scope: Column) -> Column:
    """Sixteen hex digits over the sorted fields; ``_`` for an empty scope."""
    fields = F.array_sort(F.transform(F.map_entries(scope), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda e: F.concat(json_quoted(e["k"]), F.lit(":"), json_quoted(e["v"]))), ","), F.lit("}"))
    return F.when(F.coalesce(F.cardinality(scope), F.lit(0)) <= 0, "_").otherwise(short_hash(text))


def value_text(value_json: Column) -> Column:
    parsed = F.try_parse_json(value_json)
    return F.when(value_json.startswith('"'), F.try_variant_get(parsed, "$", "string")).otherwise(value_json)


def variant_path(path: str) -> str:
    """``a.b[0].c`` as a JSON path."""
    if not _PATH.fullmatch(path):
        raise ValueError(f"not a path: {path!r}")
    steps = _STEP.findall(path)
    return "$" + "".join(f"['{n}']" if n else f"[{i}]" for n, i in steps)


def at_path(value_json: Column, path: str) -> Column:
    """The VARIANT at a path inside the value; SQL null where it is missing (a JSON null is present)."""
    return F.try_variant_get(F.try_parse_json(value_json), variant_path(path), "variant")


def json_at(value_json: Column, path: str) -> Column:
    """Canonical JSON at a path; SQL null where it is missing, ``null`` for a JSON null."""
    return let(at_path(value_json, path), json_of)


def json_of(found: Column) -> Column:
    """Canonical JSON of a VARIANT, which is named twice."""
    return F.when(F.is_variant_null(found), "null").otherwise(F.to_json(found))


def kind_of(found: Column) -> Column:
    """object, array, string, number, boolean, null of a VARIANT."""
    of = lambda schema: (
        F.when(schema.isNull(), F.lit(None))
        .when(schema == "VOID", "null")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .otherwise("number")
    )
    return let(F.schema_of_variant(found), of)


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens; everything but ASCII letters, digits and underscore separates."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9_]+")), "")


def python_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9_]+", text.lower()) if t))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays; 1 if both are empty."""

    def score(sets: Column) -> Column:
        x, y = F.size(sets["a"]), F.size(sets["b"])
        overlap = F.size(F.array_intersect(sets["a"], sets["b"]))
        return F.when((x == 0) & (y == 0), 1.0).otherwise(let(overlap, lambda both: both / (x + y - both)))

    return let(F.struct(a.alias("a"), b.alias("b")), score)
