"""Small claim frames for tests."""

from __future__ import annotations

import json

from claimloom.schema import as_claims

SCHEMA = (
    "id string, subject string, key string, value_json string, scope map<string,string>, dist string, alpha double, beta double, p double,"
    " valid_from bigint, valid_to bigint, recorded bigint, recorded_seq bigint, status string, source string, tags array<string>, evidence array<struct<kind:string,claim_id:string,"
    "document_id:string,offset_start:bigint,offset_end:bigint,method:string,uri:string,content_hash:string>>"
)


def cite(*ids):
    return [("claim", i, None, None, None, None, None, None) for i in ids]


def claims(spark, rows):
    """Claims from dicts; what is left out has a plain default."""
    out = []
    for i, r in enumerate(rows):
        dist = "scalar" if "p" in r else "beta"
        out.append((
            r.get("id", f"c{i:03}"), r.get("subject", "s"), r.get("key", "k.a"), json.dumps(r.get("value", 1)), r.get("scope", {}), dist,
            None if dist == "scalar" else float(r.get("alpha", 9)), None if dist == "scalar" else float(r.get("beta", 1)), r.get("p"),
            r.get("valid_from", 0), r.get("valid_to"), r.get("recorded", r.get("valid_from", 0)), r.get("seq", i), r.get("status", "validated"),
            r.get("source", "workflow"), r.get("tags", []), r.get("evidence", []),
        ))
    return as_claims(spark.createDataFrame(out, SCHEMA))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())
