"""Baselines: envelopes flattened to ``(path, value)`` rows, merged so that they can only be tightened."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"


def is_envelope(x: object) -> bool:
    return isinstance(x, dict) and {"schema_version", "kind", "data"} <= x.keys() and isinstance(x["data"], dict)


def envelope(raw: object, kind: str) -> dict:
    """``raw`` as an envelope: nothing makes an empty one, a bare object is wrapped; anything else, or another kind, is an error."""
    if raw is None:
        return {"schema_version": VERSION, "kind": kind, "data": {}}
    if not isinstance(raw, dict):
        raise ValueError("a baseline has to be an object")
    if "schema_version" not in raw:
        return {"schema_version": VERSION, "kind": kind, "data": raw}
    if not is_envelope(raw) or raw["schema_version"] != VERSION:
        raise ValueError("malformed baseline")
    if raw["kind"] != kind:
        raise ValueError(f"a baseline of {raw['kind']}, not {kind}")
    return raw


def flatten(data: dict, at: tuple[str, ...] = ()) -> list[tuple[list[str], str, float | None]]:
    """``(path, json, value)`` of every leaf; value is null where that is no number (booleans are none)."""
    out: list[tuple[list[str], str, float | None]] = []
    for k, v in data.items():
        if isinstance(v, dict) and v:
            out += flatten(v, (*at, k))
        else:
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            out.append(([*at, k], json.dumps(v), float(v) if number else None))
    return out


def unflatten(rows: list[tuple[list[str], str]]) -> dict:
    out: dict = {}
    for path, value in rows:
        at = out
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = json.loads(value)
    return out


def as_rows(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame(flatten(data), "path array<string>, json string, value double")


def ratchet(baseline: DataFrame, current: DataFrame, keys: list[str], value_col: str = "value") -> DataFrame:
    """Of a number in both the smaller one; what is new is added; what is only in the baseline stays."""
    b = baseline.select(*keys, F.col(value_col).alias("__b"), F.lit(True).alias("__in"))
    c = current.select(*keys, F.col(value_col).alias("__c"))
    merged = F.when(F.col("__in").isNull(), F.col("__c")).when(F.col("__c") < F.col("__b"), F.col("__c")).otherwise(F.col("__b"))
    return b.join(c, keys, "full").select(*keys, merged.alias(value_col))


def ratchet_data(spark: SparkSession, data: dict, current: dict) -> dict:
    """``ratchet`` of nested objects; leaves that are no numbers keep the baseline's value."""
    b, c = as_rows(spark, data), as_rows(spark, current)
    j = b.alias("b").join(c.alias("c"), F.col("b.path") == F.col("c.path"), "full")
    new = F.when(F.col("b.path").isNull(), F.col("c.json")).when(F.col("c.value") < F.col("b.value"), F.col("c.json")).otherwise(F.col("b.json"))
    rows = j.select(F.coalesce("b.path", "c.path").alias("path"), new.alias("json")).orderBy("path").collect()  # a baseline is a small file
    return unflatten([(r.path, r.json) for r in rows])


def update(baseline: DataFrame, current: DataFrame, keys: list[str], above: float, value_col: str = "value") -> DataFrame:
    """The baseline with every current value above ``above`` recorded, higher ones too."""
    from gritstone.operators.cache import upsert

    return upsert(baseline, current.where(F.col(value_col) > above), keys)


def ratchet_file(spark: SparkSession, path: Path, kind: str, current: dict) -> bool:
    """Tightens a baseline file by what is measured now, under its lock; true if that changed it.

    Only what the baseline lacks or has too high is written; a file that stays as it is isn't rewritten.
    """
    from gritstone.sources import config

    with config.locked_envelope(path, kind, rewrite=False) as held:
        new = ratchet_data(spark, held["data"], current)
        changed = new != held["data"]
        if changed:
            held["data"] = new
            config.write_json(path, held)
    return changed
