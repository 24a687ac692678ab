"""Embedding caches: Parquet tables by cache key, and the older form, JSON of deflated base64 floats."""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.schema import CACHE, HASHES


def deflate(vec: list[float]) -> str:
    return base64.b64encode(zlib.compress(np.asarray(vec, "<f4").tobytes(), 6)).decode()


def inflate(value: str | None) -> list[float] | None:
    """The vector, or None for what is no deflated run of floats."""
    try:
        raw = zlib.decompress(base64.b64decode(value or "", validate=True))
    except (ValueError, zlib.error):
        return None
    return np.frombuffer(raw, "<f4").tolist() if raw and len(raw) % 4 == 0 else None


def inflated(value: Column) -> Column:
    @F.arrow_udf("array<float>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([inflate(x) for x in arr.to_pylist()], pa.list_(pa.float32()))

    return f(value)


def deflated(vec: Column) -> Column:
    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([None if x is None else deflate(x) for x in arr.to_pylist()], pa.string())

    return f(vec)


def read_legacy(spark: SparkSession, path: str, cache_key: str) -> DataFrame:
    """A cache in the older form, one JSON object {hash: vector}; entries that can't be read are dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("content_hash", "v"))
    return rows.select(F.lit(cache_key).alias("cache_key"), "content_hash", inflated(F.col("v")).alias("vec")).where("vec is not null")


def function_hashes(spark: SparkSession, data: dict) -> DataFrame:
    """A baseline ``{"file:name:line": {"hash", "text_hash"}}`` as rows; in the older form the value is the hash alone.

    TypeError for any other value, ValueError for a key without its three parts. A baseline is a small file.
    """
    rows = []
    for key, value in data.items():
        file, name, line = (key.rsplit(":", 2) + [""] * 3)[:3]
        if not (file and name and line.isdigit()):
            raise ValueError(f"no file:name:line: {key!r}")
        if isinstance(value, str):
            value = {"hash": value}
        if not isinstance(value, dict) or not isinstance(value.get("hash"), str) or not isinstance(value.get("text_hash"), (str, type(None))):
            raise TypeError(f"neither a hash nor hashes: {key!r}")
        rows.append((file, name, int(line), value["hash"], value.get("text_hash")))
    return spark.createDataFrame(rows, HASHES)


def hashes_data(functions: DataFrame) -> DataFrame:
    """``(key, json)`` of functions, as a baseline has them."""
    key = F.concat_ws(":", "file", "name", F.col("start_line").cast("string"))
    return functions.select(key.alias("key"), F.to_json(F.struct("hash", "text_hash")).alias("json"))


def write_cache(cache: DataFrame, path: str) -> None:
    """Only the partitions (cache keys) that ``cache`` has are replaced."""
    cache.write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("cache_key").parquet(path)


def read_cache(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """The cache, of ``keys`` alone if given: other partitions aren't opened."""
    table = spark.read.schema(CACHE).parquet(path)
    return table if keys is None else table.where(F.col("cache_key").isin(keys))


def parse_response(payload: str | dict, expected: int) -> list[list[float]]:
    """Vectors of a provider's response in the order of the inputs; ValueError for anything malformed.

    The response has one item for each input, each with its own index and a non-empty vector of finite numbers, all of one length.
    """
    data = json.loads(payload) if isinstance(payload, str) else payload
    items = data.get("data") if isinstance(data, dict) else None
    if not isinstance(items, list) or len(items) != expected:
        raise ValueError(f"a response without {expected} items")
    out: dict[int, list[float]] = {}
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    for item in items:
        k, v = (item.get("index"), item.get("embedding")) if isinstance(item, dict) else (None, None)
        if not isinstance(k, int) or isinstance(k, bool) or not 0 <= k < expected or k in out:
            raise ValueError(f"a bad index: {k!r}")
        if not isinstance(v, list) or not v or not all(number(x) and math.isfinite(x) for x in v):
            raise ValueError(f"a bad vector at {k}")
        out[k] = [float(x) for x in v]
    if len({len(v) for v in out.values()}) > 1:
        raise ValueError("vectors of several lengths")
    return [out[k] for k in range(expected)]
