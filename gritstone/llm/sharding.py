"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Documents of one source stay together in groups of at most about ``shard_bytes / PER_SHARD``; a larger source is several groups, by
the hash of the document's id. The groups go to cells of up to ``CELL`` shards by their hash, and each cell is packed on its
own: groups in falling order of their largest share of a shard, each to the shard where the dot product of its vector with the
residual capacity is highest, among those that it fits (among all if it fits none). So the sequential part has a bounded size whatever the input, and
only ids, sources and three numbers a document are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.shared import configure, stored

#: bytes of text of a shard, groups that a shard holds at least, shards of a cell, and room above the mean
SHARD_BYTES = 64 << 20
PER_SHARD = 16
CELL = 256
SLACK = 0.02
DIMENSIONS = ("n_bytes", "n_tokens", "n_rows")


def pack(items: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """Shard of each row of ``items`` (n, dimensions), which are placed in the order given."""
    total = items.sum(axis=0).astype(float)
    share = items / np.where(total > 0, total * (1 + slack) / shards, 1.0)  # 1: all that a shard may hold
    residual = np.ones((shards, items.shape[1]))
    out = np.empty(len(items), np.int64)
    for i, v in enumerate(share):
        gain = residual @ v
        fits = (residual >= v - 1e-12).all(axis=1)
        # equal products, up to rounding, go to the first shard
        gain = np.round(np.where(fits, gain, gain - 1e6) if fits.any() else gain, 9)
        out[i] = k = int(gain.argmax())
        residual[k] -= v
    return out


def order(items: np.ndarray) -> np.ndarray:
    """Falling by the largest share of the total in any dimension; equal ones stay as they were."""
    total = items.sum(axis=0).astype(float)
    return np.argsort(-np.round((items / np.where(total > 0, total, 1.0)).max(axis=1), 12), kind="stable")


def _pack_cell(table: pa.Table) -> pa.Table:
    table = table.sort_by([("gid", "ascending"), ("part", "ascending")])
    items = np.stack([table[c].to_numpy().astype(float) for c in DIMENSIONS], axis=1)
    first, shards = table["first"][0].as_py(), table["shards"][0].as_py()
    by = order(items)
    shard = np.empty(len(items), np.int64)
    shard[by] = first + pack(items[by], shards)
    return pa.table({"gid": table["gid"], "part": table["part"], "shard": pa.array(shard, pa.int64())})


def sizes(text: Column) -> tuple[Column, Column]:
    """Bytes and tokens (runs without white space) of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", shard_bytes: int = SHARD_BYTES, cell: int = CELL) -> DataFrame:
    """``(id, group, shard, n_bytes, n_tokens)`` for every row of ``docs``; shards are numbered from 0.

    A null text has no bytes and tokens but is a row; a null group is a group; null ids stay null and together; repeated rows
    stay together. A single document larger than a shard fills one. An empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    configure(spark)
    n_bytes, n_tokens = sizes(F.col(text_col))
    narrow = stored(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.xxhash64(F.col(group_col).cast("string"), F.isnull(group_col)).alias("gid"), n_bytes.alias("n_bytes"), n_tokens.alias("n_tokens")), "sizes")
    groups = narrow.groupBy("gid").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    total = groups.agg(F.sum("b"), F.sum("n")).first()
    shards = max(1, math.ceil((total[0] or 0) / shard_bytes))
    cells = math.ceil(shards / cell)
    # a group is at most its share of a shard, by bytes and by rows
    most = F.greatest(F.col("b") / F.lit(shard_bytes / PER_SHARD), F.col("n") / F.lit(max(1.0, (total[1] or 1) / shards / PER_SHARD)))
    parts = groups.select(F.col("gid").alias("g"), F.greatest(F.ceil(most), F.lit(1)).cast("bigint").alias("parts"))
    # the size of ``parts`` decides how this joins: broadcast below the session's threshold, else shuffled, skew split by AQE
    rows = narrow.join(parts, narrow["gid"] == parts["g"]).select("id", "grp", "gid", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "n_bytes", "n_tokens")
    items = rows.groupBy("gid", "part").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    c = F.pmod(F.xxhash64("gid", "part", F.lit("cell")), F.lit(cells))
    # shard i belongs to cell i * cells // shards: cells differ by one shard at most
    first = F.ceil(F.col("cell") * F.lit(shards) / F.lit(cells)).cast("bigint")
    upto = F.ceil((F.col("cell") + 1) * F.lit(shards) / F.lit(cells)).cast("bigint")
    celled = items.withColumn("cell", c).withColumn("first", first).withColumn("shards", upto - F.col("first"))
    placed = stored(celled.groupBy("cell").applyInArrow(_pack_cell, "gid bigint, part bigint, shard bigint"), "placed")
    p = placed.select(F.col("gid").alias("pg"), F.col("part").alias("pp"), "shard")
    out = rows.join(p, (rows["gid"] == p["pg"]) & (rows["part"] == p["pp"]))
    return out.select(F.col("id").alias(id_col), F.col("grp").alias(group_col), "shard", "n_bytes", "n_tokens")
