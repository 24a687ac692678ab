"""Content-addressed caches as tables: lookup, gaps, upsert, pruning and audit.

A cache is ``(cache_key, content_hash, vec)``; function hashes are ``(file, name, start_line, hash, text_hash)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions import vector as V


def lookup(functions: DataFrame, cache: DataFrame, hash_col: str = "content_hash", value_col: str = "vec") -> DataFrame:
    """Every function with its cached value, null where there is none."""
    return functions.join(cache.select(F.col("content_hash").alias(hash_col), value_col), hash_col, "left")


def uncached(functions: DataFrame, caches: list[DataFrame], hash_col: str = "content_hash") -> DataFrame:
    """Functions that any of the caches lacks."""
    have = reduce(lambda a, b: a.join(b, hash_col, "left_semi"), [c.where("vec is not null").select(F.col("content_hash").alias(hash_col)).distinct() for c in caches])
    return functions.join(have, hash_col, "left_anti")


def member_gaps(functions: DataFrame, cache: DataFrame, members: DataFrame) -> DataFrame:
    """``(cli_name, missing)`` for each provider: functions that a member of it lacks, the larger of a query's and a passage's.

    ``members`` is (cache_key, cli_name), ``functions`` (content_hash).
    """
    wanted = functions.select("content_hash").crossJoin(F.broadcast(members))  # the dimension of providers: a fixed handful
    have = cache.where("vec is not null").select("cache_key", "content_hash", F.lit(1).alias("there"))
    per = wanted.join(have, ["cache_key", "content_hash"], "left").groupBy("cli_name", "cache_key").agg(F.count_if(F.col("there").isNull()).alias("m"))
    return per.groupBy("cli_name").agg(F.max("m").alias("missing"))


def audit(cache: DataFrame, valid: DataFrame) -> DataFrame:
    """``(cache_key, size, orphans, missing, valid)`` of each cache against the hashes in use."""
    keys = valid.select("content_hash").distinct()
    marked = cache.select("cache_key", "content_hash").join(keys.select(F.col("content_hash").alias("v")), F.col("content_hash") == F.col("v"), "left")
    per = marked.groupBy("cache_key").agg(F.count("*").alias("size"), F.count_if(F.col("v").isNull()).alias("orphans"), F.count_distinct("v").alias("used"))
    total = keys.agg(F.count("*").alias("valid"))
    return per.crossJoin(F.broadcast(total)).select("cache_key", "size", "orphans", (F.col("valid") - F.col("used")).alias("missing"), "valid")


def keep_valid(cache: DataFrame, valid: DataFrame) -> DataFrame:
    """The cache without orphans."""
    return cache.join(valid.select("content_hash"), "content_hash", "left_semi")


def orphans(cache: DataFrame, valid: DataFrame) -> DataFrame:
    return cache.join(valid.select("content_hash"), "content_hash", "left_anti")


def valid_hashes(functions: DataFrame) -> DataFrame:
    """``(text_hash, hash)``: of functions with the same text the last one's tree hash."""
    return functions.where("text_hash is not null").groupBy("text_hash").agg(F.max_by("hash", F.struct("file", "start_line", "name")).alias("hash"))


def duplicates(df: DataFrame, hash_col: str, ord_col: str) -> DataFrame:
    """``(hash, n, first)`` of what occurs more than once."""
    return df.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(ord_col).alias("first")).where("n > 1")


def first_of(df: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """The first row of each identity."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(ord_col))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both; where both have a key, the new one."""
    values = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    pick = lambda c: F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    joined = o.join(n, on, "full")
    return joined.select(*[pick(c) for c in (*keys, *values)]).select(*old.columns)


def in_scope(col: Column, scopes: list[str]) -> Column:
    """True for a file that is one of the scopes or lies below one."""
    return reduce(lambda a, b: a | b, [(col == s) | F.startswith(col, F.lit(s.rstrip("/") + "/")) | F.lit(s in ("", ".")) for s in scopes], F.lit(False))


def synchronize(old: DataFrame, current: DataFrame, scopes: list[str], keys: list[str], file_col: str = "file") -> DataFrame:
    """Function hashes after a scan of ``scopes``: what is gone from there is deleted, what was found is upserted."""
    stale = old.where(in_scope(F.col(file_col), scopes)).join(current, keys, "left_anti").select(*keys)
    return upsert(old.join(stale, keys, "left_anti"), current, keys)


def scoped_only(hashes: DataFrame, scopes: list[str], file_col: str = "file", hash_col: str = "text_hash") -> DataFrame:
    """Hashes that occur inside the scopes and nowhere else."""
    inside = in_scope(F.col(file_col), scopes)
    return hashes.where(inside & F.col(hash_col).isNotNull()).select(hash_col).subtract(hashes.where(~inside).select(hash_col))


def rebuild_combined(functions: DataFrame, cache: DataFrame, members: list[tuple[str, str]]) -> DataFrame:
    """``(content_hash, vec)``: the joined vector of each function that has all members, keyed by its text's hash.

    ``members`` are (cache_key, hash column) in order. One shuffle of the cache, whatever their number: rows are gathered a function
    and placed by the member's number.
    """
    pairs = functions.where("text_hash is not null and hash is not null").select("text_hash", "hash").distinct()
    number = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(members) for x in (name, k)])
    wanted = pairs.select("text_hash", "hash", F.explode(F.array(*[F.struct(F.lit(name).alias("cache_key"), F.col(col).alias("content_hash")) for name, col in members])).alias("m")).select("text_hash", "hash", "m.*")
    got = wanted.join(cache.where(V.is_vector(F.col("vec"))), ["cache_key", "content_hash"]).withColumn("k", F.element_at(number, F.col("cache_key")))
    whole = got.groupBy("text_hash", "hash").agg(F.count_distinct("k").alias("n"), F.array_sort(F.collect_list(F.struct("k", V.doubles(F.col("vec")).alias("v")))).alias("m")).where(F.col("n") == len(members))
    vec = V.l2_normalize(F.flatten(F.transform("m", lambda x: x["v"])))
    return whole.groupBy("text_hash").agg(F.max_by(vec, "hash").alias("vec")).select(F.col("text_hash").alias("content_hash"), "vec")


def retain_out_of_scope(rebuilt: DataFrame, old: DataFrame, replaced: DataFrame) -> DataFrame:
    """The rebuilt vectors, and old ones that were neither rebuilt nor replaced."""
    kept = old.join(replaced.select("content_hash"), "content_hash", "left_anti").join(rebuilt.select("content_hash"), "content_hash", "left_anti")
    return rebuilt.unionByName(kept)
