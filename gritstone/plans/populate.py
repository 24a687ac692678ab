"""Filling the caches: what functions of some scopes lack is embedded, the rest is pruned and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone import schema
from gritstone.operators import cache as C
from gritstone.sources.providers import Provider, populate


def inspect(functions: DataFrame, cache: DataFrame) -> DataFrame:
    """``(cache_key, missing)`` for every provider that is stored: distinct hashes of ``functions`` that its cache lacks."""
    hashes = functions.select(F.explode(F.array(F.struct(F.lit("TEXT").alias("t"), F.col("text_hash").alias("content_hash")), F.struct(F.lit("AST").alias("t"), F.col("hash").alias("content_hash")))).alias("h")).select("h.*").where("content_hash is not null").distinct()
    dim = F.broadcast(schema.providers(functions.sparkSession).where("kind <> 'symmetrized'").select(F.col("name").alias("cache_key"), "hash_type"))  # a fixed handful
    wanted = hashes.join(dim, hashes["t"] == dim["hash_type"])
    have = cache.where("vec is not null").select("cache_key", "content_hash", F.lit(1).alias("there"))
    return wanted.join(have, ["cache_key", "content_hash"], "left").groupBy("cache_key").agg(F.count_if(F.col("there").isNull()).alias("missing"))


def run(functions: DataFrame, cache: DataFrame, embedders: dict[str, tuple[Provider, str, str]], cached_only: bool = False) -> DataFrame:
    """The cache with what ``embedders`` (cache key: provider, hash column, text column) add, and the combined vectors rebuilt.

    With ``cached_only`` nothing is embedded or changed.
    """
    if cached_only:
        return cache
    for key, (provider, hash_col, text_col) in embedders.items():
        if provider.is_configured():
            cache = populate(functions, cache, provider, key, hash_col, text_col)
    members = [(p.name, p.hash_column) for p in schema.PROVIDERS if p.name in schema.MEMBERS]
    combined = C.rebuild_combined(functions, cache, members).select(F.lit("combined").alias("cache_key"), "content_hash", F.col("vec").cast("array<float>").alias("vec"))
    return C.upsert(cache, combined, ["cache_key", "content_hash"])
