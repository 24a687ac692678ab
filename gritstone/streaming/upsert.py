"""A stream of new vectors merged into a cache, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gritstone.operators.cache import upsert
from gritstone.sources.vectors import read_cache, write_cache


def merge_batch(batch: DataFrame, path: str, staging: str) -> None:
    """Replaces the partitions that ``batch`` touches; of repeated keys the greatest vector counts, so a replayed batch changes nothing.

    The merged partitions are written aside first: a partition can't be overwritten while it is read.
    """
    keys = [r[0] for r in batch.select("cache_key").distinct().collect()]  # cache keys: a fixed handful
    if not keys:
        return
    spark = batch.sparkSession
    new = batch.groupBy("cache_key", "content_hash").agg(F.max("vec").alias("vec"))
    try:
        merged = upsert(read_cache(spark, path, keys), new, ["cache_key", "content_hash"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        merged = new
    write_cache(merged, staging)
    write_cache(read_cache(spark, staging, keys), path)


def merge_stream(vectors: DataFrame, path: str, staging: str, checkpoint: str) -> StreamingQuery:
    """Starts merging ``vectors``, a stream of (cache_key, content_hash, vec), into the cache at ``path``, until what is there now is merged."""
    writer = vectors.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path, staging))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
