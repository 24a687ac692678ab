"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import decontam, langid, linededup, media, pieces, pii, secrets, sharding, simhash, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures(_read(spark, sf_dir, "embeddings")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents"), count_col="lines_removed")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))


#: shards of the query: small ones in small cells, so that every table of the lake, down to a few MB, fills dozens of shards in several cells
SHARD_BYTES, CELL = 64 << 10, 8


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shard_bytes=SHARD_BYTES, cell=CELL)


def sharding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards of op6 hold together, how many there are, and whether each source's documents are all there."""
    rows = op6_sharding(spark, sf_dir)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("shard").isNull()).alias("unplaced"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_read(spark, sf_dir, "documents"))


def sentencepiece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    rows = pieces.encode_texts(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", pieces.decoded(F.col("ids")).alias("text"), F.col("lossless"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination,
        "op4_pii": op4_pii,
        "op5_line_dedup": op5_line_dedup,
        "op6_sharding": op6_sharding,
        "op7_secrets": op7_secrets,
        "op8_simhash": op8_simhash,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_language": op10_language,
        "sharding_totals": sharding_totals,
        "sentencepiece_roundtrip": sentencepiece_roundtrip,
    }


#: sums of the documents themselves
_TOTALS = r"""
SELECT source, count(*) AS n, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS n_bytes,
       CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\x{0B}\f\r]+')), 0)) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS unplaced
FROM documents GROUP BY source
"""
#: what comes back is what went in, but for U+2581, which stands for a blank
_ROUNDTRIP = "SELECT doc_id, replace(coalesce(text, ''), '▁', ' ') AS text, NOT contains(coalesce(text, ''), '▁') AS lossless FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.ORACLE_SQL, "op5_line_dedup": linededup.ORACLE_SQL, "sharding_totals": _TOTALS, "sentencepiece_roundtrip": _ROUNDTRIP}
