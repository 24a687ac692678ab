"""A training corpus from documents: toxic ones out, repeated lines out, one of each group of copies, no benchmark leaks, encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import decontam, linededup, pieces, simhash, toxicity
from gritstone.llm.shared import checkpoint_dir, delete, scratch

#: The encoding, and the copies' fingerprints, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose passages together are significantly toxic go; the model is fitted on these documents and the table of labels.

    Null and empty texts stay, and so do rows with a null id; repeated rows go or stay together.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document that had lines and keeps none goes too. n_chars is set anew.

    Nulls, and texts of fewer than three lines, stay as they are; repeated rows count as one occurrence.
    """
    out = linededup.dedup_lines(docs, count_col="__removed").where("__removed = 0 or text <> ''").drop("__removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (a null id first); one of repeated rows too.

    Documents without a word all stay.
    """
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 13 words in a row, or a whole shorter item, with the benchmark go; nulls and empty texts stay."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining document, with the columns that describe it; null and empty texts have none."""
    keep = tuple(c for c in ("lang", "source", "n_chars") if c in docs.columns)
    return pieces.encode_texts(docs, keep=keep)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Each stage's own tables, and the stage before, are deleted once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            delete(spark, f"{base}/{before}")
        docs, before = spark.read.parquet(f"{base}/{name}"), name
    return docs
