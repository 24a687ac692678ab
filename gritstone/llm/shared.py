"""What the operators of this subpackage share: tables cut loose from their lineage, and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are large: fewer rows an Arrow batch than by default, so that a worker's memory stays bounded.
ARROW_ROWS = 1000
#: the tables that each open ``scratch`` has to delete, the innermost last
_open: list[list[str]] = []


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry texts (never raised, and left so: plans read it when they run), and find the shared folder."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, shared by all executors; where that is unset a local one, on a local master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not now.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="gritstone-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps survive the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gritstone-{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, on whatever file system that is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``stored`` wrote inside it: for callers that have written their result by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def id_key(id_col: str) -> Column:
    """A string for any id, and another one for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Takes pairs of longs; gives ``(node, root)`` for each node of an edge, root being the component's smallest node.
    Each round reads and writes one table of the shared folder, and deletes the one before; rounds grow with the logarithm of
    the longest path.
    """
    spark = edges.sparkSession
    now, last, kept = None, None, []

    def turn(df: DataFrame) -> DataFrame:
        with_path = stored(df, "edges")
        kept.append(with_path.inputFiles()[0].rsplit("/", 1)[0] if with_path.inputFiles() else None)
        if len(kept) > 1 and kept[-2]:
            delete(spark, kept[-2])
        return with_path

    now = turn(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = turn(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
