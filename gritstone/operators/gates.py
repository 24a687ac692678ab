"""Gates: metrics against baselines, diagnostics by file and code, densities and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T


def regressions(metrics: DataFrame, baseline: DataFrame, keys: list[str], threshold: float | None, value_col: str = "value", below: bool = False, zero_is_none: bool = False) -> DataFrame:
    """Rows of ``metrics`` beyond their baseline, or beyond ``threshold`` where they have none.

    With ``below`` the smaller is the worse. With ``zero_is_none`` a baseline of 0 counts as none. Without a threshold, rows without a baseline pass.
    """
    b = F.nullif(F.col("__b"), F.lit(0)) if zero_is_none else F.col("__b")
    joined = metrics.join(baseline.select(*keys, F.col(value_col).alias("__b")), keys, "left").withColumn("allowed", F.coalesce(b, F.lit(threshold).cast("double")))
    worse = F.col(value_col) < F.col("allowed") if below else F.col(value_col) > F.col("allowed")
    return joined.where(worse).drop("__b")


def beyond(metrics: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """Rows of which some metric is above its limit, and which ones are: several gates in one scan. ``limits`` are column: (most, flag)."""
    flags = {flag: F.coalesce(F.col(c) > most, F.lit(False)) for c, (most, flag) in limits.items()}
    marked = metrics.withColumns(flags)
    return marked.where(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def classify(counts: DataFrame, baseline: DataFrame, keys: list[str], count_col: str = "n") -> DataFrame:
    """``(keys, n, allowed, class)`` of counts above their baseline: a regression, or new where that is 0 or missing."""
    joined = counts.join(baseline.select(*keys, F.col(count_col).alias("__b")), keys, "left").withColumn("allowed", F.coalesce("__b", F.lit(0)))
    return joined.where(F.col(count_col) > F.col("allowed")).select(*keys, count_col, "allowed", F.when(F.col("allowed") > 0, "regression").otherwise("new").alias("class"))


def top_codes(diagnostics: DataFrame, code_col: str = "code", limit: int = 5, order: list[str] | None = None) -> DataFrame:
    """``(code, n)``: the most frequent; of equally frequent ones the one that comes first by the columns ``order``, then by name."""
    first = [F.min(F.struct(*order)).alias("__first")] if order else []
    counted = diagnostics.groupBy(code_col).agg(F.count("*").alias("n"), *first)
    by = [F.desc("n"), *(["__first"] if order else []), code_col]
    return counted.orderBy(*by).limit(limit).select(code_col, "n")


def report(diagnostics: DataFrame) -> DataFrame:
    """``(tool, errors, warnings, informations, total)``, and a row for all tools together (tool null); severities other than these are in total alone."""
    s = F.col("severity")
    count = lambda what: F.count_if(s == what)
    return diagnostics.rollup("tool").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("information").alias("informations"), F.count("*").alias("total"))


def by_file(diagnostics: DataFrame) -> DataFrame:
    """``(file, n, items)``: each file's diagnostics in order of place."""
    item = F.struct("line", "col", "tool", "code", "message", "severity")
    return diagnostics.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


def missing_docstrings(items: DataFrame, dir_col: str, has_doc: Column, allowed: DataFrame | None = None, most: int = 0) -> DataFrame:
    """``(dir, items, missing, allowed, ok)`` of every directory; its own limit, else ``most``."""
    per = items.groupBy(dir_col).agg(F.count("*").alias("items"), F.count_if(~has_doc).alias("missing"))
    limit = per.join(allowed.select(dir_col, F.col("allowed").alias("__a")), dir_col, "left") if allowed is not None else per.withColumn("__a", F.lit(None).cast("bigint"))
    out = limit.withColumn("allowed", F.coalesce("__a", F.lit(most)).cast("bigint")).drop("__a")
    return out.withColumn("ok", F.col("missing") <= F.col("allowed"))


def density_scope(files: DataFrame, root_tests: str = "tests") -> DataFrame:
    """Files whose comments count: those that don't lie in the project's own directory of tests (paths relative to its root)."""
    return files.where(~F.startswith("file", F.lit(root_tests.rstrip("/") + "/")))


def violation_values(violations: DataFrame, keys: list[str]) -> DataFrame:
    """``(path, value)`` of what violates now, as a baseline has it: the current values that a ratchet takes."""
    return violations.select(F.array(*[F.col(k).cast("string") for k in keys]).alias("path"), F.col("value").cast("double").alias("value"))


def density_violations(files: DataFrame, ranges: DataFrame, least: float, most: float) -> DataFrame:
    """``(file, density, bound, side)`` of files outside their range; those with short functions alone are exempt.

    ``files`` is (file, density, exempt), ``ranges`` (file, min, max).
    """
    j = files.join(ranges.select("file", F.col("min").alias("__min"), F.col("max").alias("__max")), "file", "left").withColumn("d", F.round("density", 2))
    j = j.withColumn("lo", F.coalesce("__min", F.lit(least))).withColumn("hi", F.coalesce("__max", F.lit(most)))
    out = j.where(~F.col("exempt") & ((F.col("d") < F.col("lo")) | (F.col("d") > F.col("hi"))))
    return out.select("file", F.col("d").alias("density"), F.when(F.col("d") < F.col("lo"), F.col("lo")).otherwise(F.col("hi")).alias("bound"), F.when(F.col("d") < F.col("lo"), "below").otherwise("above").alias("side"))


def aggregate_density(files: DataFrame) -> DataFrame:
    """One row: comments per comment and source line of all files, exempt or not."""
    s = files.agg(F.sum("sloc").alias("sloc"), F.sum("comments").alias("comments"))
    return s.select("sloc", "comments", F.round(T.density(F.col("comments"), F.col("sloc") + F.col("comments")), 6).alias("density"))


def widened_ranges(files: DataFrame, ranges: DataFrame, least: float, most: float) -> DataFrame:
    """The ranges after an update: files outside the general range get one that just admits them."""
    from gritstone.operators.cache import upsert

    d = F.round("density", 2)
    new = files.where((d < least) | (d > most)).select("file", F.least(d, F.lit(least)).alias("min"), F.greatest(d, F.lit(most)).alias("max"))
    return upsert(ranges.select("file", "min", "max"), new, ["file"])


def few_calls(candidates: DataFrame, calls: DataFrame, most: int = 1) -> DataFrame:
    """``(identifier, name, line, call_count)`` of forwarding functions that are called at most ``most`` times."""
    counts = calls.groupBy("name").agg(F.sum("n").alias("call_count"))
    out = candidates.join(counts, "name", "left").select("identifier", "name", "line", F.coalesce("call_count", F.lit(0)).alias("call_count"))
    return out.where(F.col("call_count") <= most)
