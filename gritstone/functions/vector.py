"""Vectors as ``array<double>`` columns; all arithmetic is in doubles, from left to right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; zero vectors stay as they are. The norm is computed once a vector."""
    both = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    unit = F.transform(both, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))
    return F.when(v.isNull(), F.lit(None).cast("array<double>")).otherwise(F.get(unit, F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector has no length. Not for joins: there, normalise first and take ``dot``."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.when(n == 0, F.lit(0.0)))


def query_passage_members(query: Column, passage: Column) -> tuple[Column, Column]:
    """Both orders of a query and a passage vector, each joined and normalised."""
    return l2_normalize(F.concat(query, passage)), l2_normalize(F.concat(passage, query))


def combined(members: list[Column]) -> Column:
    """All members one after another, normalised; null if any is null."""
    whole = F.concat(*members)
    missing = reduce(lambda x, y: x | y, [m.isNull() for m in members])
    return F.when(~missing, l2_normalize(whole))


def is_vector(v: Column) -> Column:
    """True for a non-empty vector without nulls, NaN and infinities."""
    d = doubles(v)
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return d.isNotNull() & (F.size(d) > 0) & F.coalesce(fine, F.lit(False))


def similarity_index(m: Column) -> Column:
    """25.403 m^5."""
    return F.lit(25.403) * F.pow(m, F.lit(5.0))


def refactor_index(cc: Column, cog: Column, index: Column) -> Column:
    return F.lit(0.25) * cc + F.lit(0.15) * cog + F.lit(0.6) * index
