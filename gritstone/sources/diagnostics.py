"""Reports of linters and type checkers as one relation (tool, file, line, col, code, message, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T

_LINT = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>>>"
_TYPES = "struct<generalDiagnostics:array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:struct<line:int,character:int>>>>>"


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def lint(reports: DataFrame, json_col: str = "json", root: str = "", tool: str = "lint") -> DataFrame:
    """Rows of a linter's JSON reports; malformed reports, and items without file or code, are dropped."""
    items = reports.select(F.explode(F.from_json(json_col, _LINT)).alias("d")).where("d.filename is not null and d.code is not null")
    return items.select(F.lit(tool).alias("tool"), _relative(F.col("d.filename"), root).alias("file"), F.col("d.location.row").alias("line"), F.col("d.location.column").alias("col"), F.col("d.code").alias("code"), F.col("d.message").alias("message"), F.lit("error").alias("severity"))


def type_check(reports: DataFrame, json_col: str = "json", root: str = "", tool: str = "types") -> DataFrame:
    """Rows of a type checker's JSON reports; its lines count from 0, these from 1."""
    items = reports.select(F.explode(F.from_json(json_col, _TYPES)["generalDiagnostics"]).alias("d")).where("d.file is not null")
    start = "d.range.start"
    return items.select(F.lit(tool).alias("tool"), _relative(F.col("d.file"), root).alias("file"), (F.col(f"{start}.line") + 1).alias("line"), (F.col(f"{start}.character") + 1).alias("col"), F.coalesce("d.rule", F.lit("")).alias("code"), F.col("d.message").alias("message"), T.severity(F.col("d.severity")).alias("severity"))


def docstring_findings(reports: DataFrame, json_col: str = "json", root: str = "") -> DataFrame:
    """The linter's findings on docstrings: codes D and digits."""
    return lint(reports, json_col, root).where(F.col("code").rlike(r"^D\d"))


def report_json(diagnostics: DataFrame) -> DataFrame:
    """``(file, json)``: what a report file has of each file."""
    from gritstone.operators.gates import by_file

    return by_file(diagnostics).select("file", F.to_json(F.struct("n", "items")).alias("json"))
