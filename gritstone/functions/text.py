"""Texts, names and lines as column functions: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what ends a line for a Python source, besides \n
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
IGNORED_DIRS = ("build", "dist", "env", "node_modules", "site-packages", "venv", "__pycache__", *(f".{x}" for x in ("cache", "eggs", "env", "git", "hg", "mypy_cache", "pyright", "pytest_cache", "ruff_cache", "svn", "tox", "venv")))


def content_hash(text: Column) -> Column:
    """Hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last end adds no line, an empty text has none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Number of lines that a file of this text has when read line by line at \\n."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("int")


def executable_lines(text: Column) -> Column:
    """Lines that are neither blank nor begin with #."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda line: (F.trim(line) != "") & ~F.startswith(F.trim(line), F.lit("#"))))


def hash_lines(text: Column) -> Column:
    """Lines that contain a #: how comments are found where a text can't be tokenised."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda line: F.contains(line, F.lit("#"))))


def density(comments: Column, code: Column) -> Column:
    """Comments as a percentage of code lines, 0 where there are none."""
    return F.when(code <= 0, F.lit(0.0)).otherwise(F.lit(100.0) * comments / code)


def append_unique(parts: Column, more: Column) -> Column:
    """``parts`` and after them what of ``more`` isn't there yet, in order."""
    return F.concat(parts, F.array_except(more, parts))


def function_text(source: Column, start: Column, stop: Column) -> Column:
    """Lines from start to stop, counted from 1."""
    return F.array_join(F.slice(split_lines(source), start, stop - start + 1), "\n")


def cache_key(name: Column, model: Column, schema: Column, content: Column) -> Column:
    return F.concat_ws("|", name, model, schema, content)


def cli_name(cache: Column) -> Column:
    """Name of a provider at the command line, from its cache's name."""
    bare = cache
    for ending in ("_embeddings", "_query", "_passage"):
        bare = F.regexp_replace(bare, f"{ending}$", "")
    return F.translate(bare, "_", "-")


def query_text(docstring: Column, text: Column) -> Column:
    """The docstring, or the text where that is missing or empty."""
    return F.coalesce(F.nullif(docstring, F.lit("")), text)


def percent(score: Column) -> Column:
    """``%.1f%%`` as in C and Python: the double itself is rounded, exact halves to even; Java rounds its shortest decimal form, halves up.

    Twenty times the score is compared with the odd number between two tenths: 16 x and 4 x are exact, and so is the sum of both with its error.
    """
    x = F.abs(score * 100)
    low = F.floor(x * 10)
    big, small = x * 16, x * 4
    total = big + small
    beyond = (total - (2 * low + 1)) + (small - (total - big))
    # x * 10 may itself be rounded up to the next tenth, so the odd number below counts too
    under = (total - (2 * low - 1)) + (small - (total - big))
    up = lambda d, n: F.when((d > 0) | ((d == 0) & (n % 2 == 1)), 1).otherwise(0)
    tenths = low - 1 + up(under, low - 1) + up(beyond, low)
    sign = F.when(F.signum(score) < 0, "-").otherwise("")
    exact = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(x < 1e12, exact).otherwise(F.format_string("%.1f%%", score * 100))


def place(file: Column, line: Column, name: Column) -> Column:
    return F.format_string("%s:%d %s()", file, line, name)


def pair_message(file_a: Column, line_a: Column, name_a: Column, file_b: Column, line_b: Column, name_b: Column, score: Column) -> Column:
    return F.concat(place(file_a, line_a, name_a), F.lit(" - "), place(file_b, line_b, name_b), F.lit(" - similarity: "), percent(score))


def neighbours_message(file: Column, line: Column, name: Column, n: Column, first: Column) -> Column:
    """A function, how many others are like it, and the first of these; ``first`` is an array of (place, score)."""
    shown = F.array_join(F.transform(first, lambda x: F.concat(x["place"], F.lit(" ("), percent(x["score"]), F.lit(")"))), ", ")
    return F.concat(place(file, line, name), F.lit(" has "), n.cast("string"), F.lit(" similar functions: "), shown)


def ignored_path(path: Column, ignored: tuple[str, ...] = IGNORED_DIRS) -> Column:
    """True if a part of the path is an ignored directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored)))


def severity(value: Column) -> Column:
    """error, warning or information, also from 0, 1 and 2; anything else is information."""
    s = F.lower(value.cast("string"))
    return F.when(s.isin("0", "error"), "error").when(s.isin("1", "warning"), "warning").otherwise("information")


def glob(value: Column, patterns: list[str]) -> Column:
    """True if a glob pattern (case-sensitive, whole value) matches."""
    import fnmatch

    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike("^" + fnmatch.translate(p).replace(r"\Z", r"\z").replace(r"\z", "$").replace("(?>", "(?:"))
    return out
