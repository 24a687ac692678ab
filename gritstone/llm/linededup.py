"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are a window, hashed to 128 bits. A window that occurs more than once anywhere keeps
its first occurrence, by document id and then by position; the lines that later occurrences cover are removed, overlapping
windows merged. Only hashes are shuffled to find the windows; the texts move once, for the join with what is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.shared import configure, id_key, stored

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column, window: int) -> Column:
    """Array of ``(pos, h1, h2)``; windows of blank lines alone, of texts with too few lines and of nulls are left out."""

    def one(lines: Column, i: Column) -> Column:
        own = [F.get(lines, i + F.lit(k)) for k in range(window)]
        blank = F.length(F.trim(F.concat(*own))) == 0
        return F.struct(i.alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(7), *own).alias("h2"), blank.alias("blank"))

    every = F.transform(
        F.array(_lines(text)), lambda lines: F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - window), lambda i: one(lines, i)), lambda x: ~x["blank"])
    )
    return F.when(F.size(_lines(text)) >= window, F.get(every, F.lit(0)))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(__kid, __kh, __gone)``: of each text with later occurrences, the line numbers (from 0) that these cover."""
    configure(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__kh"), _windows(F.col(text_col), window).alias("__w"))
    # repeated rows, equal in id and text, are one occurrence: as many as there are, they are treated alike
    spread = rows.where("__w is not null").select("__id", "__kh", F.explode("__w").alias("w")).select("__id", "__kh", "w.pos", "w.h1", "w.h2")
    wins = stored(spread, "windows")
    # nulls come first: an id that is null sorts before all others
    place = F.struct(F.col("__id").isNotNull().alias("has"), F.col("__id").alias("id"), F.col("__kh").alias("kh"), F.col("pos").alias("pos"))
    first = wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = wins.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    key = id_key("__id").alias("__kid")
    return later.groupBy(key, "__kh").agg(F.collect_set("pos").alias("__p")).select("__kid", "__kh", F.array_distinct(F.flatten(F.transform("__p", lambda p: F.sequence(p, p + window - 1)))).alias("__gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, count_col: str | None = None) -> DataFrame:
    """``docs`` with covered lines removed from the text; with ``count_col``, also how many were removed.

    Rows keep their number and all other columns. A text that loses every line becomes empty; nulls stay null; texts with
    fewer lines than a window have none and stay as they are; blank lines count as lines, but windows of blank lines alone
    don't match. Rows equal in id and text count as one occurrence. An empty table gives an empty table.
    """
    gone = covered_lines(docs, id_col, text_col, window)
    keys = [id_key(id_col).alias("__kid"), F.xxhash64(F.col(text_col)).alias("__kh")]
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *keys).join(gone, ["__kid", "__kh"], "left")
    text = F.col("__row").getField(text_col)
    kept = F.filter(_lines(text), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    new = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size("__gone"), F.lit(0)).alias(count_col))
    return rows.select(*out)


#: The same rows in SQL, over plain lines instead of their hashes.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), wins AS (
  SELECT doc_id, text, i AS pos, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w
  FROM lines, unnest(range(0, len(l) - 2)) AS u(i)
), live AS (
  SELECT * FROM wins WHERE trim(replace(w, chr(10), '')) <> ''
), ranked AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM live
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, unnest([0, 1, 2]) AS v(d) WHERE k > 1
), kept AS (
  SELECT doc_id, string_agg(l[i + 1], chr(10) ORDER BY i) AS text, count(*) AS n
  FROM lines, unnest(range(0, len(l))) AS u(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = lines.doc_id AND g.pos = i)
  GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text, d.lang, d.source,
       coalesce(length(k.text), 0) AS n_chars,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
