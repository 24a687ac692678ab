"""All queries of the engine, apart from those of the llm subpackage, with their SQL.

The tables of the lake stand in for those of a source tree: ``embeddings`` are functions with vectors, ``documents`` files,
``labels`` a partial cache of them, ``events`` diagnostics. Every query reads its whole tables; those named ``python_*`` scan the
three sources below, and ``cli_names`` is the dimension of providers, as the lake has no tables for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from gritstone import schema
from gritstone.functions import text as T
from gritstone.functions import vector as V
from gritstone.operators import baseline as B
from gritstone.operators import cache as C
from gritstone.operators import gates as G
from gritstone.operators import reduce as R
from gritstone.operators import similarity as S
from gritstone.sources import pysource as P

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: thresholds under which the lake's vectors have partners at all; the API's defaults are those of ``schema``
PAIR, NEAR, REFACTOR, TOP = 0.40, 0.35, 6.0, 20
_EXCLUDED = [["label_1", "label_2"], ["label_3", "label_3"], ["label_4"]]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cosine_rows(_read(spark, sf_dir, "embeddings"))


def _shown(pairs: DataFrame) -> DataFrame:
    """Scores as they are shown, to six digits; thresholds hold for what is behind them."""
    return pairs.withColumn("score", F.round("score", 6) + 0.0)


# --- vectors and pairs

_PAIRS = """
  SELECT a.vec_id AS i, b.vec_id AS j, a.label AS la, b.label AS lb,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw, round(raw, 6) + 0.0 AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
"""


@_query(f"SELECT i, j, score FROM ({_PAIRS}) WHERE raw >= {PAIR}")
def sim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.pairs(_vectors(spark, sf_dir), PAIR))


@_query(f"""SELECT i, j, score FROM ({_PAIRS}) WHERE raw >= {PAIR}
  AND NOT (contains('label_' || la, 'label_1') AND contains('label_' || lb, 'label_2'))
  AND NOT (contains('label_' || la, 'label_2') AND contains('label_' || lb, 'label_1'))
  AND NOT (contains('label_' || la, 'label_3') AND contains('label_' || lb, 'label_3'))""")
def sim_pairs_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    file = F.concat(F.lit("label_"), F.col("label"))
    flags = S.exclusion(file, F.concat_ws(":", file, F.col("vec_id").cast("string")), _EXCLUDED).alias("x")
    return _shown(S.pairs(S.cosine_rows(e, "vec_id", "embedding", flags), PAIR))


_NEIGHBOURS = f"""SELECT i, count(*) AS n, array_to_string(list_slice(list(j ORDER BY j), 1, 3), ',') AS first
  FROM ({_PAIRS}) WHERE raw >= {NEAR} GROUP BY i HAVING count(*) >= 2"""


@_query(_NEIGHBOURS)
def sim_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.neighbours(S.pairs(_vectors(spark, sf_dir), NEAR), NEAR)
    return found.withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@_query(f"SELECT i, j, score FROM ({_PAIRS})")
def sim_matrix_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs(_vectors(spark, sf_dir), digits=6)


_MAX = f"""SELECT e.vec_id AS ord, greatest(coalesce(max(p.score), 0), 0) AS max_sim FROM embeddings e
  LEFT JOIN (SELECT i AS v, score FROM ({_PAIRS}) UNION ALL SELECT j, score FROM ({_PAIRS})) p ON p.v = e.vec_id GROUP BY e.vec_id"""


@_query(_MAX)
def sim_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.max_similarity(_vectors(spark, sf_dir)).withColumn("max_sim", F.round("max_sim", 6) + 0.0)


@_query(f"SELECT ord, round(25.403 * pow(max_sim, 5), 6) AS idx FROM ({_MAX})")
def sim_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim_max(spark, sf_dir).select("ord", F.round(V.similarity_index(F.col("max_sim")), 6).alias("idx"))


@_query(f"""SELECT ord, cc, cog, max_sim, refactor FROM (
  SELECT m.ord, coalesce(cc, 0) AS cc, coalesce(cog, 0) AS cog, max_sim,
         round(0.25 * coalesce(cc, 0) + 0.15 * coalesce(cog, 0) + 0.6 * (25.403 * pow(max_sim, 5)), 6) AS refactor
  FROM ({_MAX}) m LEFT JOIN (
    SELECT doc_id AS ord, CAST(1 + length(text) - length(replace(text, ',', '')) AS INTEGER) % 40 AS cc,
           CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) % 30 AS cog FROM documents) d USING (ord))
  WHERE refactor >= {REFACTOR} ORDER BY refactor DESC, ord LIMIT {TOP}""")
def refactor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("int")
    metrics = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), ((count(",") + 1) % 40).alias("cc"), (count("\n") % 30).alias("cog"))
    return S.refactor_priorities(sim_max(spark, sf_dir), metrics, REFACTOR, TOP)


@_query("""WITH v AS (SELECT a.vec_id AS ord, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS p
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
  SELECT a.ord AS i, b.ord AS j, round((CASE WHEN b.p IS NULL THEN 0 ELSE list_cosine_similarity(a.q, b.p) END
    + CASE WHEN a.p IS NULL THEN 0 ELSE list_cosine_similarity(b.q, a.p) END) / 2, 6) + 0.0 AS score
  FROM v a JOIN v b ON a.ord < b.ord""")
def jina_symmetrized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    passages = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("passage"))
    both = e.join(passages, "vec_id", "left")
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    return S.pairs(S.symmetrized_rows(both, "vec_id", "embedding", "passage", dim), digits=6)


@_query("""SELECT vec_id, pos - 1 AS pos, round(v[pos] / sqrt(2 * list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS value
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), unnest(range(1, len(v) + 1)) AS u(pos)
  UNION ALL SELECT vec_id, len(v) + pos - 1, round(v[len(v) + 1 - pos] / sqrt(2 * list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), unnest(range(1, len(v) + 1)) AS u(pos)""")
def combined_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    whole = _read(spark, sf_dir, "embeddings").select("vec_id", V.combined([v, F.reverse(v)]).alias("c"))
    return whole.select("vec_id", F.posexplode("c").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 6) + 0.0).alias("value"))


@_query("""SELECT vec_id, pos - 1 AS pos, round(v[pos] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS value
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), unnest(range(1, len(v) + 1)) AS u(pos)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _read(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(V.doubles(F.col("embedding"))).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 6) + 0.0).alias("value"))


# --- caches

_HASHED = "(SELECT *, sha256(text) AS content_hash FROM documents)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").withColumn("content_hash", T.content_hash(F.col("text")))


@_query(f"SELECT doc_id, content_hash FROM {_HASHED}")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("doc_id", "content_hash")


@_query(f"SELECT content_hash, count(*) AS n, min(doc_id) AS first FROM {_HASHED} GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(_hashed(spark, sf_dir), "content_hash", "doc_id")


@_query(f"SELECT min(doc_id) AS doc_id, content_hash FROM {_HASHED} GROUP BY content_hash")
def identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of(_hashed(spark, sf_dir).select("doc_id", "content_hash"), ["content_hash"], "doc_id")


def _id_hash(col: str = "doc_id") -> Column:
    return T.content_hash(F.col(col).cast("string"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "source", _id_hash().alias("content_hash"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", _id_hash().alias("content_hash"))


@_query("SELECT d.doc_id, l.quality AS vec FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _labelled(spark, sf_dir).select("content_hash", F.col("quality").alias("vec"))
    return C.lookup(_functions(spark, sf_dir), cache).select("doc_id", "vec")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _labelled(spark, sf_dir).select("content_hash", F.col("quality").alias("vec"))
    return C.uncached(_functions(spark, sf_dir), [cache]).select("doc_id")


_CACHES = """(SELECT 'quality' AS cache_key, doc_id FROM labels UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1
  UNION ALL SELECT 'poor', doc_id FROM labels WHERE quality = 0)"""


def _caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _labelled(spark, sf_dir)
    keys = F.array_compact(F.array(F.lit("quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor")))
    return l.select(F.explode(keys).alias("cache_key"), "content_hash", F.array(F.col("quality").cast("float")).alias("vec"))


_VALID = "(SELECT doc_id FROM documents WHERE lang IN ('en', 'de'))"


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).select(_id_hash().alias("content_hash"))


@_query(f"""SELECT cache_key, count(*) AS size, count(*) - count(v.doc_id) AS orphans, (SELECT count(*) FROM {_VALID}) - count(DISTINCT v.doc_id) AS missing,
    (SELECT count(*) FROM {_VALID}) AS valid FROM {_CACHES} c LEFT JOIN {_VALID} v USING (doc_id) GROUP BY cache_key""")
def cache_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit(_caches(spark, sf_dir), _valid(spark, sf_dir))


@_query(f"SELECT cache_key, sha256(doc_id::VARCHAR) AS content_hash FROM {_CACHES} WHERE doc_id NOT IN {_VALID}")
def cache_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.orphans(_caches(spark, sf_dir), _valid(spark, sf_dir)).select("cache_key", "content_hash")


@_query(f"SELECT cache_key, sha256(doc_id::VARCHAR) AS content_hash FROM {_CACHES} WHERE doc_id IN {_VALID}")
def cache_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keep_valid(_caches(spark, sf_dir), _valid(spark, sf_dir)).select("cache_key", "content_hash")


@_query(f"""SELECT cli_name, max(m) AS missing FROM (
  SELECT k.cli_name, k.cache_key, count(*) - count(c.doc_id) AS m FROM documents d
  CROSS JOIN (VALUES ('quality', 'labels'), ('toxic', 'flags'), ('poor', 'flags')) k(cache_key, cli_name)
  LEFT JOIN {_CACHES} c ON c.cache_key = k.cache_key AND c.doc_id = d.doc_id GROUP BY 1, 2) GROUP BY 1""")
def member_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame([("quality", "labels"), ("toxic", "flags"), ("poor", "flags")], "cache_key string, cli_name string")
    return C.member_gaps(_functions(spark, sf_dir), _caches(spark, sf_dir), members)


@_query("SELECT doc_id, CASE WHEN quality = 0 THEN toxic + 10 ELSE quality END AS value FROM labels")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "labels")
    old = l.select("doc_id", F.col("quality").alias("value"))
    return C.upsert(old, l.where("quality = 0").select("doc_id", (F.col("toxic") + 10).alias("value")), ["doc_id"])


@_query("""SELECT source AS file, doc_id AS name, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS hash
  FROM documents WHERE NOT (source IN ('src1', 'src2') AND lang = 'en')""")
def scope_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("name"), "lang")
    old = d.select("file", "name", F.lit("old").alias("hash"))
    current = d.where(C.in_scope(F.col("file"), ["src1", "src2"]) & (F.col("lang") != "en")).select("file", "name", F.lit("new").alias("hash"))
    return C.synchronize(old, current, ["src1", "src2"], ["file", "name"])


@_query(f"""SELECT content_hash FROM {_HASHED} WHERE source IN ('src1', 'src2')
  EXCEPT SELECT content_hash FROM {_HASHED} WHERE source NOT IN ('src1', 'src2')""")
def scoped_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scoped_only(_hashed(spark, sf_dir), ["src1", "src2"], "source", "content_hash")


@_query(f"""SELECT content_hash, max_by(lang, struct_pack(a := source, b := doc_id)) AS hash FROM {_HASHED} GROUP BY content_hash""")
def valid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hashed(spark, sf_dir).select(F.col("source").alias("file"), F.col("doc_id").alias("start_line"), F.lit("").alias("name"), F.col("content_hash").alias("text_hash"), F.col("lang").alias("hash"))
    return C.valid_hashes(d).withColumnRenamed("text_hash", "content_hash")


@_query("""SELECT a.vec_id, round(list_sum(list_transform(list_concat(a.embedding, b.embedding)::DOUBLE[], lambda x: abs(x)))
    / sqrt(list_sum(list_transform(list_concat(a.embedding, b.embedding)::DOUBLE[], lambda x: x * x))), 6) AS abs_sum
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def combined_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    fs = e.select(F.col("vec_id").cast("string").alias("text_hash"), (F.col("vec_id") + 1).cast("string").alias("hash"))
    both = e.select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("cache_key"), F.col("vec_id").cast("string").alias("content_hash"), F.col("embedding").alias("vec"))
    out = C.rebuild_combined(fs, both, [("one", "text_hash"), ("two", "hash")])
    return out.select(F.col("content_hash").cast("bigint").alias("vec_id"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("abs_sum"))


# --- metrics and gates

_LINES = "CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS INTEGER)"


@_query(f"SELECT doc_id, {_LINES} AS lines FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"))


@_query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS INTEGER) AS loc FROM documents")
def loc_executable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.executable_lines(F.col("text")).alias("loc"))


_COMMENTS = "CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '#'))) AS INTEGER)"
_DENSITY = f"SELECT doc_id, {_COMMENTS} AS comments, {_LINES} - {_COMMENTS} AS code FROM documents"


def _density_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    d = _read(spark, sf_dir, "documents").select("doc_id", T.hash_lines(text).alias("comments"), T.line_count(text).alias("lines"))
    return d.select("doc_id", "comments", (F.col("lines") - F.col("comments")).alias("code"))


@_query(f"SELECT doc_id, comments, code, round(CASE WHEN code <= 0 THEN 0 ELSE 100.0 * comments / code END, 6) AS density FROM ({_DENSITY})")
def comment_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density_files(spark, sf_dir).withColumn("density", F.round(T.density(F.col("comments"), F.col("code")), 6))


@_query(f"SELECT sum(code)::BIGINT AS sloc, sum(comments)::BIGINT AS comments, round(100.0 * sum(comments) / (sum(code) + sum(comments)), 6) AS density FROM ({_DENSITY})")
def density_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.aggregate_density(_density_files(spark, sf_dir).withColumnRenamed("code", "sloc"))


@_query(f"""SELECT doc_id::VARCHAR AS file, round(density, 2) AS density, 5.0::DOUBLE AS bound, 'above' AS side
  FROM (SELECT doc_id, CASE WHEN code <= 0 THEN 0 ELSE 100.0 * comments / code END AS density, code FROM ({_DENSITY})) WHERE code >= 2 AND round(density, 2) > 5.0""")
def density_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _density_files(spark, sf_dir)
    files = d.select(F.col("doc_id").cast("string").alias("file"), T.density(F.col("comments"), F.col("code")).alias("density"), (F.col("code") < 2).alias("exempt"))
    return G.density_violations(files, spark.createDataFrame([], "file string, min double, max double"), 0.0, 5.0)


@_query("""SELECT source, count(*) AS items, count(*) - count(l.doc_id) AS missing, CAST(30 AS BIGINT) AS allowed, count(*) - count(l.doc_id) <= 30 AS ok
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def docstring_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("doc"))
    items = _read(spark, sf_dir, "documents").join(l, "doc_id", "left")
    return G.missing_docstrings(items, "source", F.coalesce("doc", F.lit(False)), most=30)


@_query(f"""SELECT doc_id, lines AS value, CAST(coalesce(nullif(quality * 5, 0), 8) AS DOUBLE) AS allowed FROM (SELECT doc_id, {_LINES} AS lines FROM documents)
  LEFT JOIN labels USING (doc_id) WHERE lines > coalesce(nullif(quality * 5, 0), 8)""")
def metric_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = line_counts(spark, sf_dir).withColumnRenamed("lines", "value")
    baseline = _read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 5).cast("double").alias("value"))
    return G.regressions(metrics, baseline, ["doc_id"], 8.0, zero_is_none=True)


@_query("""SELECT user_id, c.n, coalesce(b.n, 0) AS allowed, CASE WHEN coalesce(b.n, 0) > 0 THEN 'regression' ELSE 'new' END AS class
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) c LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY 1) b USING (user_id)
  WHERE c.n > coalesce(b.n, 0)""")
def classify_new_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "value")
    # one scan and one shuffle give the counts and their baseline
    both = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("b"))
    return G.classify(both.select("user_id", "n"), both.where("b > 0").select("user_id", F.col("b").alias("n")), ["user_id"])


@_query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, code LIMIT 5")
def top_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_codes(_read(spark, sf_dir, "events").select(F.col("event_type").alias("code")))


_SEVERITY = "CASE WHEN event_type = 'purchase' THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'information' END"


@_query(f"""SELECT tool, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings,
    count(*) FILTER (s = 'information') AS informations, count(*) AS total
  FROM (SELECT CASE WHEN value > 50 THEN 'types' ELSE 'lint' END AS tool, {_SEVERITY} AS s FROM events) GROUP BY ROLLUP (tool)""")
def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "purchase", "0").when(F.col("event_type") == "click", "1").otherwise("2")
    d = _read(spark, sf_dir, "events").select(F.when(F.col("value") > 50, "types").otherwise("lint").alias("tool"), T.severity(code).alias("severity"))
    return G.report(d)


@_query("""SELECT source, lang, CASE WHEN b.v IS NULL THEN c.v WHEN c.v < b.v THEN c.v ELSE b.v END AS value
  FROM (SELECT source, lang, CAST(max(n_chars) AS DOUBLE) / 2 AS v FROM documents WHERE lang <> 'fr' GROUP BY 1, 2) b
  FULL JOIN (SELECT source, lang, avg(n_chars) AS v FROM documents WHERE lang <> 'es' GROUP BY 1, 2) c USING (source, lang)""")
def ratchet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    b = d.where("lang <> 'fr'").groupBy("source", "lang").agg((F.max("n_chars").cast("double") / 2).alias("value"))
    c = d.where("lang <> 'es'").groupBy("source", "lang").agg(F.avg("n_chars").alias("value"))
    return B.ratchet(b, c, ["source", "lang"])


@_query(f"""SELECT doc_id, CASE WHEN lines > 12 THEN CAST(lines AS DOUBLE) ELSE CAST(quality AS DOUBLE) END AS value FROM labels
  FULL JOIN (SELECT doc_id, {_LINES} AS lines FROM documents) USING (doc_id) WHERE quality IS NOT NULL OR lines > 12""")
def baseline_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("value"))
    current = line_counts(spark, sf_dir).select("doc_id", F.col("lines").cast("double").alias("value"))
    return B.update(baseline, current, ["doc_id"], 12.0)


@_query(r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z_]+)\.', 1)) AS name FROM documents) GROUP BY 1")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(r"([A-Za-z_]+)\."), F.lit(1))
    return _read(spark, sf_dir, "documents").select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@_query(r"""SELECT name || ':' || page_id AS identifier, name, 1 AS line, n AS call_count FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_]+)\(', 1)) AS name FROM pages)
  JOIN (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '([A-Za-z_]+)\(', 1)) AS name FROM pages) GROUP BY 1) USING (name) WHERE n <= 100000""")
def wrapper_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_]+)\("), F.lit(1))).alias("name"))
    candidates = rows.select(F.concat_ws(":", "name", F.col("page_id").cast("string")).alias("identifier"), "name", F.lit(1).alias("line"))
    return G.few_calls(candidates, rows.groupBy("name").agg(F.count("*").alias("n")), 100_000)


# --- texts, names and batches


@_query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN '' ELSE role END, ''), text) AS query FROM conversations")
def jina_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.query_text(F.when(F.col("role") == "user", "").otherwise(F.col("role")), F.col("text")).alias("query"))


@_query("SELECT cache, cli FROM (VALUES " + ", ".join(f"('{p.cache}', '{p.name.removesuffix('_query').removesuffix('_passage').replace('_', '-')}')" for p in schema.PROVIDERS) + ") v(cache, cli)")
def cli_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.providers(spark).select("cache", T.cli_name(F.col("cache")).alias("cli"))


@_query(f"SELECT doc_id, 'openai|model-3|1|' || content_hash AS key FROM {_HASHED}")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("doc_id", T.cache_key(F.lit("openai"), F.lit("model-3"), F.lit("1"), F.col("content_hash")).alias("key"))


@_query("SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS BIGINT) AS batch FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _read(spark, sf_dir, "documents").select("source", "doc_id", F.floor((nth - 1) / 100).cast("bigint").alias("batch"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query(f"""SELECT i, j, printf('label_%d:%d f() - label_%d:%d f() - similarity: %.1f%%', la, i, lb, j, score * 100) AS message FROM ({_PAIRS}) WHERE raw >= {PAIR}""")
def pair_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("label_"), F.col("label")).alias("file"))
    found = sim_pairs(spark, sf_dir).join(e.select(F.col("vec_id").alias("i"), F.col("file").alias("fi")), "i").join(e.select(F.col("vec_id").alias("j"), F.col("file").alias("fj")), "j")
    return found.select("i", "j", T.pair_message(F.col("fi"), F.col("i"), F.lit("f"), F.col("fj"), F.col("j"), F.lit("f"), F.col("score")).alias("message"))


# --- further operators


@_query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS vec FROM documents d
  WHERE lang = 'en' OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def cache_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_hash"), "lang")
    rebuilt = d.where("lang = 'en'").select("content_hash", F.lit("new").alias("vec"))
    old = d.select("content_hash", F.lit("old").alias("vec"))
    replaced = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_hash"))
    return C.retain_out_of_scope(rebuilt, old, replaced).withColumnRenamed("content_hash", "doc_id")


@_query("""WITH v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS q, b.embedding::DOUBLE[] AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  n AS (SELECT *, sqrt(list_sum(list_transform(list_concat(q, p), lambda x: x * x))) AS n FROM v)
  SELECT vec_id, round(q[1] / n, 6) + 0.0 AS query_first, round(p[1] / n, 6) + 0.0 AS passage_first, CAST(len(q) + len(p) AS INTEGER) AS size FROM n""")
def query_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("passage")), "vec_id")
    one, two = V.query_passage_members(V.doubles(F.col("embedding")), V.doubles(F.col("passage")))
    return both.select("vec_id", (F.round(F.get(one, F.lit(0)), 6) + 0.0).alias("query_first"), (F.round(F.get(two, F.lit(0)), 6) + 0.0).alias("passage_first"), F.size(one).alias("size"))


@_query("SELECT doc_id, CAST(n_chars AS DOUBLE) AS value, coalesce(CAST(quality * 2000 AS DOUBLE), 300) AS allowed FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < coalesce(quality * 2000, 300)")
def metric_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of which less is worse, as maintainability is."""
    metrics = _read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("value"))
    baseline = _read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2000).cast("double").alias("value"))
    return G.regressions(metrics, baseline, ["doc_id"], 300.0, below=True)


_BOTH = f"""SELECT doc_id, {_LINES} AS lines, n_chars FROM documents"""


@_query(f"""SELECT doc_id, lines, n_chars, lines > 12 AS many_lines, n_chars > 2000 AS many_chars FROM ({_BOTH}) WHERE lines > 12 OR n_chars > 2000""")
def two_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two limits in one scan, as for cyclomatic and cognitive complexity."""
    d = _read(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"), "n_chars")
    return G.beyond(d, {"lines": (12, "many_lines"), "n_chars": (2000, "many_chars")})


@_query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3")
def top_codes_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_codes(_read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "event_id"), limit=3, order=["event_id"])


@_query(f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 END AS lo, CASE WHEN doc_id % 3 = 0 THEN 50.0 END AS hi FROM documents),
  d AS (SELECT doc_id, round(CASE WHEN code <= 0 THEN 0 ELSE 100.0 * comments / code END, 2) AS density, code, coalesce(lo, 1.0) AS lo, coalesce(hi, 5.0) AS hi FROM ({_DENSITY}) JOIN r USING (doc_id))
  SELECT doc_id::VARCHAR AS file, density, CAST(CASE WHEN density < lo THEN lo ELSE hi END AS DOUBLE) AS bound, CASE WHEN density < lo THEN 'below' ELSE 'above' END AS side FROM d WHERE code >= 2 AND (density < lo OR density > hi)""")
def density_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _density_files(spark, sf_dir)
    files = d.select(F.col("doc_id").cast("string").alias("file"), T.density(F.col("comments"), F.col("code")).alias("density"), (F.col("code") < 2).alias("exempt"))
    ranges = d.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("file"), F.lit(0.0).alias("min"), F.lit(50.0).alias("max"))
    return G.density_violations(files, ranges, 1.0, 5.0)


@_query("SELECT doc_id, source || '/' || lang || '.py' AS file FROM documents WHERE source <> 'src1'")
def density_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return G.density_scope(d.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".py")).alias("file")), "src1")


@_query("""SELECT count(*) - count(l.doc_id) AS missing, (SELECT list_aggregate(list(s ORDER BY doc_id), 'string_agg', ',') FROM (
    SELECT doc_id, format('{}:{} f{}()', source, doc_id, doc_id) AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10)) AS first
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.plans import similarity_gate

    fs = _functions(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("source").alias("file"), F.col("doc_id").alias("start_line"), F.concat(F.lit("f"), F.col("doc_id")).alias("name"), "content_hash")
    cache = _labelled(spark, sf_dir).select("content_hash", F.col("quality").alias("vec"))
    return similarity_gate.advice(fs, cache, "content_hash").select("missing", F.array_join("first", ",").alias("first"))


@_query("SELECT doc_id, source AS file, CAST(n_chars AS INTEGER) AS loc FROM documents WHERE n_chars >= 500 AND NOT contains(source, 'src1') AND NOT contains(source, 'src2')")
def selected_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.plans import similarity_gate

    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.col("n_chars").cast("int").alias("loc"))
    return similarity_gate.select_functions(d, 500, ["src1", "src2"])


@_query("SELECT round(sum(v), 4) AS variance FROM (SELECT var_samp(x) AS v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY pos)")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together hold the variance of the vectors themselves."""
    e = _read(spark, sf_dir, "embeddings")
    parts = R.transform_pca(e, R.fit_pca(e, variance=1.0)).select(F.posexplode("reduced").alias("pos", "x"))
    return parts.groupBy("pos").agg(F.var_samp("x").alias("v")).agg(F.round(F.sum("v"), 4).alias("variance"))


@_query("SELECT label, count(*) AS n, CAST(2 AS BIGINT) AS clusters FROM embeddings GROUP BY label")
def kmeans_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a group of enough rows is in one of two clusters."""
    return kmeans_split(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


# --- beyond SQL


@_query()
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    rows = []
    for variance in (0.95, 0.99):
        fitted = R.fit_pca(e, variance=variance)
        rows.append((variance, fitted[2] if fitted else None))
    return spark.createDataFrame(rows, "variance double, components int")


@_query()
def pca_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return _shown(S.pairs(S.cosine_rows(R.transform_pca(e, R.fit_pca(e)), vec_col="reduced"), PAIR))


@_query()
def kmeans_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clusters(_read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


#: sources for the scans, as the lake has none
SOURCES = [
    ("pkg/shapes.py", 'import math\n\n\nclass Circle:\n    """A circle."""\n\n    def __init__(self, r):\n        self.r = r\n\n    def area(self):\n        """Its area."""\n        return math.pi * self.r**2  # pi r squared\n\n    def size(self):\n        return self.area()\n\n\ndef area_of(shape):\n    return area(shape)\n\n\ndef area(shape):\n    if shape is None and not shape or False:\n        return 0\n    for part in shape:\n        if part:\n            return part\n    return shape.area()\n'),
    ("pkg/calls.py", 'from pkg.shapes import area_of\n\n\nasync def fetch(*args, key, **more):\n    """Fetches."""\n    return await get(*args, key=key, **more)\n\n\n@property\ndef exempt(self):\n    return self.fetch()\n\n\ndef swapped(a, b):\n    return put(b, a)\n\n\nprint(area_of([1]), area_of([2]), fetch())\n'),
    ("pkg/broken.py", "def broken(:\n    pass\n"),
]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, t.StructType([t.StructField("path", t.StringType()), t.StructField("content", t.StringType())]))


@_query()
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.functions(_sources(spark)).select("ord", "file", "name", "kind", "start_line", "end_line", "loc", "hash", "text_hash", "docstring")


# what the three sources have, counted by hand
@_query("""SELECT * FROM (VALUES ('pkg/shapes.py', '__init__', 7, 1, 0), ('pkg/shapes.py', 'area', 10, 1, 0), ('pkg/shapes.py', 'size', 14, 1, 0),
  ('pkg/shapes.py', 'area_of', 18, 1, 0), ('pkg/shapes.py', 'area', 22, 6, 6), ('pkg/calls.py', 'fetch', 4, 1, 0), ('pkg/calls.py', 'exempt', 10, 1, 0),
  ('pkg/calls.py', 'swapped', 14, 1, 0)) v(file, name, line, cc, cog)""")
def python_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.complexity(_sources(spark))


@_query()
def python_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.file_metrics(_sources(spark))


@_query("""SELECT * FROM (VALUES ('pkg/shapes.py', 'Circle', 4, true, 'class'), ('pkg/shapes.py', '__init__', 7, false, 'function'), ('pkg/shapes.py', 'area', 10, true, 'function'),
  ('pkg/shapes.py', 'size', 14, false, 'function'), ('pkg/shapes.py', 'area_of', 18, false, 'function'), ('pkg/shapes.py', 'area', 22, false, 'function'),
  ('pkg/calls.py', 'fetch', 4, true, 'function'), ('pkg/calls.py', 'exempt', 10, false, 'function'), ('pkg/calls.py', 'swapped', 14, false, 'function')) v(file, name, line, has_doc, kind)""")
def python_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.docstring_items(_sources(spark))


@_query("SELECT * FROM (VALUES ('pkg/shapes.py:Circle.size', 'size', 14, CAST(0 AS BIGINT))) v(identifier, name, line, call_count)")
def python_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark)
    return G.few_calls(P.wrappers(s), P.call_counts(s)).orderBy("identifier")


@_query()
def populate_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.sources.providers import HashingProvider, populate

    empty = spark.createDataFrame([], schema.CACHE)
    return populate(_hashed(spark, sf_dir).select("content_hash", "text"), empty, HashingProvider(), "hashing", "content_hash", "text")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
