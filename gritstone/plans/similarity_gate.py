"""The similarity gate as one plan: functions, their cached vectors, pairs, neighbours and what to refactor first."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone import schema
from gritstone.functions import text as T
from gritstone.operators import cache as C
from gritstone.operators import reduce as R
from gritstone.operators import similarity as S


def select_functions(functions: DataFrame, min_loc: int = 1, excluded_dirs: list[str] | None = None) -> DataFrame:
    """Functions of at least ``min_loc`` lines in files whose path holds none of ``excluded_dirs``."""
    out = functions.where(F.col("loc") >= min_loc)
    for d in excluded_dirs or []:
        out = out.where(~F.contains("file", F.lit(d)))
    return out


def advice(functions: DataFrame, cache: DataFrame, hash_col: str, shown: int = 10) -> DataFrame:
    """One row: how many functions lack a vector, and the names of the first ``shown``."""
    missing = C.uncached(functions, [cache], hash_col)
    name = F.format_string("%s:%d %s()", "file", "start_line", "name")
    # two small aggregates: the names come from a bounded top-k, never from one list of all
    first = missing.select("ord", name.alias("s")).orderBy("ord").limit(shown).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]).alias("first"))
    return missing.agg(F.count("*").alias("missing")).crossJoin(F.broadcast(first))


def vectors_of(functions: DataFrame, cache: DataFrame, provider: str, pca_variance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, known)`` of a provider: what the kernel compares, and the functions (ord) that have a vector.

    ``cache`` has cache keys, or is this provider's own without them. A symmetrized provider reads the caches of its queries and passages; a
    function without one of these scores 0 in that direction.
    """
    p = next(x for x in schema.PROVIDERS if x.name == provider)
    of = lambda key: cache.where(F.col("cache_key") == key).select("content_hash", "vec") if "cache_key" in cache.columns else cache.select("content_hash", "vec")
    if p.kind == "symmetrized":
        q, r = (C.lookup(functions, of(f"{provider}_{side}"), p.hash_column).select("ord", F.col("vec").alias(side)) for side in ("query", "passage"))
        both = q.join(r, "ord")
        dim = both.agg(F.max(F.greatest(F.size("query"), F.size("passage")))).first()[0]
        return S.symmetrized_rows(both, "ord", "query", "passage", max(dim or 1, 1)), both.where("query is not null or passage is not null").select("ord")
    own = of(provider)
    if pca_variance is not None:
        # fitted on the whole cache, orphans too
        own = R.transform_pca(own, R.fit_pca(own, "vec", pca_variance), "vec").select("content_hash", F.col("reduced").alias("vec"))
    found = C.lookup(functions, own, p.hash_column).select("ord", "vec")
    return S.cosine_rows(found, "ord", "vec"), found.where("vec is not null").select("ord")


def run(functions: DataFrame, cache: DataFrame, provider: str, config: dict | None = None, metrics: DataFrame | None = None, lines: DataFrame | None = None, pca_variance: float | None = None) -> dict[str, DataFrame]:
    """``{"pairs", "neighbours", "refactor"}`` of one provider, all from one pass over the pairs, kept on the executors' disks.

    ``functions`` as from ``pysource.functions``; ``cache`` is (content_hash, vec) of this provider, or of all with their cache_key; ``metrics`` is (file, name,
    cc, cog); with ``lines`` (from ``pysource.code_lines``) classes and functions of one file that lie within ``min_loc`` code
    lines are left out, as are the configured pairs. With ``pca_variance`` the scores are those of the reduced vectors. A function without
    a vector has no pairs, but complexity alone can bring it among those to refactor.
    """
    config = config or {}
    min_loc = int(config.get("min_loc", 1))
    fs = select_functions(functions, min_loc, config.get("excluded_dirs"))
    rows, _ = vectors_of(fs, cache, provider, pca_variance)
    flags = fs.select("ord", S.exclusion(F.col("file"), F.concat_ws(":", "file", "name"), config.get("excluded_file_pairs", ()), config.get("excluded_function_pairs", ())).alias("x"))
    rows = rows.join(flags, "ord")
    if lines is not None:
        rows = rows.join(S.structure(fs, lines), "ord")
    pair, near = schema.threshold(config, provider, "pair"), schema.threshold(config, provider, "neighbour")
    both = S.pairs_and_maxima(rows, min(pair, near), min_loc if lines is not None else None).persist(StorageLevel.DISK_ONLY)
    scored = both.where("j is not null")
    place = lambda side: fs.select(F.col("ord").alias(side), F.col("file").alias(f"file_{side}"), F.col("name").alias(f"name_{side}"), F.col("start_line").alias(f"line_{side}"))
    named = scored.where(F.col("score") >= pair).join(place("i"), "i").join(place("j"), "j")
    message = T.pair_message(F.col("file_i"), F.col("line_i"), F.col("name_i"), F.col("file_j"), F.col("line_j"), F.col("name_j"), F.col("score"))
    # the few that are shown of each get names and scores
    groups = S.neighbours(scored, near)
    shown = groups.select("i", "n", F.posexplode("first").alias("k", "j")).join(scored, ["i", "j"]).join(place("j"), "j")
    item = F.struct("k", T.place(F.col("file_j"), F.col("line_j"), F.col("name_j")).alias("place"), "score")
    told = shown.groupBy("i", "n").agg(F.array_sort(F.collect_list(item)).alias("shown")).join(place("i"), "i")
    told = told.select("i", "n", F.transform("shown", lambda x: x["place"]).alias("places"), T.neighbours_message(F.col("file_i"), F.col("line_i"), F.col("name_i"), F.col("n"), F.col("shown")).alias("message"))
    out = {"pairs": named.withColumn("message", message), "neighbours": groups.join(told.drop("n"), "i")}
    if metrics is not None:
        best = fs.select("ord").join(S.maxima_of(both), "ord", "left").withColumn("max_sim", F.coalesce("max_sim", F.lit(0.0)))
        own = fs.select("ord", "file", "name").join(metrics, ["file", "name"]).select("ord", "cc", "cog")
        out["refactor"] = S.refactor_priorities(best, own, float(config.get("refactor_index_threshold", schema.DEFAULT_REFACTOR)), config.get("refactor_index_top_n", 10))
    return out


def run_all(functions: DataFrame, cache: DataFrame, providers: list[str] | None = None, config: dict | None = None, metrics: DataFrame | None = None, lines: DataFrame | None = None) -> tuple[dict[str, dict[str, DataFrame]], dict[str, DataFrame]]:
    """Plans of all providers that the cache has vectors of, and ``advice`` on those that it has none of, which are skipped.

    ``cache`` has cache keys. Without ``providers`` all that give scores are asked.
    """
    asked = [p for p in schema.PROVIDERS if (p.name in providers if providers is not None else p.kind != "member")]
    have = {r[0] for r in cache.where("vec is not null").select("cache_key").distinct().collect()}  # a handful of names
    plans, skipped = {}, {}
    for p in asked:
        needs = [f"{p.name}_query", f"{p.name}_passage"] if p.kind == "symmetrized" else [p.name]
        if set(needs) & have:
            plans[p.name] = run(functions, cache, p.name, config, metrics, lines)
        else:
            skipped[p.name] = advice(functions, cache.where(F.col("cache_key").isin(needs)).select("content_hash", "vec"), p.hash_column)
    return plans, skipped


def report(plans: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """``(provider, kind, i, j, score, message)``: pairs, neighbours and what to refactor, of all providers as one relation."""
    parts = []
    null = lambda kind: F.lit(None).cast(kind)
    for provider, plan in plans.items():
        named = lambda df, kind, j, score, message: df.select(F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), "i", j.alias("j"), score.alias("score"), message.alias("message"))  # noqa: E731, B023
        parts.append(named(plan["pairs"], "pair", F.col("j"), F.round("score", 6), F.col("message")))
        parts.append(named(plan["neighbours"], "neighbours", null("bigint"), null("double"), F.col("message")))
        if "refactor" in plan:
            r = plan["refactor"].withColumnRenamed("ord", "i")
            parts.append(named(r, "refactor", null("bigint"), F.col("refactor"), F.format_string("refactor index %.2f (complexity %d, %d; similarity %s)", F.col("refactor"), F.col("cc"), F.col("cog"), T.percent(F.col("max_sim")))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
