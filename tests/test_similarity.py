from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions import vector as V
from gritstone.operators import similarity as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(("a", "b", "want"), [((1, 2), (2, 4), 1.0), ((1, 0), (0, 1), 0.0), ((0, 0), (1, 1), 0.0), ((1, 1), (-1, -1), -1.0)])
def test_cosine(spark, a, b, want):
    assert one(spark, V.cosine(vec(*a), vec(*b))) == pytest.approx(want)


def test_normalised_members_and_combined(spark):
    q, p = one(spark, F.array(*V.query_passage_members(vec(1, 0), vec(0, 1))))
    assert q == pytest.approx([0.5**0.5, 0, 0, 0.5**0.5]) and p == pytest.approx([0, 0.5**0.5, 0.5**0.5, 0])
    zeros = [vec(0)] * 10
    got = one(spark, V.combined([*zeros, vec(3), vec(4), vec(6), vec(8)]))
    assert got[10:] == pytest.approx([x / 125**0.5 for x in (3, 4, 6, 8)]) and len(got) == 14
    assert one(spark, V.combined([vec(1), F.lit(None).cast("array<double>")])) is None
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0, 0]


def test_indices(spark):
    assert one(spark, V.similarity_index(F.lit(1.0))) == 25.403
    assert one(spark, V.similarity_index(F.lit(0.5))) == pytest.approx(25.403 / 32)
    assert one(spark, V.refactor_index(F.lit(10), F.lit(5), F.lit(20.0))) == pytest.approx(15.25)


@pytest.mark.parametrize(("v", "want"), [([1.0, 2.0], True), ([], False), ([float("nan")], False), ([float("inf")], False), ([None], False), (None, False)])
def test_is_vector(spark, v, want):
    assert spark.createDataFrame([(v,)], "v array<double>").select(V.is_vector(F.col("v")).alias("x")).first().x is want


def table(spark, x, schema="vec_id long, embedding array<double>"):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v]) for i, v in enumerate(x)], schema)


@pytest.mark.parametrize("block", [8 << 20, 16 * 64 * 9, 16 * 64])
def test_pairs_against_numpy(spark, block, monkeypatch):
    monkeypatch.setattr(S, "TILE", 7)
    x = np.random.default_rng(0).normal(size=(40, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): (u @ u.T)[i, j] for i in range(40) for j in range(i + 1, 40)}
    rows = S.cosine_rows(table(spark, x))
    got = {(r.i, r.j): r.score for r in S.pairs(rows, block_bytes=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    few = {(r.i, r.j) for r in S.pairs(rows, 0.2, block_bytes=block).collect()}
    assert few == {k for k, v in want.items() if round(v, 6) >= 0.2}
    best = {r.ord: r.max_sim for r in S.max_similarity(rows, block_bytes=block).collect()}
    m = u @ u.T
    np.fill_diagonal(m, 0)
    assert np.allclose([best[i] for i in range(40)], m.max(axis=1), atol=1e-6)


def test_odd_vectors(spark):
    rows = S.cosine_rows(table(spark, [[1, 0], None, [0, 0], [-1, 0], [2, 0]]))
    got = {(r.i, r.j): r.score for r in S.pairs(rows).collect()}
    assert got == {(0, 2): 0, (0, 3): -1, (0, 4): 1, (2, 3): 0, (2, 4): 0, (3, 4): -1}
    assert {r.ord: r.max_sim for r in S.max_similarity(rows).collect()} == {0: 1, 2: 0, 3: 0, 4: 1}
    none = S.cosine_rows(table(spark, []))
    assert S.pairs(none).count() == 0 and S.max_similarity(none).count() == 0


def test_symmetrized(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0]), (1, [1.0, 0.0], [0.0, 1.0]), (2, None, None)], "i long, q array<double>, p array<double>")
    got = {(r.i, r.j): r.score for r in S.pairs(S.symmetrized_rows(df, "i", "q", "p", 2)).collect()}
    assert got == pytest.approx({(0, 1): 0.5, (0, 2): 0.0, (1, 2): 0.0})


def test_three_copies_have_one_neighbour_row(spark):
    scored = S.pairs(S.cosine_rows(table(spark, [[1, 0]] * 3)))
    got = S.neighbours(scored, 0.9).collect()
    assert [(r.i, r.n, r["first"]) for r in got] == [(0, 2, [1, 2])]


def excluded(spark, functions, lines, proximity, **pairs):
    fs = spark.createDataFrame(functions, "ord long, file string, name string, text string, start_line int, end_line int")
    rows = S.cosine_rows(fs.select("ord", F.array(F.lit(1.0)).alias("v")), "ord", "v")
    flags = fs.select("ord", S.exclusion(F.col("file"), F.concat_ws(":", "file", "name"), **pairs).alias("x"))
    code = spark.createDataFrame(lines, "file string, line int, is_code boolean")
    out = S.pairs(rows.join(flags, "ord").join(S.structure(fs, code), "ord"), 0.5, proximity)
    return {(r.i, r.j) for r in out.collect()}


def test_class_and_function_of_one_file(spark):
    # a class, a blank and a comment line, a function, a code line, a function
    lines = [("a", n, n not in (3, 4)) for n in range(1, 10)] + [("b", n, True) for n in range(1, 10)]
    fs = [(0, "a", "C", "class C:", 1, 2), (1, "a", "f", "def f", 5, 6), (2, "a", "g", "def g", 8, 9), (3, "b", "h", "def h", 1, 2), (4, "b", "D", "class D:", 1, 9)]
    all_ = {(i, j) for i in range(5) for j in range(i + 1, 5)}
    assert excluded(spark, fs, lines, 0) == all_ - {(0, 1), (3, 4)}
    assert excluded(spark, fs, lines, 3) == all_ - {(0, 1), (0, 2), (3, 4)}
    assert excluded(spark, fs, lines, -1) == all_
    assert excluded(spark, fs, lines, None) == all_


def test_configured_pairs_are_substrings_in_either_order(spark):
    fs = [(0, "pkg/a.py", "f", "", 1, 2), (1, "pkg/b.py", "g", "", 1, 2), (2, "lib/b.py", "f", "", 1, 2)]
    lines = [("none", 1, True)]
    assert excluded(spark, fs, lines, None, file_pairs=[["b.py", "pkg/a"], ["alone"]]) == {(1, 2)}
    assert excluded(spark, fs, lines, None, function_pairs=[["a.py:f", "lib/b.py:f"]]) == {(0, 1), (1, 2)}


def test_priorities(spark):
    best = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0), (3, 0.5)], "ord long, max_sim double")
    metrics = spark.createDataFrame([(0, 4, 4), (2, 4, 4), (3, 100, 0)], "ord long, cc int, cog int")
    got = S.refactor_priorities(best, metrics, 12.0, 2).collect()
    assert [r.ord for r in got] == [3, 0]
    assert [r.ord for r in S.refactor_priorities(best, metrics, 0.0, None).orderBy("ord").collect()] == [0, 1, 2, 3]


def test_thresholds_hold_for_the_score_itself(spark):
    a = 0.8599996
    rows = S.cosine_rows(table(spark, [[1.0, 0.0], [a, float(np.sqrt(1 - a * a))]]))
    assert S.pairs(rows, 0.86).count() == 0 and S.pairs(rows, 0.8599).count() == 1


def test_one_pass_gives_pairs_and_maxima(spark):
    x = np.random.default_rng(2).normal(size=(40, 8)).tolist()
    rows = S.cosine_rows(table(spark, x))
    both = S.pairs_and_maxima(rows, 0.3, block_bytes=8 * 64)
    assert sorted(map(tuple, both.where("j is not null").collect())) == sorted(map(tuple, S.pairs(rows, 0.3, block_bytes=8 * 64).collect()))
    assert sorted(map(tuple, S.maxima_of(both).collect())) == sorted(map(tuple, S.max_similarity(rows).collect()))


def test_a_task_hands_on_all_its_pairs_in_small_batches():
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(4).normal(size=(3000, 4))
    block = pa.table({"ord": np.arange(3000), "v": x.tolist()})
    tracemalloc.start()
    sizes = [len(batch) for batch in S._found(block, None, None, None, maxima=False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 4.5 million pairs are 108 MB; one by one they take less
    assert sum(sizes) == 3000 * 2999 // 2 and max(sizes) <= S.OUT_ROWS and peak < 30e6


def test_shown_scores_are_rounded_as_in_sql(spark):
    import duckdb

    x = [0.0000005, -0.0000005, 0.4000005, -1e-9, 1.0, -0.1234565, 0.49999999999999994e-6]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in x]
    assert list(map(repr, S._rounded(np.array(x), 6).tolist())) == list(map(repr, want))
    rows = S.cosine_rows(table(spark, np.random.default_rng(5).normal(size=(50, 3))))
    whole = {(r.i, r.j): r.score for r in S.pairs(rows, block_bytes=8 * 64).collect()}
    shown = {(r.i, r.j): r.score for r in S.pairs(rows, block_bytes=8 * 64, digits=6).collect()}
    assert shown.keys() == whole.keys() and all(shown[k] == round(v, 6) for k, v in whole.items())


def test_symmetrized_rows_are_sent_as_stored_and_once(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), x[i - 1].tolist() if i % 7 else None) for i, v in enumerate(x)], "i long, q array<float>, p array<float>")
    rows = S.symmetrized_rows(df, "i", "q", "p", 4)
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "array<float>", "array<float>"]
    # before, every block was sent all rows, as doubles and in both orders: 8 blocks of 60 rows, 128 bytes each
    seen = S._blocks(rows, 32 * 4 * 8).selectExpr("count(*) AS n", "sum(length(data)) AS size").first()
    assert seen.n == 8 and seen.size < 60 * 40 + 8 * 1000
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    p = np.array([u[i - 1] if i % 7 else np.zeros(4) for i in range(60)])
    want = (u @ p.T + p @ u.T) / 2
    got = {(r.i, r.j): r.score for r in S.pairs(rows, block_bytes=32 * 4 * 8).collect()}
    assert len(got) == 60 * 59 // 2 and all(abs(want[k] - s) < 1e-12 for k, s in got.items())


def test_exclusions_are_asked_for_pairs_found_alone(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    n, m = 300, 70  # more patterns than a word has bits; rows without flags are in no excluded pair
    one, two = rng.random((n, m)) < 0.05, rng.random((n, m)) < 0.05
    flags = [None if k % 50 == 3 else {"one": one[k].astype(int).tolist(), "two": two[k].astype(int).tolist()} for k in range(n)]
    one[3::50] = two[3::50] = False
    x = rng.normal(size=(n, 5))
    block = pa.table({"ord": np.arange(n), "v": x.tolist(), "x": pa.array([f or {"one": [None] * m, "two": [None] * m} for f in flags])})
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = (one.astype(int) @ two.T.astype(int) + two.astype(int) @ one.T.astype(int)) > 0
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if (u @ u.T)[i, j] >= 0.9 and not out[i, j]}
    asked, real = [], S._excluded
    monkeypatch.setattr(S, "_excluded", lambda a, b, p, q, near: (asked.append(np.broadcast(p, q).size), real(a, b, p, q, near))[1])
    for maxima in (False, True):
        got = [r for batch in S._found(block, None, 0.9, None, maxima) for r in batch.to_pylist()]
        assert {(r["i"], r["j"]) for r in got if r["j"] is not None} == want
        if not maxima:
            # before, of every tile whole
            assert sum(asked) < n * n // 10


@pytest.mark.parametrize(("kind", "maxima"), [("float32", False), ("float32", True), ("float64", False)])
def test_a_task_takes_two_blocks_and_a_tile(kind, maxima):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(11)
    n = S.BLOCK_BYTES // 8 // 64
    a, b = (pa.table({"ord": np.arange(n) * 2 + k, "v": pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 64).astype(kind)), 64).cast(pa.list_(pa.from_numpy_dtype(kind)))}) for k in (0, 1))
    tracemalloc.start()
    found = sum(len(x) for x in S._found(a, b, 0.4, None, maxima))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 2 * n * maxima and peak < 60e6, peak
