from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gritstone.llm import media as M

R = np.random.default_rng(11)
VECTORS = [R.normal(size=64).astype(np.float32) for _ in range(45)]
SCHEMA = "image_id long, image binary, c string, h string, a int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else bytearray(x), "c", "h", 1) for i, x in rows], SCHEMA)


def brute(images):
    """All pairs of images, all pairs of their corners."""
    i, x, y, s, turn, d = M.described(images)
    out = set()
    for a in range(len(images)):
        for b in range(a + 1, len(images)):
            p, q = np.flatnonzero(i == a), np.flatnonzero(i == b)
            m = [(x[u], y[u], s[u], turn[u], x[v], y[v], s[v], turn[v]) for u in p for v in q if sum(int(k).bit_count() for k in (d[u] ^ d[v]).view(np.uint64)) <= M.RADIUS]
            if len(m) >= M.MIN_INLIERS and M.consensus(np.array(m, float))[0] >= M.MIN_INLIERS:
                out.add((a, b))
    return out


def test_copies_against_brute_force(spark):
    images = [M.encode(M.picture(v)) for v in VECTORS] + [M.encode(M.picture(v, 1 + k % 5)) for k, v in enumerate(VECTORS[:25])]
    got = {(r.a, r.b): r for r in M.copies(table(spark, enumerate(images))).collect()}
    want = brute(images)
    planted = {(k, 45 + k) for k in range(25)}
    assert planted <= want
    assert len(want & got.keys()) >= 0.9 * len(want) and got.keys() <= want
    assert planted <= got.keys()
    turned = [got[k, 45 + k] for k in range(2, 25, 5)]
    assert all(r.rotation in (90.0, 270.0) and abs(r.scale - 1) < 0.01 for r in turned)


def test_scaled_copy(spark):
    big = M.resize(M.picture(VECTORS[0]).astype(float)[None], 144, 144)[0]
    got = M.copies(table(spark, [(1, M.encode(M.picture(VECTORS[0]))), (2, M.encode(np.rint(big))), (3, M.encode(M.picture(VECTORS[1])))])).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and abs(got[0].scale - 1.5) < 0.1


def test_identical_images_are_linear(spark):
    one, two = M.encode(M.picture(VECTORS[0])), M.encode(M.picture(VECTORS[0], 1))
    got = M.copies(table(spark, [(i, one) for i in range(50)] + [(90, two)])).collect()
    assert len(got) == 50
    assert {r.b for r in got if r.inliers is None} == set(range(1, 50)) and all(r.a == 0 for r in got)
    assert [(r.a, r.b) for r in got if r.inliers is not None] == [(0, 90)]


def test_odd_rows(spark):
    flat = M.encode(np.full((40, 40), 9, np.uint8))
    tiny = M.encode(np.full((2, 2), 9, np.uint8))
    one = M.encode(M.picture(VECTORS[0]))
    rows = [(1, None), (2, b""), (3, b"no image"), (4, flat), (5, flat), (6, tiny), (None, one), (7, one), (7, one), (8, b"P5\n9 9\n255\nshort"), (9, b"P5\n0 0\n255\n")]
    got = M.copies(table(spark, rows)).collect()
    assert [(r.a, r.b) for r in got] == [(4, 5)]
    assert M.copies(table(spark, [])).count() == 0


def test_pgm_with_comment():
    x = M.picture(VECTORS[2])
    raw = M.encode(x).replace(b"P5\n", b"P5\n# made by hand\n")
    assert (M.decode(raw) == x).all()


def test_a_picture_for_every_row(spark):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(VECTORS)] + [(100, None), (101, [])], "vec_id long, embedding array<float>")
    rows = {r.image_id: r.image for r in M.pictures(v).collect()}
    assert len(rows) == 47 and rows[100] is None and rows[101] is None
    assert len(rows[0]) > 5000
    assert M.pictures(v.where(F.lit(False))).count() == 0


def warped(grey, degrees, scale):
    """Turned about the centre and scaled, bilinear."""
    (h, w), a = grey.shape, np.deg2rad(degrees)
    y, x = np.mgrid[: int(h * scale), : int(w * scale)]
    u, v = (x - int(w * scale) / 2 + 0.5) / scale, (y - int(h * scale) / 2 + 0.5) / scale
    z = np.clip(np.cos(a) * u + np.sin(a) * v + w / 2 - 0.5, 0, w - 1.001)
    y = np.clip(-np.sin(a) * u + np.cos(a) * v + h / 2 - 0.5, 0, h - 1.001)
    i, j = y.astype(int), z.astype(int)
    y, z, g = y - i, z - j, grey.astype(float)
    return np.rint((g[i, j] * (1 - z) + g[i, j + 1] * z) * (1 - y) + (g[i + 1, j] * (1 - z) + g[i + 1, j + 1] * z) * y)


def all_pairs(images):
    """As ``brute``, by arrays."""
    i, x, y, s, turn, d = M.described(images)
    place, out = np.stack([x, y, s, turn], axis=1).astype(float), set()
    for a in range(len(images)):
        for b in range(a + 1, len(images)):
            p, q = np.flatnonzero(i == a), np.flatnonzero(i == b)
            u, v = np.nonzero(np.bitwise_count((d[p][:, None] ^ d[q][None]).view(np.uint64)).sum(axis=2) <= M.RADIUS)
            if len(u) >= M.MIN_INLIERS and M.consensus(np.concatenate([place[p[u]], place[q[v]]], axis=1))[0] >= M.MIN_INLIERS:
                out.add((a, b))
    return out


def test_recall_of_edits_off_the_grid(spark):
    r = np.random.default_rng(5)
    edits = [lambda g: warped(g, 7, 1), lambda g: warped(g, 37, 1), lambda g: warped(g, 100, 1), lambda g: warped(g, 0, 1.2), lambda g: np.clip(g + np.rint(r.normal(0, 20, g.shape)), 0, 255)]
    images = [M.encode(M.picture(v)) for v in VECTORS[:12]] + [M.encode(edit(M.picture(v))) for edit in edits for v in VECTORS[:12]]
    want = all_pairs(images)
    got = {(x.a, x.b) for x in M.copies(table(spark, enumerate(images))).collect()}
    assert got <= want and len(got) >= 0.7 * len(want)  # two edits of one image, each edited strongly, are harder
    of = [{(a, b) for a, b in want if a < 12 and b == a + 12 * k} for k in range(1, 6)]
    assert all(len(x) >= 5 and len(got & x) >= 0.75 * len(x) for x in of)
    assert sum(len(got & x) for x in of) >= 0.9 * sum(map(len, of))


def test_hubs_hold_a_large_group_together(spark, monkeypatch):
    """Copies whose keys are hot are still found, and nothing else is."""
    r = np.random.default_rng(9)
    images = [M.encode(M.picture(v)) for v in VECTORS[:6]] + [M.encode(np.clip(M.picture(VECTORS[0]) + np.rint(r.normal(0, 1.5, (96, 96))), 0, 255)) for _ in range(30)]
    monkeypatch.setattr(M, "HOT", 4)
    monkeypatch.setattr(M, "FULL", 5)
    monkeypatch.setattr(M, "CELL", 1)
    got = [(x.a, x.b) for x in M.copies(table(spark, enumerate(images))).collect()]
    assert len(got) == len(set(got))
    group, seen = {0}, 0
    while len(group) > seen:
        seen = len(group)
        group |= {x for ab in got if group & set(ab) for x in ab}
    assert group == {0, *range(6, 36)} and all(set(ab) <= group for ab in got)


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    """Copies whose keys are hot meet as all others do: in blocks, every pair that a plain join finds, and nothing else."""
    r = np.random.default_rng(9)
    images = [M.encode(M.picture(v)) for v in VECTORS[:6]] + [M.encode(np.clip(M.picture(VECTORS[0]) + np.rint(r.normal(0, 1.5, (96, 96))), 0, 255)) for _ in range(30)]
    want = sorted(M.copies(table(spark, enumerate(images))).collect())
    monkeypatch.setattr(M, "HOT", 4)
    monkeypatch.setattr(M, "FULL", 5)
    monkeypatch.setattr(M, "CELL", 1)
    got = M.copies(table(spark, enumerate(images))).collect()
    assert sorted(got) == want
    group = {0, *range(6, 36)}
    assert {(x.a, x.b) for x in got} == {(a, b) for a in group for b in group if a < b}


def test_work_is_done_once_and_in_bounded_parts(spark, monkeypatch, tmp_path):
    """Filters don't have images made, or pairs compared, again in another worker; joins get tasks by the number of features."""
    import re

    from pyspark.sql import functions as F

    log, images = str(tmp_path / "made"), [M.encode(M.picture(v)) for v in VECTORS[:3]] + [M.encode(M.picture(v, 1)) for v in VECTORS[:3]]

    @F.arrow_udf("binary")
    def made(k: pa.Array) -> pa.Array:
        with open(log, "a") as f:
            f.write("x" * len(k))
        return pa.array([images[i] for i in k.to_pylist()], pa.binary())

    plans = {}

    def spy(df, what, real=M.stored):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, what)

    monkeypatch.setattr(M, "stored", spy)
    monkeypatch.setattr(M, "ROWS", 100, raising=False)
    found = M.copies(spark.range(6).select(F.col("id").alias("image_id"), made(F.col("id")).alias("image")))
    assert {(r.a, r.b) for r in found.collect()} == {(0, 3), (1, 4), (2, 5)}
    with open(log) as f:
        assert len(f.read()) == 6
    python = [p.count("ArrowEvalPython [") for p in (plans["corners"], found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])]
    assert python == [1, 1]
    features = sum(len(M.features(i, np.stack(rest[:4], axis=1).astype(float), rest[4].view(np.uint64))[0]) for i, *rest in [M.described(images)]) * M.TABLES
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(key#\d+L?, (\d+)\)", plans["candidates"])]
    assert tasks and min(tasks) >= features / 100 > 4


def test_places_fit_in_a_number(spark):
    from pyspark.sql import functions as F

    a, b = np.array([[3.0, 8000.0, 1.5, 23.0]]), np.array([[8191.0, 4.0, 2.25, 1.0]])
    t = spark.range(1).select(M.meeting(F.lit(int(M.pack(a)[0])), F.lit(int(M.pack(b)[0])))).first()[0]
    assert [float(x[0]) for x in M.unpack(np.array([t]))] == [3.0, 8000.0, 8191.0, 4.0, 1.5, 2.0, 2.25]


def test_neighbours_against_all_distances():
    r = np.random.default_rng(3)
    x, y = r.uniform(0, 500, 700), r.uniform(0, 500, 700)
    one, two = M.neighbours(x, y, 30.0)
    got = {i: set(two[one == i].tolist()) for i in range(700)}
    off = np.hypot(x[:, None] - x, y[:, None] - y)
    np.fill_diagonal(off, np.inf)
    for i in range(700):
        assert got[i] == {int(k) for k in np.argsort(off[i])[: M.NEAR] if off[i, k] <= 30}
