from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from gritstone.llm import sharding as S
from tests.llm.conftest import SCHEMA, row, words


def slow_pack(items, shards, slack=S.SLACK):
    """The rule with plain loops."""
    dims = range(len(items[0])) if len(items) else range(0)
    total = [sum(float(v[d]) for v in items) for d in dims]
    left = [[1.0 for _ in dims] for _ in range(shards)]
    out = []
    for v in items:
        v = [x / (t * (1 + slack) / shards) if t else x for x, t in zip(v, total)]
        gains = []
        for k in range(shards):
            fits = all(r >= x - 1e-12 for r, x in zip(left[k], v))
            gains.append((fits, round(sum(r * x for r, x in zip(left[k], v)), 9), -k))
        k = -max(gains)[2]
        out.append(k)
        left[k] = [r - x for r, x in zip(left[k], v)]
    return out


def test_packing_is_the_rule():
    r = np.random.default_rng(1)
    for n, shards in ((1, 1), (40, 3), (200, 7), (5, 9)):
        items = np.round(r.lognormal(3, 1, (n, 3)))
        items = items[S.order(items)]
        assert S.pack(items, shards).tolist() == slow_pack(items.tolist(), shards)


def docs_of(spark, n=900, seed=2):
    r = random.Random(seed)
    sources = ["hot"] * 6 + [f"s{k}" for k in range(12)]
    return spark.createDataFrame([row(i, words(r, r.choice([3, 20, 60, 300])), source=r.choice(sources)) for i in range(n)], SCHEMA)


def test_shards_are_balanced_and_groups_whole(spark):
    docs = docs_of(spark)
    rows = S.shard(docs, shard_bytes=60_000).collect()
    assert len(rows) == 900 and len({r.doc_id for r in rows}) == 900
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_bytes == len(text[r.doc_id].encode()) and r.n_tokens == len(text[r.doc_id].split()) for r in rows)
    load = defaultdict(lambda: np.zeros(3))
    for r in rows:
        load[r.shard] += (r.n_bytes, r.n_tokens, 1)
    all_ = np.array(list(load.values()))
    shards = -(-int(all_[:, 0].sum()) // 60_000)
    assert sorted(load) == list(range(shards)) and shards > 5
    assert (all_.max(axis=0) <= 1.35 * all_.mean(axis=0)).all()
    assert (all_.min(axis=0) >= 0.65 * all_.mean(axis=0)).all()


def test_query_is_brute_force(spark):
    """The whole operator against plain loops, in several cells."""
    docs = docs_of(spark, 300, 5)
    got = {r.doc_id: r.shard for r in S.shard(docs, shard_bytes=8_000, cell=4).collect()}
    again = {r.doc_id: r.shard for r in S.shard(docs.repartition(7), shard_bytes=8_000, cell=4).collect()}
    assert got == again
    rows = [(r.doc_id, r.source, len(r.text.encode()), len(r.text.split())) for r in docs.collect()]
    h = {}
    from pyspark.sql import functions as F

    for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64(F.col("source").cast("string"), F.isnull("source")).alias("g")).collect():
        h[r.doc_id] = (r.h, r.g)
    total, shards = sum(r[2] for r in rows), -(-sum(r[2] for r in rows) // 8_000)
    per = defaultdict(lambda: [0, 0])
    for i, s, b, _ in rows:
        per[s][0] += b
        per[s][1] += 1
    assert total
    parts = {s: max(1, int(np.ceil(max(b / (8_000 / 16), n / max(1.0, len(rows) / shards / 16))))) for s, (b, n) in per.items()}
    groups = defaultdict(lambda: [0, 0, 0])
    key = {}
    for i, s, b, n in rows:
        key[i] = (h[i][1], h[i][0] % parts[s])
        for d, x in enumerate((b, n, 1)):
            groups[key[i]][d] += x
    cells = -(-shards // 4)
    where = spark.createDataFrame(list(groups), "gid long, part long").select("gid", "part", F.pmod(F.xxhash64("gid", "part", F.lit("cell")), F.lit(cells)).alias("c")).collect()
    want = {}
    for c in range(cells):
        own = sorted((r.gid, r.part) for r in where if r.c == c)
        first, upto = -(-c * shards // cells), -(-(c + 1) * shards // cells)
        items = np.array([groups[k] for k in own], float)
        by = S.order(items)
        for k, s in zip(by.tolist(), slow_pack(items[by].tolist(), upto - first)):
            want[own[k]] = first + s
    assert {i: want[key[i]] for i in got} == got


def test_odd_rows(odd, empty):
    rows = S.shard(odd, shard_bytes=5_000).collect()
    assert len(rows) == odd.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert S.shard(empty).count() == 0
