from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gritstone.llm import arrowtext as at
from gritstone.llm import toxicity as T
from tests.llm.conftest import SCHEMA, row, words

INSULTS = ["gromp", "vexil", "brutto", "nastor"]


def maximal(score):
    """All maximal segments by their definition, through splitting at the best segment."""
    if not len(score) or max(score) <= 0:
        return []
    best = max(((sum(score[a:b]), a - b, -a, a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), key=lambda x: x[:3])
    _, _, _, a, b = best
    # the best one, kept as short as it can be, and what lies on both sides
    return [(x, y, s) for x, y, s in maximal(score[:a])] + [(a, b, float(best[0]))] + [(x + b, y + b, s) for x, y, s in maximal(score[b:])]


@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_are_the_maximal_ones(score):
    got = T.segments(np.array(score, float))
    assert sum(s for *_, s in got) == sum(s for *_, s in maximal(score))
    for a, b, s in got:
        assert s == sum(score[a:b]) and all(sum(score[a:k]) > 0 for k in range(a + 1, b)) and all(sum(score[k:b]) > 0 for k in range(a + 1, b))


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(1, 8)), max_size=12))
def test_sparse_scan_is_the_dense_one(gaps):
    place = np.cumsum([g for g, _ in gaps]) - 1 if gaps else np.zeros(0, int)
    value = np.array([v / 2 for _, v in gaps])
    dense = np.full(int(place[-1]) + 1 if gaps else 0, -0.25)
    dense[place.astype(int)] = value
    got = T.sparse_segments(place.astype(int), value, 0.25)
    want = T.segments(dense)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def make(spark, n, seed, stem=False):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = words(r, r.randint(20, 80)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(INSULTS) + (words(r, 1) if stem else ""))
        docs.append(row(i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("stem", [False, True])
def test_held_out_accuracy(spark, stem):
    docs, labels = make(spark, 1500, 1, stem)
    seen = labels.where("doc_id < 1000")
    got = {r.doc_id: r.toxic for r in T.toxic_passages(docs, seen).collect()}
    held = [r for r in labels.where("doc_id >= 1000").collect()]
    bad = [got[r.doc_id] for r in held if r.toxic]
    good = [got[r.doc_id] for r in held if not r.toxic]
    assert sum(bad) >= 0.95 * len(bad) and sum(good) <= 0.01 * len(good)
    kept = {r.doc_id for r in T.drop_toxic(docs, seen).collect()}
    assert kept == {i for i, t in got.items() if not t}


def test_passages_lie_where_the_insults_are(spark):
    docs, labels = make(spark, 300, 2)
    text = " ".join(words(random.Random(4), 200).split()[:200] + INSULTS * 2 + words(random.Random(5), 200).split())
    more = docs.union(spark.createDataFrame([row(9000, text)], SCHEMA))
    r = T.toxic_passages(more, labels).where("doc_id = 9000").first()
    assert [(s.start, s.stop) for s in r.segments] == [(200, 208)] and r.toxic and r.n_words == 408


def test_calibration_holds_on_clean_texts(spark):
    docs, labels = make(spark, 700, 3)
    clean = [r for r in T.toxic_passages(docs, labels).join(labels, "doc_id").where(labels["toxic"] == 0).collect()]
    for p in (0.5, 0.1, 0.01):
        assert np.mean([r.p_value < p for r in clean]) <= p * 1.5


def test_stems_are_prefix_hashes():
    h, doc, (four, six) = at.stems(*at.bytes_of(pa.array(["Abcdefgh abcd", "xy"])), (4, 6))
    own, *_ = at.tokens(*at.bytes_of(pa.array(["abcd", "abcdef", "xy"])))
    assert four.tolist() == [own[0], own[0], own[2]] and six.tolist() == [own[1], own[0], own[2]] and doc.tolist() == [0, 0, 1]


def test_odd_rows(spark, odd, empty):
    docs, labels = make(spark, 200, 1)
    nulls = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (5, 1, 1)], "doc_id long, quality int, toxic int"))
    both = docs.union(odd)
    rows = T.toxic_passages(both, nulls).collect()
    assert len(rows) == both.count()
    assert all(r.p_value == 1 and r.segments == [] for r in rows if r.n_words == 0)
    out = T.drop_toxic(odd, nulls)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert T.toxic_passages(empty, nulls).count() == 0 and T.drop_toxic(empty, nulls).count() == 0
    assert T.drop_toxic(odd, nulls.where("false")).count() == odd.count()
    assert T.drop_toxic(odd, nulls.where("toxic = 1")).count() == odd.count()
