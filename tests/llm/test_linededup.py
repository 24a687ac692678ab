from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import linededup as L
from tests.llm.conftest import SCHEMA, row


def brute(docs):
    """Windows in order of id and place; a later occurrence's lines go."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not "".join(w).replace(" ", ""):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    docs = [(i, "\n".join(r.choice(["a", "b", "c", "", " "]) + (str(r.randrange(40)) if r.random() < 0.7 else "") for _ in range(r.randrange(1, 30)))) for i in range(80)]
    got = L.dedup_lines(spark.createDataFrame([row(i, t) for i, t in docs], SCHEMA), count_col="gone").collect()
    want = brute(docs)
    assert {x.doc_id: x.text for x in got} == want
    before = dict(docs)
    assert all(x.gone == len(before[x.doc_id].split("\n")) - (len(x.text.split("\n")) if x.text or x.gone < len(before[x.doc_id].split("\n")) else 0) for x in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["x", "y", ""]), max_size=9), min_size=1, max_size=5))
def test_property(spark, texts):
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = L.dedup_lines(spark.createDataFrame([row(i, t) for i, t in docs], SCHEMA)).collect()
    assert {x.doc_id: x.text for x in got} == brute(docs)


def test_odd_rows(spark, odd, empty):
    out = L.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in odd.collect())
    assert L.dedup_lines(empty).count() == 0
    twice = "\n".join("abcdef")
    same = spark.createDataFrame([row(1, twice), row(1, twice), row(None, twice)], SCHEMA)
    # the null id comes first; rows equal in id and text are treated alike
    assert sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(same).collect()) == [(0, twice), (1, ""), (1, "")]
