from __future__ import annotations

import random

from gritstone.llm import decontam as D
from tests.llm.conftest import SCHEMA, row, words


def longest(doc, item):
    """Longest common run of words, by dynamic programming."""
    best, prev = 0, [0] * (len(item) + 1)
    for w in doc:
        now = [0] * (len(item) + 1)
        for j, x in enumerate(item):
            if w == x:
                now[j + 1] = prev[j] + 1
                best = max(best, now[j + 1])
        prev = now
    return best


def make(seed=4):
    r = random.Random(seed)
    items = [words(r, r.choice([3, 6, 20, 60])) for _ in range(12)]
    docs = []
    for i in range(60):
        w = words(r, r.randint(5, 150)).split()
        if i % 2 == 0:
            item = r.choice(items).split()
            a = r.randrange(len(item))
            k = r.randint(1, len(item) - a)
            at = r.randrange(len(w))
            w[at:at] = item[a : a + k]
        docs.append(" ".join(w).upper() if i % 4 == 0 else ", ".join(w))
    return docs, items


def test_longest_matches_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD", 4000)
    docs, items = make()
    table = spark.createDataFrame([row(i, t) for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaked_passages(table, bench).collect()}
    want = {}
    for i, t in enumerate(docs):
        w = t.lower().replace(",", "").split()
        for j, item in enumerate(items):
            it = item.split()
            n = longest(w, it)
            if n >= min(len(it), D.MIN_WORDS):
                want[i, j] = n
    assert {k: r.words for k, r in got.items()} == want and want
    for (i, j), r in got.items():
        part = docs[i].encode()[r.byte_start : r.byte_stop].decode().lower().replace(",", "").split()
        assert part == items[j].split()[r.item_start : r.item_start + r.words]
        assert docs[i].lower().replace(",", "").split()[r.word_start : r.word_start + r.words] == part
    kept = {r.doc_id for r in D.drop_leaks(table, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


def test_benchmark_in_parts(spark, monkeypatch):
    docs, items = make(9)
    table = spark.createDataFrame([row(i, t) for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, D.leaked_passages(table, bench).collect()))
    assert whole
    monkeypatch.setattr(D, "BLOCK", 200)
    assert sorted(map(tuple, D.leaked_passages(table, bench).collect())) == whole


def test_short_items_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([row(1, "so he said To be, or not at all"), row(2, "to be or not"), row(3, "to be or"), row(None, "not to be or not.")], SCHEMA)
    bench = spark.createDataFrame([("q-1", "to be or not", 1), ("q-2", "Seven words that stand in no document", 2)], "item_id string, text string, words int")
    got = {(r.doc_id, r.item_id, r.words, r.verbatim) for r in D.leaked_passages(docs, bench).collect()}
    assert got == {(1, "q-1", 4, False), (2, "q-1", 4, True), (None, "q-1", 4, True)}
    assert [r.doc_id for r in D.drop_leaks(docs, bench).collect()] == [3]
    other = docs.withColumnRenamed("doc_id", "item_id")  # an id called like the items'
    assert D.drop_leaks(other, bench).columns == other.columns


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "one two three four five six")], "item_id long, text string")
    assert D.leaked_passages(odd, bench).count() == 0
    assert D.drop_leaks(odd, bench).count() == odd.count() and D.drop_leaks(odd, bench).columns == odd.columns
    none = bench.where("false")
    assert D.leaked_passages(odd, none).count() == 0 and D.drop_leaks(odd, none).count() == odd.count()
    assert D.drop_leaks(empty, bench).count() == 0
    same = odd.where("doc_id = 4").select("text").first()[0]
    hit = spark.createDataFrame([(5, same), (5, same)], "item_id long, text string")
    assert D.leaked_passages(odd, hit).count() == 4 and D.drop_leaks(odd, hit).count() == odd.count() - 4
