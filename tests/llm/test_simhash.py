from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from gritstone.llm import arrowtext as at
from gritstone.llm import simhash as S
from tests.llm.conftest import SCHEMA, row, words


def corpus(n=60, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = words(r, r.randint(30, 200))
        out.append(text)
        if i % 3 == 0:
            w = text.split()
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if i % 10 == 0:
            out += [text] * 5
    return out


def brute(texts, radius=S.RADIUS):
    """Components over all pairs, bit by bit."""
    fp, n = S.fingerprints(*at.bytes_of(pa.array(texts, pa.large_string())))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if n[a] and n[b] and sum(int(x).bit_count() for x in fp[a] ^ fp[b]) <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def test_groups_are_those_of_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.group_id for r in S.near_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert len(set(got.values())) == 60
    left = S.drop_near_copies(docs).collect()
    assert sorted(r.doc_id for r in left) == sorted(set(got.values()))
    assert left[0].item == 7


def test_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_MIN", 8)
    monkeypatch.setattr(S, "TILE", 4)
    texts = corpus(40, 5)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.group_id for r in S.near_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_fingerprints_by_definition():
    texts = ["a b c d e f", "solo", "", "x y x y x y z"]
    fp, n = S.fingerprints(*at.bytes_of(pa.array(texts, pa.large_string())))
    assert n.tolist() == [6, 1, 0, 7]
    h, _, _, doc = at.tokens(*at.bytes_of(pa.array(texts, pa.large_string())))
    for d in (0, 3):
        own = h[doc == d]
        pair = own[:-1] * np.uint64(3) + own[1:] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(S.WORDS):
            bits = np.unpackbits(at.mix(pair, k)[:, None].view(np.uint8), axis=1)
            own_bits = np.unpackbits(at.mix(at.mix(pair, 0).sum(keepdims=True), S.WORDS + k).view(np.uint8)).astype(bool)
            twice = 2 * bits.sum(axis=0, dtype=int)
            want = np.packbits((twice > len(pair)) | (twice == len(pair)) & own_bits).view(np.uint64)[0]
            assert fp[d, k] == want


def test_a_doubled_text_is_a_copy(spark):
    """Distance alone decides, whatever the lengths; short texts that share half of their pairs are none."""
    text = words(random.Random(8), 300)
    docs = spark.createDataFrame([row(1, text), row(2, text + " " + text), row(3, "a b c"), row(4, "a b d"), row(5, "e f g h i"), row(6, "e f g x y")], SCHEMA)
    got = {r.doc_id: r.group_id for r in S.near_groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_blocks_beyond_the_radius_are_skipped_without_loss():
    r = np.random.default_rng(1)
    fp = np.concatenate([r.integers(0, 1 << 62, (300, 4), np.uint64), np.zeros((3, 4), np.uint64), np.full((3, 4), ~np.uint64(0)), r.integers(0, 1 << 62, (50, 4), np.uint64) & r.integers(0, 1 << 62, (50, 4), np.uint64)])
    fp = fp[np.argsort(S.population(fp), kind="stable")]
    got = {(int(a), int(b)) for x, y in S.near_pairs(fp, None, S.RADIUS) for a, b in zip(x, y)}
    assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if np.bitwise_count(fp[a] ^ fp[b]).sum() <= S.RADIUS}


def test_odd_rows(odd, empty):
    rows = S.near_groups(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r.n_words == 40]
    assert len(same) == 4 and len({r.group_id for r in same}) == 1 and sum(r.keep for r in same) == 1
    assert all(r.keep for r in rows if r.n_words == 0)
    left = S.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert left.count() == odd.count() - 3
    assert S.near_groups(empty).count() == 0 and S.drop_near_copies(empty).count() == 0


def planted(n, radius, seed=2):
    """Random fingerprints, and copies of the first with as many bits changed as the radius allows, or one more."""
    r = np.random.default_rng(seed)
    fp = r.integers(0, 1 << 63, (n, 4)).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, (n, 4)).astype(np.uint64)
    bits = np.unpackbits(fp[: n // 4].view(np.uint8), axis=1)
    for k, row_ in enumerate(bits):
        row_[r.choice(256, radius + k % 2, replace=False)] ^= 1
    fp = np.concatenate([fp, np.packbits(bits, axis=1).view(np.uint64)])
    return fp[np.argsort(S.population(fp), kind="stable")]


def within(pairs, x, y, radius):
    return {(int(i), int(j)) for a, b in pairs for i, j in zip(a, b) if np.bitwise_count(x[i] ^ y[j]).sum() <= radius}


def test_buckets_miss_no_pair():
    """At the very radius, for every cut of the words, all with all and some with others; the shares together are all."""
    for radius in (2, S.RADIUS):
        fp = planted(400, radius)
        want = within(S.near_pairs(fp, None, radius), fp, fp, radius)
        assert len(want) >= 50
        x, y = fp[::2], fp[1::2]
        across = within(S.near_pairs(x, y, radius), x, y, radius)
        for parts in S.PARTS[1:]:
            got = set().union(*(within(S.word_pairs(fp, None, radius, parts, k, 3), fp, fp, radius) for k in range(3)))
            assert {(min(p), max(p)) for p in got} == want
            assert within(S.word_pairs(x, y, radius, parts), x, y, radius) == across
    fp = planted(300, S.RADIUS)
    got = within(S.word_pairs(fp, None, S.RADIUS, 4), fp, fp, S.RADIUS)
    assert {(min(p), max(p)) for p in got} == within(S.near_pairs(fp, None, S.RADIUS), fp, fp, S.RADIUS)


def test_plan_goes_by_the_buckets():
    """Many rows are not compared pair by pair; rows that share their keys are, as buckets leave nothing out there."""
    fp = planted(60_000, S.RADIUS)
    assert S.plan(fp, fp, S.RADIUS) and not S.plan(fp[:300], fp[:300], S.RADIUS)
    assert not S.plan(fp & np.uint64(1), fp & np.uint64(1), S.RADIUS)
    for parts in S.PARTS:
        for word in range(4):
            assert sum(t[3] for t in S.tables(S.RADIUS, parts) if t[0] == word) == 64
        assert sum(t[4] + 1 for t in S.tables(S.RADIUS, parts)) == S.RADIUS + 1


def test_forest_in_shares_and_blocks(spark, monkeypatch):
    """Shares of a block, and several blocks, give the groups that brute force gives, by buckets too."""
    fp = planted(900, S.RADIUS)
    want = S.forest(fp, None, S.RADIUS)
    monkeypatch.setattr(S, "PAIR_NS", 1e12)
    monkeypatch.setattr(S, "PARTS", (6,))
    assert (S.forest(fp, None, S.RADIUS) == want).all() and len(set(want.tolist())) < len(fp)
    monkeypatch.setattr(S, "BLOCK_MIN", 8)
    monkeypatch.setattr(S, "BLOCK_MAX", 24)
    texts = corpus(40, 5)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.group_id for r in S.near_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_crowds_are_not_compared_once_linked(monkeypatch):
    """A group's rows are compared with each other until they are linked, not in all tables; what else is near still joins."""
    r = np.random.default_rng(4)
    bits = np.repeat(r.integers(0, 2, (1, 256), np.uint8), 1200, axis=0)
    for row_ in bits[1:]:
        row_[r.choice(256, 2, replace=False)] ^= 1
    for k, row_ in enumerate(bits[-40:]):
        row_[r.choice(256, S.RADIUS - k % 8, replace=False)] ^= 1
    fp = np.concatenate([np.packbits(bits, axis=1).view(np.uint64), planted(400, S.RADIUS)])
    fp = fp[np.argsort(S.population(fp), kind="stable")]
    monkeypatch.setattr(S, "plan", lambda x, y, radius: 0)
    want = S.forest(fp, None, S.RADIUS)
    left = r.random(len(fp)) < 0.5
    across = S.forest(fp, left, S.RADIUS)
    seen, pairs = [], S.word_pairs
    monkeypatch.setattr(S, "plan", lambda x, y, radius: 4)
    monkeypatch.setattr(S, "HELD", 4096)
    monkeypatch.setattr(S, "word_pairs", lambda *a: (seen.append(len(p[0])) or p for p in pairs(*a)))
    assert (S.forest(fp, None, S.RADIUS) == want).all()
    assert sum(seen) < 3 * 1200 * 1200
    assert (S.forest(fp, left, S.RADIUS) == across).all()
