"""Benchmark decontamination with suffix arrays of the training texts.

The texts of a batch form shards of a few megabytes. Each shard's suffix array, over word hashes, is built by prefix
doubling from keys of several words on, up to the length of the longest test item, beyond which no match can go. Every suffix
of every test item is searched in every shard by binary search: first in the sorted keys, then over the suffixes themselves.
All suffixes of the shard that share at least the item's threshold of words with it are taken, and extended to the longest match. Words are
compared without case and punctuation; whether a match is the same byte by byte is told besides. Nothing is shuffled: a document lies whole in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gritstone.llm import arrowtext as at
from gritstone.llm.shared import configure

#: a match needs this many words, or the whole item if that is shorter
MIN_WORDS = 13
SHARD = 4 << 20
#: bytes of benchmark text that are searched at once; a larger benchmark is searched part by part
BLOCK = 64 << 20
_HITS = "array<struct<item:{},words:int,item_start:int,word_start:int,byte_start:bigint,byte_stop:bigint,verbatim:boolean>>"


@dataclass(frozen=True)
class Tests:
    """The words of all test items one after another, the items' edges, each item's threshold, and where the words lie in the items' bytes."""

    items: list  # the ids, of any type
    words: np.ndarray
    edges: np.ndarray
    need: np.ndarray
    data: np.ndarray
    first: np.ndarray
    last: np.ndarray


def tests(items: list, texts: list[str], min_words: int = MIN_WORDS) -> Tests:
    """Items without a word match nothing and are left out."""
    data, offsets = at.bytes_of(pa.array(texts, pa.large_string()))
    h, first, last, doc = at.tokens(data, offsets)
    n = np.bincount(doc, minlength=len(texts))
    keep = n > 0
    return Tests([x for x, k in zip(items, keep) if k], h, np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int64), np.minimum(n[keep], min_words), data, first, last)


def suffix_array(t: np.ndarray, edges: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Suffix array of word ids ``t`` (from 1 on) cut at ``edges``: suffixes in order of their first ``depth`` words.

    A suffix ends with its document, and the end sorts before any word. Gives also the key (first m words) of each suffix in
    order, the ids padded with zeros after each document, m and the bits of a word in the key.
    """
    n = len(t)
    bits = max(1, int(t.max(initial=0) + 1).bit_length())
    m = max(1, 63 // bits)
    left = edges[1:][np.repeat(np.arange(len(edges) - 1), np.diff(edges))] - np.arange(n)  # words to the document's end
    key = np.zeros(n, np.int64)
    for k in range(m):
        w = np.zeros(n, np.int64)
        if k < n:
            w[: n - k] = t[k:]
        w[left <= k] = 0
        key = key << bits | w
    sa = np.argsort(key)
    by_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = by_key[1:] != by_key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = m
    while h < depth:
        r = rank[sa]
        tied = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at_ = np.flatnonzero(tied)
        if not len(at_):
            break
        p = sa[at_]
        after = np.where(left[p] > h, rank[np.minimum(p + h, n - 1)] + 1, 0)
        # within each run of ties, by the rank of what follows the h words that are equal
        order = np.lexsort((after, r[at_]))
        p, after, r = p[order], after[order], r[at_][order]
        sa[at_] = p
        new = np.ones(len(at_), bool)
        new[1:] = (r[1:] != r[:-1]) | (after[1:] != after[:-1])
        rank[p] = np.maximum.accumulate(np.where(new, at_, 0))
        h *= 2
    return sa, by_key, left, m, bits


def _common(t: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray, at_: np.ndarray, q_left: np.ndarray, known: int = 0) -> np.ndarray:
    """Length of the common prefix of suffix p[i] of t and suffix at_[i] of q, at least ``known`` of which is sure."""
    most = np.minimum(left[p], q_left)
    out = np.minimum(known, most)
    on = np.flatnonzero(out < most)
    while len(on):
        k = out[on]
        same = t[p[on] + k] == q[at_[on] + k]
        on = on[same]
        out[on] += 1
        on = on[out[on] < most[on]]
    return out


def search(tests_: Tests, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """All maximal matches in one shard: test position, shard position, words, for matches that reach the item's threshold."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if not len(h) or not len(tests_.words):
        return none
    vocab, t = np.unique(h, return_inverse=True)
    t = t.astype(np.int64) + 1
    k = np.searchsorted(vocab, tests_.words)
    known = vocab[np.minimum(k, len(vocab) - 1)] == tests_.words
    q = np.where(known, k + 1, 0)  # 0: a word that the shard lacks
    item = np.repeat(np.arange(len(tests_.items)), np.diff(tests_.edges))
    q_left = tests_.edges[1:][item] - np.arange(len(q))
    need = tests_.need[item]
    sa, by_key, left, m, bits = suffix_array(t, edges, int(np.diff(tests_.edges).max()))
    # every test suffix that is long enough, by binary search in the keys
    suffix = np.flatnonzero(q_left >= need)
    lo_key, hi_key = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
    alive = np.ones(len(suffix), bool)
    for j in range(m):
        use = need[suffix] > j
        w = np.where(use, q[np.minimum(suffix + j, len(q) - 1)], 0)
        alive &= ~use | (w > 0)
        lo_key = lo_key << bits | w
        hi_key = hi_key << bits | np.where(use, w, (1 << bits) - 1)
    suffix, lo_key, hi_key = suffix[alive], lo_key[alive], hi_key[alive]
    lo, hi = np.searchsorted(by_key, lo_key, "left"), np.searchsorted(by_key, hi_key, "right")
    some = lo < hi
    suffix, lo, hi = suffix[some], lo[some], hi[some]
    if not len(suffix):
        return none
    # then over the suffixes: the range that shares the first ``need`` words
    below = lambda a, b, p, s, upper: _bisect(t, left, sa, q, a, b, s, need[s], upper)
    first, last = below(lo, hi, None, suffix, False), below(lo, hi, None, suffix, True)
    count = last - first
    suffix, first, count = suffix[count > 0], first[count > 0], count[count > 0]
    if not len(suffix):
        return none
    p, s = sa[at.ragged(first, count)], np.repeat(suffix, count)
    # only matches that don't extend to the left
    start, q_start = np.zeros(len(t), bool), np.zeros(len(q), bool)
    start[edges[:-1][np.diff(edges) > 0]] = True
    q_start[tests_.edges[:-1]] = True
    grows = ~start[p] & ~q_start[s] & (t[p - 1] == q[s - 1])
    p, s = p[~grows], s[~grows]
    return s, p, _common(t, left, p, q, s, q_left[s])


def _bisect(t: np.ndarray, left: np.ndarray, sa: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, need: np.ndarray, upper: bool) -> np.ndarray:
    """First index in [lo, hi) whose suffix is not below (with ``upper``: is above) the first ``need`` words of test suffix s."""
    lo, hi = lo.copy(), hi.copy()
    on = np.flatnonzero(lo < hi)
    while len(on):
        mid = (lo[on] + hi[on]) // 2
        p, n = sa[mid], need[on]
        c = _common(t, left, p, q, s[on], n)
        whole = c >= n
        end = left[p] <= c
        a = np.where(end, 0, t[np.minimum(p + c, len(t) - 1)])
        b = q[np.minimum(s[on] + c, len(q) - 1)]
        less = np.where(whole, upper, a < b)
        lo[on[less]] = mid[less] + 1
        hi[on[~less]] = mid[~less]
        on = on[lo[on] < hi[on]]
    return lo


def leaks_in(tests_: Tests, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest match of each text with each item: text, number of the item, words, place in the item, in the text (word, bytes), whether byte by byte."""
    found = []
    for i, j in at.groups_by_bytes(offsets, SHARD):
        h, b0, b1, doc = at.tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        edges = np.searchsorted(doc, np.arange(j - i + 1))
        s, p, n = search(tests_, h, edges)
        if len(s):
            item = np.searchsorted(tests_.edges, s, "right") - 1
            d = doc[p]
            order = np.lexsort((s, p, -n, item, d))
            d, item, n, s, p = d[order], item[order], n[order], s[order], p[order]
            best = np.ones(len(d), bool)
            best[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
            d, item, n, s, p = (x[best] for x in (d, item, n, s, p))
            base = offsets[i:j][d] - offsets[i]
            x, y, u, v = b0[p] + offsets[i], b1[p + n - 1] + offsets[i], tests_.first[s], tests_.last[s + n - 1]
            same = np.array([y[k] - x[k] == v[k] - u[k] and np.array_equal(data[x[k] : y[k]], tests_.data[u[k] : v[k]]) for k in range(len(x))], bool)
            found.append((d + i, item, n, s - tests_.edges[item], p - edges[d], b0[p] - base, b1[p + n - 1] - base, same))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(8))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, min_words: int) -> Iterator[Tests]:
    """The distinct test items, at most BLOCK bytes at a time, read row by row: the driver never holds more than a block."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
        if size >= BLOCK:
            yield tests(ids, texts, min_words)
            ids, texts, size = [], [], 0
    yield tests(ids, texts, min_words)


def leaks(text: Column, tests_: Tests, spark, item_type: DataType) -> Column:
    """Array of a text's longest match with each item that it leaks; empty for null and empty texts."""
    shared = spark.sparkContext.broadcast(tests_)
    id_type = to_arrow_type(item_type)

    @F.arrow_udf(_HITS.format(item_type.simpleString()))
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = pa.array(shared.value.items, id_type)
        for arr in batches:
            doc, item, *cols = leaks_in(shared.value, *at.bytes_of(arr))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            hits = pa.StructArray.from_arrays([ids.take(pa.array(item, pa.int64())), *(pa.array(c.astype(bool) if k == pa.bool_() else c, k) for c, k in zip(cols, kinds))], names=["item", "words", "item_start", "word_start", "byte_start", "byte_stop", "verbatim"])
            yield pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(arr) + 1)).astype(np.int32), hits)

    return f(text)


def leaked_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, item, words, item_start, word_start, byte_start, byte_stop, verbatim)``: each document's longest match with each item it leaks.

    Of equally long matches the first in the document, then in the item. Items shorter than ``min_words`` match as a whole. Repeated rows of ``docs`` give repeated rows; null
    ids stay null; null texts, and items with a null id or text or without a word, match nothing; an empty benchmark or table gives no row.
    If an item id, of any type, has several texts, each is searched. Long texts are searched whole.
    """
    spark = docs.sparkSession
    configure(spark)
    kind = benchmark.schema[item_col].dataType
    names = ("words", "item_start", "word_start", "byte_start", "byte_stop", "verbatim")
    out = None
    for part in _blocks(benchmark, item_col, text_col, min_words):
        rows = docs.select(F.col(id_col).alias("__id"), F.explode(leaks(F.col(text_col), part, spark, kind)).alias("__h")).select(F.col("__id").alias(id_col), F.col("__h.item").alias(item_col), *[F.col(f"__h.{c}").alias(c) for c in names])
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no test item, with all their columns.

    A document leaks an item if it has ``min_words`` words in a row of it, or the whole of a shorter one, down to a single word:
    leave items out of ``benchmark`` that are too common to tell. Null and empty texts, null ids and repeated rows stay,
    each row judged by its text alone; an empty benchmark drops nothing, an empty table gives none.
    """
    spark = docs.sparkSession
    configure(spark)
    for part in _blocks(benchmark, item_col, "text", min_words):
        docs = docs.where(F.size(leaks(F.col(text_col), part, spark, benchmark.schema[item_col].dataType)) == 0)
    return docs


#: The same rows in SQL: windows of all words that an item needs joined, runs of such windows made one match.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL
), split AS MATERIALIZED (
  SELECT side, id, text, w, list_transform(w, lambda x: translate(lower(x), 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')) AS low
  FROM (SELECT *, regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM texts)
), needs AS (
  SELECT DISTINCT least(len(low), 13) AS need FROM split WHERE side = 'i' AND len(low) > 0
), item_grams AS (
  SELECT id, k, need, array_to_string(low[k + 1 : k + need], ' ') AS gram FROM split, needs, unnest(range(0, len(low) - need + 1)) AS u(k)
  WHERE side = 'i' AND need = least(len(low), 13)
), doc_grams AS (
  SELECT id, k, need, array_to_string(low[k + 1 : k + need], ' ') AS gram FROM split, needs, unnest(range(0, len(low) - need + 1)) AS u(k) WHERE side = 'd'
), starts AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.k AS word_start, i.k AS item_start, d.k - i.k AS diagonal, need
  FROM doc_grams d JOIN item_grams i USING (need, gram)
), runs AS (
  SELECT *, word_start - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY word_start) AS run FROM starts
), matches AS (
  SELECT doc_id, item_id, min(word_start) AS word_start, min(item_start) AS item_start, count(*) + any_value(need) - 1 AS words
  FROM runs GROUP BY doc_id, item_id, diagonal, run
), best AS MATERIALIZED (
  SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, word_start, item_start) = 1
), wanted AS (
  SELECT DISTINCT 'd' AS side, doc_id AS id FROM best UNION ALL SELECT DISTINCT 'i', item_id FROM best
), places AS (
  SELECT side, id, k AS pos, strlen(w[k + 1]) AS size, strlen(gap[k + 1]) AS before
  FROM (SELECT side, id, w, regexp_split_to_array(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS gap FROM split JOIN wanted USING (side, id)), unnest(range(0, len(w))) AS u(k)
), words AS MATERIALIZED (
  SELECT side, id, pos, size, sum(before + size) OVER (PARTITION BY side, id ORDER BY pos) AS stop FROM places
), edges AS (
  SELECT b.*, CAST(a.stop - a.size AS BIGINT) AS byte_start, CAST(z.stop AS BIGINT) AS byte_stop, CAST(p.stop - p.size AS BIGINT) AS item_from, CAST(q.stop AS BIGINT) AS item_to
  FROM best b JOIN words a ON a.side = 'd' AND a.id = b.doc_id AND a.pos = b.word_start
  JOIN words z ON z.side = 'd' AND z.id = b.doc_id AND z.pos = b.word_start + b.words - 1
  JOIN words p ON p.side = 'i' AND p.id = b.item_id AND p.pos = b.item_start
  JOIN words q ON q.side = 'i' AND q.id = b.item_id AND q.pos = b.item_start + b.words - 1
)
SELECT e.doc_id, e.item_id, CAST(words AS INTEGER) AS words, CAST(item_start AS INTEGER) AS item_start, CAST(word_start AS INTEGER) AS word_start, byte_start, byte_stop,
       substr(hex(encode(d.text)), 2 * byte_start + 1, 2 * (byte_stop - byte_start)) = substr(hex(encode(t.text)), 2 * item_from + 1, 2 * (item_to - item_from)) AS verbatim
FROM edges e JOIN documents d ON d.doc_id = e.doc_id JOIN benchmark t ON t.item_id = e.item_id
"""
