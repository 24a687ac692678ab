"""Toxicity: every significant toxic passage, by maximum-scoring segments over token log-odds.

Fit (on a bounded sample of labelled rows): the log-odds of each word, and of each word's beginnings, between toxic and clean
documents under a Dirichlet prior, taken at the lower confidence bound, so that rare words and words of one copied text stay
neutral. A word scores as the best of itself and its beginnings (an insult with any ending is one); all other words cost ``GAP``. Scan (over all texts, whole): the linear-time algorithm of Ruzzo and Tompa gives all maximal scoring segments.
Log-odds are cut at ``CAP``, so that no single word decides. Calibration: Karlin-Altschul statistics. lambda solves E[exp(lambda s)] = 1 over the words of the clean sample, which sets K too, and a segment of score S in a text of n words has E = K n exp(-lambda S); p = 1 - exp(-E). A
text's p-value is that of its best segments together, by the sum statistics of the same extreme-value law; it is toxic if
that is below ``P_VALUE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm import arrowtext as at
from gritstone.llm.shared import configure, stored
from gritstone.llm.simhash import RADIUS, WORDS, _find, fingerprint, near_pairs, population

#: labelled rows that the fit reads at most, those with the smallest hash of their id: a bound on fitting alone
FIT_ROWS = 8_000
PRIOR = 0.5
Z = 3.2
#: part of the toxic families that a word must occur in: what fewer share is their subject, not their tone
MIN_SHARE = 0.02
#: log-odds that a word needs itself, besides the lower bound above the gap's cost
MIN_ODDS = 2.0
#: beginnings of words, in bytes
STEMS = (4, 5, 6, 7, 8)
GAP = 0.25
CAP = 8.0
P_VALUE = 1e-3
_RESULT = "struct<n:int,score:double,p:double,segments:array<struct<start:int,stop:int,score:double,p:double>>>"


@dataclass(frozen=True)
class Model:
    """Hashes of the words that have a score, their scores, and the calibration."""

    hashes: np.ndarray
    scores: np.ndarray
    lam: float
    k: float
    gap: float = GAP
    #: 1 / how many features stand in the same families, as a word and its beginnings do
    alike: np.ndarray | None = None


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, stop, score)`` of a sequence (Ruzzo and Tompa), in order."""
    stack: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum after
    total = 0.0
    for i, s in enumerate(score.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        start, stop, left, right = i, i + 1, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, stop, left, right))
    return [(a, b, right - left) for a, b, left, right in stack]


def sparse_segments(at_: np.ndarray, score: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """``segments`` of a text whose word at_[i] scores score[i] > 0 and every other word -gap, in time linear in len(at_)."""
    if not len(at_):
        return []
    merged = np.empty(2 * len(at_) - 1)
    merged[0::2] = score
    merged[1::2] = -gap * (np.diff(at_) - 1)
    return [(int(at_[a // 2]), int(at_[(b - 1) // 2]) + 1, s) for a, b, s in segments(merged)]


def scored(model: Model, h: np.ndarray, stems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words with a positive score, and the scores: of each word the best of its own and its beginnings'."""
    best = np.zeros(len(h))
    if len(model.hashes) and len(h):
        for x in (h, *stems):
            k = np.minimum(np.searchsorted(model.hashes, x), len(model.hashes) - 1)
            hit = np.flatnonzero(model.hashes[k] == x)
            best[hit] = np.maximum(best[hit], model.scores[k[hit]])
    hit = np.flatnonzero(best > 0)
    return hit, best[hit]


def families(toxic: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Number of each document's family: copies of one text, labels apart, count once. Near-equal fingerprints tell them."""
    family = np.arange(len(toxic))
    if len(fp):
        order = np.argsort(population(fp), kind="stable")
        for a, b in near_pairs(fp[order], None, RADIUS):
            a, b = order[a], order[b]
            same = toxic[a] == toxic[b]
            _find(family, a[same], b[same])
    return np.unique(family, return_inverse=True)[1]


def fit_arrays(h: np.ndarray, doc: np.ndarray, toxic: np.ndarray, family: np.ndarray) -> Model:
    """A model, not calibrated, from each document's distinct word hashes, label and family."""
    n = len(toxic)
    label = np.zeros(int(family.max(initial=0)) + 1, bool)
    label[family] = toxic.astype(bool)
    n1, n0 = float(label[: n or 0].sum()), float(len(label) * (n > 0) - label.sum())
    _, first = np.unique(at.mix(h ^ at.mix(family[doc].astype(np.uint64))), return_index=True)
    words, inverse = np.unique(h[first], return_inverse=True)
    of = label[family[doc[first]]] if len(first) else np.zeros(0, bool)
    y1 = np.bincount(inverse[of], minlength=len(words)).astype(float)
    y0 = np.bincount(inverse[~of], minlength=len(words)).astype(float)
    # families that have the word and that lack it, with the same prior counts in both classes
    a = PRIOR
    delta = np.log((y1 + a) / (n1 - y1 + a)) - np.log((y0 + a) / (n0 - y0 + a))
    low = delta - Z * np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    low = np.where((n1 > 0) & (n0 > 0), np.minimum(low, CAP), 0)
    keep = (low > GAP) & (delta >= MIN_ODDS) & (y1 >= MIN_SHARE * n1)
    sign = np.zeros(len(words), np.uint64)
    np.add.at(sign, inverse, at.mix(family[doc[first]].astype(np.uint64)))
    _, same, size = np.unique(sign[keep], return_inverse=True, return_counts=True)
    return Model(words[keep], low[keep], 1.0, 1.0, alike=1 / size[same])


def calibrated(model: Model, n: np.ndarray, top: np.ndarray, values: np.ndarray, counts: np.ndarray) -> Model:
    """The model with lambda and K from clean texts: word counts, best segments' scores, and how many words have each score.

    Each scored word, with its beginnings, has half a pseudo-count. K is by moments, and 1 where none of the texts has a segment;
    it is kept in [0.1, 1], as few clean texts have segments: below 0.1 p-values come out larger than they are, above 1 smaller.
    """
    seen = np.concatenate([counts, 0.5 * (np.ones(len(model.scores)) if model.alike is None else model.alike)])
    lam = _lambda(np.concatenate([values, model.scores]), seen / (n.sum() + seen.sum() + 1.0), model.gap)
    on = top > 0
    k = np.clip(np.exp(np.mean(lam * top[on] - np.log(np.maximum(n[on], 1)))) * on.mean(), 0.1, 1.0) if on.any() else 1.0
    return Model(model.hashes, model.scores, lam, float(k), model.gap)


def _lambda(scores: np.ndarray, p: np.ndarray, gap: float) -> float:
    """The positive root of sum p exp(lambda s) + (1 - sum p) exp(-lambda gap) = 1."""
    if not len(scores):
        return 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 600))).sum() + (1 - p.sum()) * np.exp(-x * gap) - 1)
    if (p * scores).sum() >= gap * (1 - p.sum()):
        return 1e-3
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _words(text: Column, only: np.ndarray | None = None) -> Column:
    """Hashes of a text's distinct words and of their beginnings, those in the sorted ``only`` if given."""

    @F.arrow_udf("array<bigint>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            h, doc, stems = at.stems(*at.bytes_of(arr), STEMS)
            h, doc = np.concatenate([h, *stems]), np.tile(doc, 1 + len(STEMS))
            if only is not None:
                on = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h if len(only) else np.zeros(len(h), bool)
                h, doc = h[on], doc[on]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            yield pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(arr) + 1)).astype(np.int32)), pa.array(h.view(np.int64)))

    return f(text)


def _sorted(rows: DataFrame) -> pa.Table:
    """Rows of the sample on the driver, in one order."""
    return rows.toArrow().sort_by([("__i", "ascending"), ("__h", "ascending")]).combine_chunks()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the ``fit_rows`` labelled rows with the smallest hash of their id; rows with a null id, text or label are left out.

    Repeated rows count once. Without rows of both labels no word has a score and no text is toxic.
    """
    known = labels.select(F.col(id_col).alias("__i"), F.col(label_col).cast("int").alias("__y")).where("__i is not null and __y is not null").groupBy("__i").agg(F.max("__y").alias("__y"))
    picked = known.orderBy(F.xxhash64("__i"), "__i").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).where("__i is not null and __t is not null")

    sample = stored(texts.join(F.broadcast(picked), "__i").distinct().withColumn("__h", F.xxhash64("__t")), "labelled")
    # the driver gets fingerprints, then only words that enough toxic families may have: counted on the executors
    rows = _sorted(sample.select("__i", "__h", "__y", fingerprint(F.col("__t")).alias("__f")).select("__i", "__h", "__y", "__f.*"))
    whole = lambda c: pc.fill_null(rows[c], 0).to_numpy().astype(np.int64)
    toxic = (whole("__y") > 0).astype(np.int64)
    family = families(toxic, np.stack([whole(f"f{k}").view(np.uint64) for k in range(WORDS)], axis=1))
    least = MIN_SHARE * len(np.unique(family[toxic > 0]))
    often = sample.where("__y > 0").select(F.explode(_words(F.col("__t"))).alias("h")).groupBy("h").count().where(F.col("count") >= least).select("h").toArrow()
    known_words = np.sort(often["h"].to_numpy().astype(np.int64).view(np.uint64))
    rows = _sorted(sample.select("__i", "__h", _words(F.col("__t"), known_words).alias("w")))
    h = pc.list_flatten(rows["w"]).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["w"]).to_numpy().astype(np.int64)) if len(rows) else np.zeros(0, np.int64)
    model = fit_arrays(h, doc, toxic, family)
    if not len(model.hashes):
        return model

    @F.arrow_udf("struct<n:int,top:double,s:array<double>>")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            n, top, _, _, s, edges = scan(model, *at.bytes_of(arr), 0.0)
            yield pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(top), pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(s))], names=["n", "top", "s"])

    # once more over the clean part of the sample
    clean = sample.where("__y <= 0").select(marked(F.col("__t")).alias("m")).select("m.*").toArrow().combine_chunks()
    values, counts = np.unique(pc.list_flatten(clean["s"]).to_numpy(), return_counts=True)
    return calibrated(model, clean["n"].to_numpy(), clean["top"].to_numpy(), values, counts)


def text_p(model: Model, n: int, tops: np.ndarray) -> float:
    """p-value of a text of n words from its segments' scores in falling order.

    For the best r segments together, Karlin and Altschul's sum statistic: with t the sum of lambda S - ln(K n) over them,
    p = exp(-t) t**(r - 1) / (r! (r - 1)!). The smallest over r counts, each divided by 2**-r for the choice of r: the weights
    add up to 1, so p-values of clean texts stay uniform or larger.
    """
    best = min(1.0, 2 * float(-np.expm1(-model.k * n * np.exp(-model.lam * tops[0]))))
    t = np.cumsum(model.lam * tops - np.log(model.k * n))
    for r in range(2, len(tops) + 1):
        x = t[r - 1]
        if x > r * (r + 1) / 2:
            log_p = -x + (r - 1) * np.log(x) - lgamma(r + 1) - lgamma(r) + r * log(2)
            best = min(best, exp(min(log_p, 0.0)))
        elif x < t[r - 2]:
            break
    return best


def scan(model: Model, data: np.ndarray, offsets: np.ndarray, p_value: float = P_VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple]], np.ndarray, np.ndarray]:
    """Words, best score, p-value and significant segments (word ranges) of each text; then the scores of all scored words and the texts' edges in these."""
    n = len(offsets) - 1
    values, marks = [np.zeros(0)], np.zeros(n, np.int64)
    words, score, p, found = np.zeros(n, np.int64), np.zeros(n), np.ones(n), [[] for _ in range(n)]
    for i, j in at.groups_by_bytes(offsets, 1 << 20):
        h, doc, stems = at.stems(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], STEMS)
        count = np.bincount(doc, minlength=j - i)
        words[i:j] = count
        first = np.cumsum(count) - count
        hit, val = scored(model, h, stems)
        values.append(val)
        marks[i:j] = np.bincount(doc[hit], minlength=j - i)
        for d in np.unique(doc[hit]):
            a, b = np.searchsorted(hit, (first[d], first[d] + count[d]))
            segs = sparse_segments(hit[a:b] - first[d], val[a:b], model.gap)
            tops = np.array(sorted((x for *_, x in segs), reverse=True))
            score[i + d], p[i + d] = tops[0], text_p(model, int(count[d]), tops)
            for lo, hi, x in segs:
                px = -np.expm1(-model.k * count[d] * np.exp(-model.lam * x))
                if px < p_value:
                    found[i + d].append((lo, hi, x, float(px)))
    return words, score, p, found, np.concatenate(values), np.concatenate([[0], np.cumsum(marks)])


def toxicity(text: Column, model: Model, p_value: float = P_VALUE) -> Column:
    """Struct ``(n, score, p, segments)`` of a text: segments are word ranges [start, stop) with p below ``p_value``.

    A null or empty text has n 0, score 0, p 1 and no segment. p is that of all its segments together, so a text can have a small
    p without a significant segment of its own.
    """

    @F.arrow_udf(_RESULT)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            words, score, p, found, _, _ = scan(model, *at.bytes_of(arr), p_value)
            flat = [x for seg in found for x in seg]
            seg = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([float(x[2]) for x in flat], pa.float64()), pa.array([x[3] for x in flat], pa.float64())], names=["start", "stop", "score", "p"])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32), seg)
            yield pa.StructArray.from_arrays([pa.array(words.astype(np.int32)), pa.array(score), pa.array(p), lists], names=["n", "score", "p", "segments"])

    return f(text)


def toxic_passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p_value: float = P_VALUE) -> DataFrame:
    """``(id, n_words, score, p_value, toxic, segments)`` for every row of ``docs``, repeated rows and null ids included."""
    configure(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("__id"), toxicity(F.col(text_col), model, p_value).alias("__s"))
    return rows.select(F.col("__id").alias(id_col), F.col("__s.n").alias("n_words"), F.round("__s.score", 6).alias("score"), F.col("__s.p").alias("p_value"), (F.col("__s.p") < p_value).alias("toxic"), F.col("__s.segments").alias("segments"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p_value: float = P_VALUE) -> DataFrame:
    """The rows of ``docs`` whose segments together aren't significantly toxic (p at least ``p_value``), with all their columns.

    Null and empty texts, null ids and repeated rows stay, each row judged by its text alone; an empty table gives none.
    """
    configure(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    return docs.where(toxicity(F.col(text_col), model, p_value)["p"] >= p_value)
