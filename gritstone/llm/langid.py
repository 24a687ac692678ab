"""Language ID by prediction by partial matching.

Fit (on a bounded sample of labelled rows): for each language a byte context tree of orders 0 to ``ORDER`` with the counts of
what followed each context; the start of a text counts as a byte of its own. Score (every byte of every text): a byte's code
length is that of PPM, escape method C, with exclusion: at each context from the longest that the tree has, -log2 of
count / (total + kinds) for a byte seen there, else the escape, kinds / (total + kinds), and on at the next shorter context without
the bytes seen above; at last one of the bytes never seen. All bytes that any language's sample has are told apart; those that none has are in no
context and cost the same everywhere, so one symbol for them is exact. Statistics are frozen, so the code length of every byte after
every context is tabled beforehand, in 1/4096 bits, and a text's code length is a sum of table entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm import arrowtext as at
from gritstone.llm.shared import configure

#: labelled rows of each language that the fit reads at most, those with the smallest hash of their id
FIT_ROWS = 150
ORDER = 3
#: labelled text that the fit reads at most, in characters a language: longer samples end with the text that reaches it
FIT_CHARS = 4_000_000
UNIT = 4096
_RESULT = "struct<lang:string,bits:double,second:string,margin:double>"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    kind: np.ndarray  # of each byte: 0 is a text's start, the last kind is all bytes that the sample lacks
    kinds: int
    counts: list[list[tuple[np.ndarray, np.ndarray]]]  # per language and order: keys (context and byte, to the base of kinds), counts


def kinds_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of all bytes with ``ORDER`` starts before each text, and where each text's bytes begin in that."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    begin = offsets[:-1] + ORDER * (np.arange(n) + 1)
    out = np.zeros(len(data) + ORDER * n, np.uint16)
    out[np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), size) + 1)] = kind[data]
    return out, begin


def fit_arrays(texts: dict[str, list[str]]) -> Model:
    langs = sorted(texts)
    raw = {lang: at.bytes_of(pa.array(texts[lang], pa.large_string())) for lang in langs}
    total = sum((np.bincount(d, minlength=256) for d, _ in raw.values()), np.zeros(256, np.int64))
    seen = np.flatnonzero(total)
    kinds = len(seen) + 2
    kind = np.full(256, kinds - 1, np.uint16)
    kind[seen] = np.arange(1, len(seen) + 1)
    counts = []
    for lang in langs:
        z, begin = kinds_of(*raw[lang], kind)
        i = at.ragged(begin, np.diff(raw[lang][1]))
        key, per = z[i].astype(np.int64), []
        for k in range(ORDER + 1):
            if k:
                key = key + z[i - k].astype(np.int64) * kinds**k
            per.append(np.unique(key, return_counts=True))
        counts.append(per)
    return Model(langs, kind, kinds, counts)


class Coder:
    """Code lengths of every kind of byte after every context, for all languages at once."""

    def __init__(self, model: Model) -> None:
        self.langs, self.kind, self.kinds = model.langs, model.kind, model.kinds
        contexts = [np.unique(np.concatenate([per[k][0] // self.kinds for per in model.counts] or [np.zeros(0, np.int64)])) for k in range(ORDER + 1)]
        contexts[0] = np.zeros(1, np.int64)
        edge = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        #: the longest context in the tree of any language, by the last ORDER kinds
        state = np.zeros(1, np.int32)
        for k in range(1, ORDER + 1):
            state = np.tile(state, self.kinds)
            state[contexts[k]] = edge[k] + np.arange(len(contexts[k]))
        self.state = state
        table = np.zeros((len(self.langs), int(edge[-1]), self.kinds), np.uint32)
        for lang, per in enumerate(model.counts):
            table[lang] = np.rint(self._costs(per, contexts, edge, self.kinds) * UNIT)
        flat = table.reshape(len(self.langs), int(edge[-1]) * self.kinds).astype(np.uint64)
        #: two languages in one word
        self.pairs = [flat[i] | (flat[i + 1] << np.uint64(32) if i + 1 < len(flat) else np.uint64(0)) for i in range(0, len(flat), 2)]

    @staticmethod
    def _costs(per: list[tuple[np.ndarray, np.ndarray]], contexts: list[np.ndarray], edge: np.ndarray, n_kinds: int) -> np.ndarray:
        out = np.zeros((int(edge[-1]), n_kinds))
        up = rest_up = seen_up = count_up = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, ctx in enumerate(contexts):
                count = np.zeros((len(ctx), n_kinds))
                key, n = per[k]
                count[np.searchsorted(ctx, key // n_kinds), key % n_kinds] = n
                seen = count > 0
                total, kinds = count.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
                if k == 0:
                    # the root leaves the bytes that it has not seen, all alike
                    rest = np.full((1, n_kinds), np.log2(np.maximum(257 - kinds[0, 0], 1)))
                    cost = np.where(seen, -np.log2(count / (total + kinds)), rest - (np.log2(kinds / (total + kinds)) if total[0, 0] else 0))
                else:
                    up = np.searchsorted(contexts[k - 1], ctx % n_kinds ** (k - 1))
                    left = np.where(seen, 0, count_up[up])
                    t, u = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
                    escape = np.where(u > 0, -np.log2(u / (t + u)), 0)
                    rest = np.where(left > 0, -np.log2(left / (t + u)), escape + rest_up[up])
                    cost = np.where(seen, -np.log2(count / (total + kinds)), -np.log2(kinds / (total + kinds)) + rest)
                    # a language whose tree lacks the context codes with the shorter one
                    lacks = (total == 0)[:, 0]
                    cost[lacks], rest[lacks], count[lacks], seen[lacks] = out[edge[k - 1] + up[lacks]], rest_up[up[lacks]], count_up[up[lacks]], seen_up[up[lacks]]
                out[edge[k] : edge[k + 1]] = cost
                rest_up, seen_up, count_up = rest, seen, count
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) code lengths in 1/4096 bits."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.langs)), np.int64)
        for i, j in at.groups_by_bytes(offsets, 1 << 20):
            off = offsets[i : j + 1] - offsets[i]
            z, begin = kinds_of(data[offsets[i] : offsets[j]], off, self.kind)
            key = np.zeros(len(z), np.int32)
            for k in range(1, ORDER + 1):
                key[k:] += z[:-k].astype(np.int32) * self.kinds ** (k - 1)
            cell = self.state[key].astype(np.int64) * self.kinds + z
            # the starts before each text cost nothing; sums of at most 2**14 bytes can't overflow half a word
            real = np.ones(len(z), bool)
            real[(begin[:, None] - 1 - np.arange(ORDER)).ravel()] = False
            cell = cell[real]
            size = np.diff(off)
            parts = -(-size // 16384)
            start = np.repeat(off[:-1], parts) + 16384 * at.ragged(np.zeros(j - i, np.int64), parts)
            if not len(start):
                continue
            doc = np.repeat(np.arange(i, j), parts)
            for p, table in enumerate(self.pairs):
                sums = np.add.reduceat(table[cell], start)
                np.add.at(out[:, 2 * p], doc, (sums & np.uint64(0xFFFFFFFF)).astype(np.int64))
                if 2 * p + 1 < len(self.langs):
                    np.add.at(out[:, 2 * p + 1], doc, (sums >> np.uint64(32)).astype(np.int64))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the ``fit_rows`` rows of each language with the smallest hash of their id, and at most about ``FIT_CHARS`` characters of these.

    Null or empty labels and texts are left out. Bounds on fitting alone: every text is scored, in whole.
    """
    known = docs.where(f"`{lang_col}` <> '' and `{text_col}` <> ''").select(F.col(id_col).alias("__i"), F.col(lang_col).alias("__l"), F.xxhash64(F.col(text_col)).alias("__h"))
    nth = F.row_number().over(Window.partitionBy("__l").orderBy(F.xxhash64("__i", "__l"), "__i", "__h"))
    picked = known.withColumn("__n", nth).where(F.col("__n") <= fit_rows).select("__i", "__l", "__h").distinct()
    rows = docs.select(F.col(id_col).alias("__j"), F.col(lang_col).alias("__m"), F.col(text_col).alias("__t"))
    same = F.col("__i").eqNullSafe(F.col("__j")) & (F.col("__l") == F.col("__m")) & (F.col("__h") == F.xxhash64("__t"))
    texts: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for lang, text in sorted(tuple(r) for r in rows.join(F.broadcast(picked), same, "left_semi").select("__m", F.substring("__t", 1, FIT_CHARS).alias("__t")).distinct().toLocalIterator()):
        if held.get(lang, 0) < FIT_CHARS:
            texts.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)
    return fit_arrays(texts)


_coders: dict[str, Coder] = {}


def language(text: Column, model: Model, spark) -> Column:
    """Struct ``(lang, bits, second, margin)``: the shortest code, its bits a byte, the next one and how many bits a byte it is behind.

    Equal lengths go by the language's name. Null for null and empty texts, and for a model without languages.
    """
    shared = spark.sparkContext.broadcast(model)
    number = uuid.uuid4().hex

    @F.arrow_udf(_RESULT)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        if number not in _coders:
            _coders.clear()
            _coders[number] = Coder(m)
        coder = _coders[number]
        names = np.array([*coder.langs, None], dtype=object)
        for arr in batches:
            data, off = at.bytes_of(arr)
            size = np.diff(off)
            if not coder.langs:
                yield pa.nulls(len(arr), pa.struct([("lang", pa.string()), ("bits", pa.float64()), ("second", pa.string()), ("margin", pa.float64())]))
                continue
            bits = coder.lengths(data, off)
            order = np.argsort(bits, axis=1, kind="stable")
            best = order[:, 0]
            per = np.take_along_axis(bits, order[:, :2], axis=1) / UNIT / np.maximum(size, 1)[:, None]
            two = len(coder.langs) > 1
            second = pa.array(names[order[:, 1]] if two else [None] * len(arr), pa.string())
            margin = pa.array(per[:, 1] - per[:, 0], pa.float64()) if two else pa.nulls(len(arr), pa.float64())
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(per[:, 0]), second, margin], names=["lang", "bits", "second", "margin"], mask=pa.array(size == 0))

    return f(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, predicted, bits_per_byte, second, margin)`` for every row, repeated rows and null ids included."""
    spark = docs.sparkSession
    configure(spark)
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("__id"), language(F.col(text_col), model, spark).alias("__l"))
    return rows.select(F.col("__id").alias(id_col), F.col("__l.lang").alias("predicted"), F.col("__l.bits").alias("bits_per_byte"), F.col("__l.second").alias("second"), F.col("__l.margin").alias("margin"))
