"""SimHash near-dedup: 256-bit fingerprints compared exactly, by buckets of near keys.

A fingerprint sums the signed bits of all word pairs of a text; bits on which the pairs are divided equally are those of a hash of all of
them, so that short texts don't agree by default. Two texts are near copies if their fingerprints differ in at most ``radius``
bits, whatever their lengths; groups are the connected components. No pair within the radius is missed: were the distance of each
of the four words at least its share of ``radius + 1``, they would add up to more than the radius, so one word is nearer than its
share, and likewise one part of that word. Rows are therefore put into buckets by each part of each word, only buckets whose keys are near enough are compared, by
that word alone, and what that leaves by all bits. Where this costs more than comparing all tiles of all bits, that is done
instead. Equal fingerprints are collapsed first, and each task hands on a spanning forest of the pairs it found, so a group of
thousands stays linear.

The buckets leave out a fixed share of the pairs, so time is still quadratic in the number of distinct texts, with a small factor; the README has measured figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm import arrowtext as at
from gritstone.llm.shared import components, configure, id_key, stored

WORDS = 4
RADIUS = 66
TILE = 256
#: rows of a block, at most, and half of those that are one block; tasks that a block is compared in, together, and rows from which on they are that many
BLOCK_MAX, SLICES, BLOCK_MIN = 3 << 19, 12, 2048
#: parts that a word may be cut into; nanoseconds, as measured, of a pair by all bits, a pair by one word, a row looked up, and a bucket
PARTS, PAIR_NS, WORD_NS, ROW_NS, BUCKET_NS = (4, 5, 6, 7, 8), 15.0, 2.7, 8.0, 60_000.0
#: pairs compared at once, and how often they are halved before they are looked at; candidates held before they are compared by all bits, links held before they are joined
AT_ONCE, FOLDS, HELD, LINKS = 1 << 18, 5, 1 << 18, 1 << 15
#: rows of a bucket that are compared before links are looked up again; linked ones among them from which on they aren't compared with each other
SLAB, CROWD = 256, 48
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) fingerprints and word counts; a bit is set where more than half of the word pairs set it, or half of them and their hash."""
    n = len(offsets) - 1
    out, words = np.zeros((n, WORDS), np.uint64), np.zeros(n, np.int64)
    for i, j in at.groups_by_bytes(offsets, 1 << 20):
        h, _, _, doc = at.tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = np.bincount(doc, minlength=j - i)
        words[i:j] = count
        if not len(h):
            continue
        first = np.cumsum(count) - count
        follows = np.ones(len(h), bool)
        follows[first[count > 1] + count[count > 1] - 1] = False
        # the last word has no pair, but a text of one word is its own feature
        pair = h.copy()
        pair[:-1] = np.where(doc[1:] == doc[:-1], h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15), h[:-1])
        pair, doc = pair[follows], doc[follows]
        features = np.bincount(doc, minlength=j - i)
        bits = np.empty((len(pair), WORDS), np.uint64)
        for k in range(WORDS):
            bits[:, k] = at.mix(pair, k)
        lanes = bits.view(np.uint8)
        start = np.cumsum(features) - features
        # a hash of all pairs, whatever their order, decides where they are divided equally
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bits[:, 0])])
        whole = sums[start + features] - sums[start]
        own = np.unpackbits(np.stack([at.mix(whole, WORDS + k) for k in range(WORDS)], axis=1).view(np.uint8), axis=1).astype(bool)
        for d in np.flatnonzero(features):
            total = np.zeros(64 * WORDS, np.int64)
            for a in range(start[d], start[d] + features[d], 255):
                total += _SPREAD[lanes[a : min(a + 255, start[d] + features[d])]].sum(axis=0).view(np.uint8)
            out[i + d] = np.packbits((2 * total > features[d]) | (2 * total == features[d]) & own[d]).view(np.uint64)
    return out, words


_FP = "struct<f0:bigint,f1:bigint,f2:bigint,f3:bigint,n:bigint>"


def fingerprint(text: Column) -> Column:
    """Struct of a text's fingerprint and word count; null where the text is null or has no word."""

    @F.arrow_udf(_FP)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            fp, n = fingerprints(*at.bytes_of(arr))
            cols = [pa.array(fp[:, k].view(np.int64)) for k in range(WORDS)] + [pa.array(n)]
            yield pa.StructArray.from_arrays(cols, names=["f0", "f1", "f2", "f3", "n"], mask=pa.array(n == 0))

    return f(text)


def _find(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in ``parent``, whose entries point at smaller or equal ones."""
    while len(a):
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        keep = parent[a] != parent[b]
        a, b = a[keep], b[keep]


def near_pairs(x: np.ndarray, y: np.ndarray | None, radius: int, nth: int = 0, of: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y (of x with itself if y is None) within the radius; rows are ordered by population count.

    Of the tiles of x, every ``of``-th is taken, from the ``nth`` on.
    """
    own = y is None
    y = x if own else y
    px, py = population(x), population(y)
    xs, ys = [np.ascontiguousarray(x[:, k]) for k in range(WORDS)], [np.ascontiguousarray(y[:, k]) for k in range(WORDS)]
    wide, bits = np.empty((TILE, TILE), np.uint64), [np.empty((TILE, TILE), np.uint8) for _ in range(2)]
    close = np.empty((TILE, TILE), bool)
    for i in range(nth * TILE, len(x), of * TILE):
        p = slice(i, min(i + TILE, len(x)))
        # population counts rise along y, so the radius leaves one range of it
        lo, hi = np.searchsorted(py, px[p.start] - radius), np.searchsorted(py, px[p.stop - 1] + radius, "right")
        for j in range(max(lo, i) if own else lo, hi, TILE):
            q = slice(j, min(j + TILE, hi))
            shape = (slice(0, p.stop - p.start), slice(0, q.stop - q.start))
            w, c, s, near = wide[shape], bits[0][shape], bits[1][shape], close[shape]
            np.bitwise_xor(xs[0][p, None], ys[0][None, q], out=w)
            np.bitwise_count(w, out=s)
            for k in range(1, WORDS):
                np.bitwise_xor(xs[k][p, None], ys[k][None, q], out=w)
                np.bitwise_count(w, out=c)
                np.add(s, c, out=s)  # 256 bits, all of them different, would count as 0 in a byte
            np.less_equal(s, radius, out=near)
            if near.any():
                a, b = np.nonzero(near)
                a, b = a + p.start, b + q.start
                keep = population(x[a] ^ y[b]) <= radius
                if own:
                    keep &= a < b
                if keep.any():
                    yield a[keep], b[keep]


def split(total: int, n: int) -> list[int]:
    """``total`` in n nearly equal numbers, larger ones first."""
    return [total // n + (k < total % n) for k in range(n)]


def tables(radius: int, parts: int) -> list[tuple[int, int, int, int, int]]:
    """(word, its radius, shift, width, radius) of the parts of words such that each pair within the radius is near in one of them, and in its word.

    If distances d_k add up to r at most, and numbers n_k to r + 1, some d_k < n_k: numbers of the words, and of a word's parts.
    """
    out = []
    for word, near in enumerate(split(radius + 1, WORDS)):
        shift = 0
        for width, n in zip(split(64, parts), split(near, parts)):
            if n:
                out.append((word, near - 1, shift, width, n - 1))
            shift += width
    return out


def keys(fp: np.ndarray, word: int, shift: int, width: int) -> np.ndarray:
    return (fp[:, word] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def ball(width: int, radius: int) -> np.ndarray:
    """Numbers of ``width`` bits with at most ``radius`` bits set."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << width, dtype=np.uint32)) <= radius)


def _walsh(v: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform, under which sums over all a ^ b = c become products."""
    v, size, step = v.astype(float), len(v), 1
    while step < size:
        v = v.reshape(-1, 2, step)
        v = np.stack([v[:, 0] + v[:, 1], v[:, 0] - v[:, 1]], axis=1)
        step *= 2
    return v.ravel()


def plan(x: np.ndarray, y: np.ndarray, radius: int) -> int:
    """In how many parts words are best cut, by the buckets of a sample; 0 if all bits of all pairs are cheaper."""
    pairs = len(x) * len(y)
    sx, sy = x[:: len(x) // (1 << 15) + 1], y[:: len(y) // (1 << 15) + 1]
    best, least = 0, PAIR_NS * pairs
    for parts in PARTS:
        cost = 0.0
        for word, _, shift, width, near in tables(radius, parts):
            size, near_ = 1 << width, ball(width, near)
            buckets = min(size, len(x))
            cost += buckets * (2 * BUCKET_NS + len(near_) / size * len(y) * ROW_NS)
            if cost >= least:
                break
            around = np.zeros(size)
            around[near_] = 1
            hx, hy = (np.bincount(keys(s, word, shift, width), minlength=size) for s in (sx, sy))
            cost += (_walsh(hx) * _walsh(hy) * _walsh(around)).sum() / size / (len(sx) * len(sy)) * pairs * WORD_NS
        if cost < least:
            best, least = parts, cost
    return best


def word_pairs(x: np.ndarray, y: np.ndarray | None, radius: int, parts: int, nth: int = 0, of: int = 1, linked: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of x and y (of x with itself if y is None), all those within the radius among them, that are near in one word.

    Some come several times. Of the buckets of x, every ``of``-th is taken, from the ``nth`` on. ``linked``: parents of rows that are known
    to be linked, the rows of x and those of y in them; of such rows, pairs may be left out. The caller may go on writing to the parents.
    """
    own = y is None
    near = _Near()
    for word, within, shift, width, far in tables(radius, parts):
        around = ball(width, far).astype(np.uint32)
        sides = []
        for z in (x,) if own else (x, y):
            k = keys(z, word, shift, width)
            order = np.argsort(k.astype(np.uint16) if width <= 16 else k, kind="stable")
            size = np.bincount(k, minlength=1 << width)
            sides.append((order, np.ascontiguousarray(z[order, word]), np.cumsum(size) - size, size))
        (xo, xv, xfirst, xsize), (yo, yv, yfirst, ysize) = sides[0], sides[-1]
        for b in np.flatnonzero(xsize)[nth::of]:
            others = around ^ np.uint32(b)
            if own:
                others = others[others >= b]
            n = ysize[others]
            others, n = others[n > 0], n[n > 0]
            end = np.cumsum(n)
            if not len(end):
                continue
            at_ = np.repeat(yfirst[others] - end + n, n)
            at_ += np.arange(end[-1])
            v, last = yv[at_], xfirst[b] + xsize[b]
            for i in range(xfirst[b], last, SLAB):
                rows = np.arange(i, min(i + SLAB, last))
                for left, right in _apart(xo[rows], yo[at_], linked) if linked and len(rows) >= CROWD else ((slice(None), slice(None)),):
                    for p, q in near.pairs(xv[rows[left]], v[right], within):
                        p, q = xo[rows[left][p]], yo[at_[right][q]]
                        if own:
                            p, q = p[p != q], q[p != q]
                        yield p, q


def _apart(p: np.ndarray, q: np.ndarray, linked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray | slice, np.ndarray | slice]]:
    """Selections of p and of q that together have all pairs but those of crowds: ``CROWD`` rows of p or more that are linked, and what of q is linked to them."""
    parent, px, py = linked
    root, which, n = np.unique(parent[px[p]], return_inverse=True, return_counts=True)
    crowd = n >= CROWD
    if not crowd.all():
        yield np.flatnonzero(~crowd[which]), slice(None)
    if crowd.any():
        roots = parent[py[q]]
        for k in np.flatnonzero(crowd):
            yield np.flatnonzero(which == k), np.flatnonzero(roots != root[k])


class _Near:
    """Compares words all with all, in arrays that are used again."""

    def __init__(self) -> None:
        self.xor, self.count, self.low = np.empty(AT_ONCE, np.uint64), np.empty(AT_ONCE, np.uint8), np.empty(AT_ONCE, np.uint8)
        self.folds = np.arange(1 << FOLDS)[:, None]

    def pairs(self, x: np.ndarray, y: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of words that differ in at most ``within`` bits."""
        rows = max(8, AT_ONCE // max(1, len(y)))
        for i in range(0, len(x), rows):
            u = x[i : i + rows, None]
            step = AT_ONCE // len(u)
            for j in range(0, len(y), step):
                w = y[None, j : j + step]
                shape, size = (len(u), w.shape[1]), len(u) * w.shape[1]
                np.bitwise_xor(u, w, out=self.xor[:size].reshape(shape))
                np.bitwise_count(self.xor[:size], out=self.count[:size])
                fold = -(-size >> FOLDS)
                self.count[size : fold << FOLDS] = 255
                # the least of each few is looked at first, as nearly all are far
                low, end = self.count[: fold << FOLDS], 0
                for k in range(FOLDS):
                    half = len(low) // 2
                    low = np.minimum(low[:half], low[half:], out=self.low[end : end + half])
                    end += half
                hit = np.flatnonzero(low <= within)
                if len(hit):
                    hit = (hit + self.folds * fold).ravel()
                    p, q = np.divmod(hit[self.count[hit] <= within], shape[1])
                    yield p + i, q + j


def forest(fp: np.ndarray, left: np.ndarray | None, radius: int, nth: int = 0, of: int = 1) -> np.ndarray:
    """Parents of rows ordered by population count, linked where they are within the radius: all with all, or those left with the others.

    ``nth`` and ``of`` take a share of the pairs; all shares together link what is within the radius.
    """
    parent = np.arange(len(fp))
    x = np.arange(len(fp)) if left is None else np.flatnonzero(left)
    y = x if left is None else np.flatnonzero(~left)
    if not len(x) or not len(y):
        return parent
    fx, fy = (fp, None) if left is None else (fp[x], fp[y])
    parts = plan(fx, fx if fy is None else fy, radius)
    pairs = word_pairs(fx, fy, radius, parts, nth, of, (parent, x, y)) if parts else near_pairs(fx, fy, radius, nth, of)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    links: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def settle(least: int) -> None:
        """Compares by all bits what is held, and joins the links if there are ``least``."""
        if held:
            a, b = x[np.concatenate([h[0] for h in held])], y[np.concatenate([h[1] for h in held])]
            open_ = parent[a] != parent[b]
            a, b = a[open_], b[open_]
            on = population(fp[a] ^ fp[b]) <= radius
            links.append((a[on], b[on]))
            held.clear()
        if sum(len(k[0]) for k in links) >= least:  # joining goes over all parents, so few links wait for more
            _find(parent, np.concatenate([k[0] for k in links]), np.concatenate([k[1] for k in links]))
            links.clear()

    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= HELD:
            settle(LINKS)
            n = 0
    settle(1)
    return parent


def population(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp).sum(axis=1, dtype=np.int64)


def _compare(radius: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batch by batch, so that a block isn't held in both forms
        fps, items, lefts, how = [], [], [], (True, 0, 1)
        for t in batches:
            if t.num_rows:
                fps.append(np.stack([t.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WORDS)], axis=1))
                items.append(t.column("item").to_numpy().copy())
                lefts.append(t.column("left").to_numpy(zero_copy_only=False))
                how = tuple(t.column(c)[0].as_py() for c in ("own", "nth", "of"))
        fp, item, left = np.concatenate(fps), np.concatenate(items), np.concatenate(lefts)
        fps, items, lefts = [], [], []
        order = np.lexsort((item, population(fp)))
        fp, item, left = fp[order], item[order], left[order]
        own, nth, of = how
        parent = forest(fp, None if own else left, radius, nth, of)
        tied = np.flatnonzero(parent != np.arange(len(item)))
        yield pa.RecordBatch.from_pydict({"a": item[tied], "b": item[parent[tied]]})

    return f


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Identity of a row: its id (a null apart from all ids) and its text's hash."""
    return [id_key(id_col).alias("__kid"), F.xxhash64(F.col(text_col)).alias("__kh")]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, group_id, n_words, group_size, keep)`` for each row of ``docs``.

    group_id is the smallest id of the group; keep is true on one row of each group: the smallest id (nulls first),
    the first row if it repeats. Rows whose text is null or has no word are groups of their own with a null group_id, and
    are kept. Repeated rows belong to one group. Other columns, whatever their names, are ignored; an empty table gives none.
    """
    return _groups(docs, id_col, text_col, radius).drop("__kid", "__kh")


def _groups(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    spark = docs.sparkSession
    configure(spark)
    rows = docs.select(*_keys(docs, id_col, text_col), F.col(id_col).alias("__id"), fingerprint(F.col(text_col)).alias("__fp"))
    fps = stored(rows.select("__kid", "__kh", F.col("__id").alias("id"), "__fp.*"), "simhash")
    key = ["f0", "f1", "f2", "f3", "n"]
    items = stored(fps.where("n is not null").groupBy(*key).agg(F.min("id").alias("least")).withColumn("item", F.monotonically_increasing_id()), "items")
    n = items.count()
    # the larger a block, the more rows share the cost of a bucket; two blocks in a task are as large as one alone
    blocks = 1 if n <= 2 * BLOCK_MAX else -(-n // BLOCK_MAX)
    of = max(1, min(SLICES // blocks, n // BLOCK_MIN))
    tasks = [(b, o, nth) for b in range(blocks) for o in range(b, blocks) for nth in range(of)]
    # numbers that hash to partitions of their own, so that no task waits for another; any number does where one is missing
    labels = spark.range(32 * len(tasks)).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(len(tasks))).alias("p")).groupBy("p").agg(F.min("id")).collect()
    label = {r[0]: r[1] for r in labels}
    numbers = [label.get(k, 32 * len(tasks) + k) for k in range(len(tasks))]
    sides = [(b, t, nth, b == o, True) for t, (b, o, nth) in zip(numbers, tasks)] + [(o, t, nth, False, False) for t, (b, o, nth) in zip(numbers, tasks) if b != o]
    # as many rows as tasks, times two; its size decides how this joins
    partners = spark.createDataFrame(sides, "block int, task int, nth int, own boolean, left boolean")
    spread = items.select("item", *key[:WORDS], F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"))
    dealt = spread.join(partners, "block").select("task", "nth", F.lit(of).alias("of"), "own", "left", "item", *key[:WORDS])
    edges = dealt.repartition(len(tasks), "task").groupBy("task").applyInArrow(_compare(radius), "a bigint, b bigint")
    roots = components(edges)
    grouped = items.join(roots, items["item"] == roots["node"], "left").select(*key, "least", F.coalesce("root", "item").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("group_id"), F.count("*").alias("__texts"))
    named = grouped.join(ids, "root").select(*[F.col(k).alias(f"g_{k}") for k in key], "root", "group_id")
    many = fps.join(named, [fps[k] == named[f"g_{k}"] for k in key])
    w = Window.partitionBy("root")
    many = many.select("__kid", "__kh", "id", "group_id", F.col("n").alias("n_words"), F.count("*").over(w).alias("group_size"), (F.row_number().over(w.orderBy(F.asc_nulls_first("id"), "__kh")) == 1).alias("keep"))
    single = fps.where("n is null").select("__kid", "__kh", "id", F.lit(None).cast(fps.schema["id"].dataType).alias("group_id"), F.lit(0).cast("bigint").alias("n_words"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"))
    return many.unionByName(single).withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id stays, with all its columns.

    Repeated rows are one group, so one of them stays. Rows without words all stay.
    """
    kept = _groups(docs, id_col, text_col, radius).where("keep").select("__kid", "__kh", (F.col("n_words") > 0).alias("__worded")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *_keys(docs, id_col, text_col))
    same = Window.partitionBy("__kid", "__kh")
    left = rows.join(kept, ["__kid", "__kh"]).withColumn("__nth", F.row_number().over(same.orderBy("__worded")))
    return left.where("not __worded or __nth = 1").select("__row.*")
