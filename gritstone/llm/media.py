"""Copies of images, cropped or edited, by local descriptors.

Corners (Harris) are found on a pyramid of scales; each has the direction of its patch's intensity centroid, and 256 binary tests
of smoothed intensities turned by that direction. Descriptors match if they differ in at most ``RADIUS`` bits; a match
implies a similarity transform, and two images are copies if enough matches agree with the transform of one of them.

Image pairs are found by a Hamming-table join. A feature is a corner with one of its ``NEAR`` nearest corners on its level;
``TABLES`` tables key it by ``KEY`` bits of either descriptor, drawn at random for each table, and by how the two lie to
each other. So one meeting in a table is two matches already, and keys are selective enough that meetings by chance stay rare
as tables grow. Two meetings whose transforms agree make a candidate, which is compared by all corners of either image.
Only keys and places are shuffled, once a table.

A key that more than ``HOT`` features share is joined in blocks of about so many, each pair of blocks by itself: all its features
meet, as under any other key, in tasks of bounded size. Meetings grow with the square of the features that share a key.
Images equal byte by byte are collapsed before, so copies of one image are linear in their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.shared import configure, stored

LEVELS, STEP = 3, 1.5
PATCH = 9  # radius of what a descriptor sees, on its level
APART = 4  # corners are the strongest within this radius
#: part of an image's strongest corner response that a corner needs
CONTRAST = 0.05
#: corners that a corner makes features with, how far they may be on their level, tables, and bits of either descriptor in a key
NEAR, REACH, TABLES, KEY = 4, 40.0, 3, 13
#: parts into which the direction, and the turn, of a feature's second corner are divided; ratio of its distances
SECTORS, RING = 12, 1.4
RADIUS = 40
#: features of a key that are joined in one task, about; those of a larger key are dealt to blocks
HOT = 2000
#: features that share a cell of the search for hot keys, on average, and from how many on a cell is searched
CELL, FULL = 400, 4000
#: rows that a partition of features, or of meetings, has, about: what a task sorts in memory; images whose features are made at once
ROWS, IMAGES = 400_000, 250
#: matches that agree, and how far in pixels they may be off
MIN_INLIERS, TOLERANCE = 6, 3.0
TURNS = 24
STACK = 16  # images of 96 x 96 that are described at once


def _pattern() -> np.ndarray:
    """256 tests (x y x y) inside the disc, so that no turn leaves the patch.

    Patches are turned to grow brighter along x, so a test whose ends lie apart in x says little: theirs lie apart in y.
    """
    rng, out = np.random.default_rng(256), []
    while len(out) < 256:
        a, b = rng.uniform(-PATCH + 1, PATCH - 1, (2, 2))
        if max(np.hypot(*a), np.hypot(*b)) <= PATCH - 1 and abs(a[0] - b[0]) <= 3 <= abs(a[1] - b[1]):
            out.append(np.rint(np.concatenate([a, b]) * 0.99))
    return np.array(out)


_xy = _pattern()
_ANGLES = 2 * np.pi * np.arange(TURNS) / TURNS
_COS, _SIN = np.round(np.cos(_ANGLES), 12), np.round(np.sin(_ANGLES), 12)
#: (turns, 256, 4): both points of each test, x y x y
_TESTS = np.rint(
    np.stack([_COS[:, None] * _xy[:, 0] - _SIN[:, None] * _xy[:, 1], _SIN[:, None] * _xy[:, 0] + _COS[:, None] * _xy[:, 1], _COS[:, None] * _xy[:, 2] - _SIN[:, None] * _xy[:, 3], _SIN[:, None] * _xy[:, 2] + _COS[:, None] * _xy[:, 3]], axis=2)
).astype(np.int64)
_DY, _DX = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = (_DX**2 + _DY**2 <= PATCH**2).ravel()
_DX, _DY = _DX.ravel()[_DISC], _DY.ravel()[_DISC]


def _masks() -> np.ndarray:
    """The bits of a feature's first and second descriptor that each table is keyed by."""
    rng, out = np.random.default_rng(40), np.zeros((TABLES, 2, 256), np.uint8)
    for mask in out.reshape(-1, 256):
        mask[rng.choice(256, KEY, replace=False)] = 1
    return np.packbits(out, axis=2).view(np.uint64)


_MASKS = _masks()
#: odd factors that make a key of masked words
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM image with values of one byte; None for anything else."""
    if not image or image[:2] != b"P5":
        return None
    head, i = [], 2
    while len(head) < 3:
        while i < len(image) and image[i : i + 1].isspace():
            i += 1
        if image[i : i + 1] == b"#":
            i = image.find(b"\n", i) if image.find(b"\n", i) >= 0 else len(image)
            continue
        j = i
        while j < len(image) and image[j : j + 1].isdigit():
            j += 1
        if i == j:
            return None
        head.append(int(image[i:j]))
        i = j
    w, h, top = head
    if not (0 < top < 256) or len(image) - i - 1 < w * h or not w * h:
        return None
    return np.frombuffer(image, np.uint8, w * h, i + 1).reshape(h, w)


def encode(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, the border repeated, of a stack (n, h, w)."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge")
    p[:, 0], p[:, :, 0] = 0, 0
    s = p.cumsum(axis=1).cumsum(axis=2)
    k = 2 * r + 1
    return (s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]) / (k * k)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, of a stack (n, h, w); pixel centres at halves."""
    y = np.clip((np.arange(h) + 0.5) * x.shape[1] / h - 0.5, 0, x.shape[1] - 1)
    z = np.clip((np.arange(w) + 0.5) * x.shape[2] / w - 0.5, 0, x.shape[2] - 1)
    y0, z0 = y.astype(int), z.astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(z0 + 1, x.shape[2] - 1)
    fy, fz = (y - y0)[:, None], z - z0
    a, b = x[:, y0], x[:, y1]
    return (a[:, :, z0] * (1 - fz) + a[:, :, z1] * fz) * (1 - fy) + (b[:, :, z0] * (1 - fz) + b[:, :, z1] * fz) * fy


def _slide(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    """The maximum over 2 APART + 1 neighbours along an axis of a padded stack."""
    part = lambda d: x[:, d : d + n] if axis == 1 else x[:, :, d : d + n]
    out = part(0).copy()
    for d in range(1, 2 * APART + 1):
        np.maximum(out, part(d), out=out)
    return out


def describe(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image number, x, y, scale, turn and (n, 4) descriptor of each corner of a stack of grey images of one size."""
    out = []
    for level in range(LEVELS):
        scale = STEP**level
        h, w = int(images.shape[1] / scale), int(images.shape[2] / scale)
        if min(h, w) < 2 * PATCH + 3:
            break
        x = images.astype(np.float64) if not level else resize(_box(images.astype(np.float64), level), h, w)
        smooth = _box(x, 1)
        gy, gx = np.zeros_like(x), np.zeros_like(x)
        gy[:, 1:-1], gx[:, :, 1:-1] = smooth[:, 2:] - smooth[:, :-2], smooth[:, :, 2:] - smooth[:, :, :-2]
        a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
        response = a * c - b * b - 0.05 * (a + c) ** 2
        inner = response[:, PATCH:-PATCH, PATCH:-PATCH]
        # the maximum over a square, rows first
        top = np.full((len(x), h + 2 * APART, w), -np.inf)
        top[:, APART:-APART] = response
        top = _slide(top, h, 1)
        wide = np.full((len(x), h, w + 2 * APART), -np.inf)
        wide[:, :, APART:-APART] = top
        top = _slide(wide, w, 2)
        need = CONTRAST * response.max(axis=(1, 2))[:, None, None]
        i, y, z = np.nonzero((inner >= top[:, PATCH:-PATCH, PATCH:-PATCH]) & (inner > np.maximum(need, 1e-6)))
        if not len(i):
            continue
        y, z = y + PATCH, z + PATCH
        patch = smooth[i[:, None], y[:, None] + _DY, z[:, None] + _DX]
        turn = np.rint(np.arctan2((patch * _DY).sum(axis=1), (patch * _DX).sum(axis=1)) / (2 * np.pi / TURNS)).astype(int) % TURNS
        t = _TESTS[turn]
        blurred = _box(smooth, 1)
        one = blurred[i[:, None], y[:, None] + t[:, :, 1], z[:, None] + t[:, :, 0]]
        two = blurred[i[:, None], y[:, None] + t[:, :, 3], z[:, None] + t[:, :, 2]]
        bits = np.packbits(one < two - 1e-9, axis=1).view(np.int64)
        out.append((i, (z + 0.5) * images.shape[2] / w, (y + 0.5) * images.shape[1] / h, np.full(len(i), scale), turn, bits))
    if not out:
        return (np.zeros(0, int), *(np.zeros(0) for _ in range(3)), np.zeros(0, int), np.zeros((0, 4), np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def described(rows: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """``describe`` of encoded images of any sizes: row number and so on, in order of the rows."""
    by: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, raw in enumerate(rows):
        if (x := decode(raw)) is not None:
            by.setdefault(x.shape, []).append((i, x))
    found = []
    for group in by.values():
        size = max(1, STACK * 96 * 96 // group[0][1].size)
        for a in range(0, len(group), size):
            part = group[a : a + size]
            i, *rest = describe(np.stack([x for _, x in part]))
            found.append((np.array([k for k, _ in part])[i], *rest))
    if not found:
        return describe(np.zeros((0, 1, 1)))
    cols = [np.concatenate(c) for c in zip(*found)]
    by_row = np.lexsort((cols[1], cols[2], cols[3], cols[0]))
    return tuple(c[by_row] for c in cols)


_SEEN = "struct<h:string,c:array<struct<x:float,y:float,s:float,turn:int,d0:bigint,d1:bigint,d2:bigint,d3:bigint>>>"


def seen(image: Column) -> Column:
    """An image's SHA-256 and the array of its corners; null for null, no corners for what is no image and for images without.

    Both come from one function that takes the image alone and no iterator, so that a function that makes the image is chained to
    it: one worker a task then does both, and such images don't pass through the JVM.
    """

    @F.arrow_udf(_SEEN)
    def f(arr: pa.Array) -> pa.Array:
        rows = arr.to_pylist()
        i, x, y, s, turn, d = described(rows)
        cols = [pa.array(x, pa.float32()), pa.array(y, pa.float32()), pa.array(s, pa.float32()), pa.array(turn, pa.int32()), *[pa.array(d[:, k], pa.int64()) for k in range(4)]]
        items = pa.StructArray.from_arrays(cols, names=["x", "y", "s", "turn", "d0", "d1", "d2", "d3"])
        h = pa.array([None if r is None else hashlib.sha256(r).hexdigest() for r in rows], pa.string())
        return pa.StructArray.from_arrays([h, pa.ListArray.from_arrays(np.searchsorted(i, np.arange(len(arr) + 1)).astype(np.int32), items)], names=["h", "c"], mask=pc.is_null(arr))

    return f(image)


def consensus(m: np.ndarray, tolerance: float = TOLERANCE, least: int = 0) -> tuple[int, float, float, float, float]:
    """Inliers, scale, rotation (degrees), dx and dy of the best transform a -> b of matches (x, y, s, turn of a, then of b).

    No inliers at once where no transform can have ``least``.
    """
    scale = m[:, 6] / m[:, 2]
    angle = (m[:, 7] - m[:, 3]) * (2 * np.pi / TURNS)
    c, s = scale * np.cos(angle), scale * np.sin(angle)
    dx, dy = m[:, 4] - (c * m[:, 0] - s * m[:, 1]), m[:, 5] - (s * m[:, 0] + c * m[:, 1])

    def near(r: np.ndarray) -> np.ndarray:
        """Which matches agree with the transforms of the matches r."""
        px = c[r, None] * m[:, 0] - s[r, None] * m[:, 1] + dx[r, None]
        py = s[r, None] * m[:, 0] + c[r, None] * m[:, 1] + dy[r, None]
        on = np.hypot(px - m[:, 4], py - m[:, 5]) <= tolerance * np.maximum(m[:, 6], 1.0)
        turns = np.abs((m[None, :, 7] - m[None, :, 3] - (m[r, 7] - m[r, 3])[:, None] + TURNS / 2) % TURNS - TURNS / 2) <= 1
        return on & turns & (np.abs(np.log(scale[None] / scale[r, None])) < 0.3)

    # in parts, so that memory is linear in the matches
    count = np.concatenate([near(np.arange(a, min(a + 128, len(m)))).sum(axis=1) for a in range(0, len(m), 128)])
    if count.max() < least:
        return 0, 1.0, 0.0, 0.0, 0.0
    # a corner counts once, on either side, wherever it matches several
    best, at_ = 0, 0
    for i in np.argsort(-count, kind="stable"):
        if count[i] <= best:
            break
        on = near(np.array([i]))[0]
        n = min(len(np.unique(m[on][:, :2].round(1), axis=0)), len(np.unique(m[on][:, 4:6].round(1), axis=0)))
        if n > best:
            best, at_ = n, i
    turn = (m[at_, 7] - m[at_, 3]) % TURNS
    return best, float(scale[at_]), float(360.0 / TURNS * turn), float(dx[at_]), float(dy[at_])


def neighbours(x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Corners of one level of an image with their ``NEAR`` nearest others within reach, of equally near ones those before."""
    by_y = np.argsort(y, kind="stable")
    ys, one, two = y[by_y], [], []
    for a in range(0, len(y), 256):
        rows = by_y[a : a + 256]
        lo, hi = np.searchsorted(ys, y[rows[0]] - reach), np.searchsorted(ys, y[rows[-1]] + reach, "right")
        near = np.sort(by_y[lo:hi])
        off = np.hypot(x[rows][:, None] - x[near], y[rows][:, None] - y[near])
        off[(off > reach) | (rows[:, None] == near)] = np.inf
        first = np.argsort(off, axis=1, kind="stable")[:, :NEAR]
        on = np.isfinite(np.take_along_axis(off, first, axis=1))
        one.append(np.repeat(rows, on.sum(axis=1)))
        two.append(near[first[on]])
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, int), np.zeros(0, int))


def features(image: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First corners of all features of corners in order of image and level, the features' places, and the (tables, features) keys.

    ``place`` is (x, y, scale, turn); a feature lies between its corners, with the scale and turn of the first.
    """
    edge = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (place[1:, 2] != place[:-1, 2]), [True]])) if len(image) else np.zeros(1, int)
    both = [(a + i, a + j) for a, b in zip(edge[:-1], edge[1:]) for i, j in [neighbours(place[a:b, 0], place[a:b, 1], REACH * place[a, 2])]]
    if not both:
        return np.zeros(0, int), np.zeros((0, 4)), np.zeros((TABLES, 0), np.int64)
    one, two = (np.concatenate(k) for k in zip(*both))
    dx, dy, turn = place[two, 0] - place[one, 0], place[two, 1] - place[one, 1], place[one, 3]
    way = np.floor((np.arctan2(dy, dx) / (2 * np.pi) - turn / TURNS) % 1 * SECTORS).astype(np.uint64)
    ring = (np.floor(np.log(np.hypot(dx, dy) / place[one, 2]) / np.log(RING)) + 64).astype(np.uint64)
    lie = (way * np.uint64(128) + ring) * np.uint64(64) + ((place[two, 3] - turn) % TURNS * SECTORS // TURNS).astype(np.uint64)
    keys = np.empty((TABLES, len(one)), np.uint64)
    for t, (m, n) in enumerate(_MASKS):
        h = ((bits[one] & m) * _ODD).sum(axis=1) + ((bits[two] & n) * _ODD[::-1]).sum(axis=1) * np.uint64(3)
        h = (h ^ (h >> np.uint64(31)) ^ (lie << np.uint64(8)) ^ np.uint64(t)) * _ODD[0]
        # 48 bits: shorter to shuffle, and still far more than there are features
        keys[t] = (h ^ (h >> np.uint64(29))) * _ODD[3] >> np.uint64(16)
    between = place[one].copy()
    between[:, :2] = (between[:, :2] + place[two, :2]) / 2
    return one, between, keys.view(np.int64)


def arrays(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image number, place and descriptor of all corners of a column of them."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    flat, size = pc.list_flatten(c), pc.list_value_length(c).to_numpy()
    place = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y", "s", "turn")], axis=1)
    bits = np.stack([flat.field(f"d{k}").to_numpy(zero_copy_only=False) for k in range(4)], axis=1).astype(np.int64).view(np.uint64)
    return np.repeat(np.arange(len(size)), size), place, bits


#: pixels after which places start anew in ``pack``: differences of places are right up to half of it
TURN = 1 << 13


def pack(place: np.ndarray) -> np.ndarray:
    """A place in 35 bits: x and y in whole pixels, the level, the turn."""
    level = np.rint(np.log(place[:, 2]) / np.log(STEP)).astype(np.int64)
    x, y = (np.rint(place[:, k]).astype(np.int64) % TURN for k in (0, 1))
    return ((y << 13 | x) << 3 | level) << 5 | place[:, 3].astype(np.int64)


def unpack(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """x and y in one image and in the other, scale, turn and the level of the second, of ``meeting``."""
    spot = lambda k: (t >> k & TURN - 1).astype(float)
    one, two = t >> 5 & 7, t >> 8 & 7
    return spot(11), spot(24), spot(37), spot(50), STEP ** (two - one).astype(float), (t & 31).astype(float), STEP ** two.astype(float)


def meeting(p: Column, q: Column) -> Column:
    """Two packed places in one number: both spots, both levels, the turn from the first to the second."""
    p, q = p.cast("bigint"), q.cast("bigint")  # a literal may be narrower, and shifts wrap
    spot = lambda x: F.shiftright(x, 8)
    level = lambda x: F.shiftright(x, 5).bitwiseAND(7)
    turn = F.pmod(q.bitwiseAND(31) - p.bitwiseAND(31), F.lit(TURNS))
    return F.shiftleft(spot(q), 37).bitwiseOR(F.shiftleft(spot(p), 11)).bitwiseOR(F.shiftleft(level(q), 8)).bitwiseOR(F.shiftleft(level(p), 5)).bitwiseOR(turn).alias("t")


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every feature of ``(img, c)`` in every table, as ``(key, img, place)``."""
    for batch in (b.slice(a, IMAGES) for b in batches for a in range(0, b.num_rows, IMAGES)):
        image, place, bits = arrays(batch["c"])
        one, between, keys = features(image, place, bits)
        img, at_ = batch["img"].to_numpy()[image[one]], pack(between)
        for row in keys:
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(img), pa.array(at_)], names=["key", "img", "place"])


def likely(pair: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The pairs, numbered in order, of which two meetings of different features agree within twice the tolerance."""
    ax, ay, bx, by, scale, turn, size = unpack(t)
    c, s = scale * np.cos(turn * (2 * np.pi / TURNS)), scale * np.sin(turn * (2 * np.pi / TURNS))
    off = lambda z, k, l: (z[l] - z[k] + TURN / 2) % TURN - TURN / 2
    out, k, step = [np.zeros(0, np.int64)], np.arange(len(pair)), 0
    while len(k):
        step += 1
        k = k[k + step < len(pair)]
        k = k[pair[k] == pair[k + step]]
        l = k + step
        x, y, u, v = off(ax, k, l), off(ay, k, l), off(bx, k, l), off(by, k, l)
        miss = np.minimum(*(np.hypot(c[m] * x - s[m] * y - u, s[m] * x + c[m] * y - v) for m in (k, l)))
        on = (miss <= 2 * TOLERANCE * np.maximum(np.maximum(size[k], size[l]), 1.0)) & (np.abs((turn[l] - turn[k] + TURNS / 2) % TURNS - TURNS / 2) <= 2) & (np.abs(np.log(scale[l] / scale[k])) < 0.3) & ((x != 0) | (y != 0)) & ((u != 0) | (v != 0))
        out.append(np.unique(pair[k[on]]))
        # a pair that has been found needs no more
        k = k[~np.isin(pair[k], out[-1])]
    return np.unique(np.concatenate(out))


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The image pairs ``(i, j)``, of rows ``(i, j, t)`` in their order, that are likely: one pair's rows are held at a time, besides a batch."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        i, j, t = rows
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(i) else np.zeros(0, int)
        n = likely(np.repeat(np.arange(len(first)), np.diff([*first, len(i)])), t)
        return pa.RecordBatch.from_arrays([pa.array(i[first[n]]), pa.array(j[first[n]])], names=["i", "j"])

    for batch in batches:
        rows = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("i", "j", "t"))]
        if not len(rows[0]):
            continue
        other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        held = [r[last:] for r in rows]
        if last:
            yield found([r[:last] for r in rows])
    yield found(held)


_COPY = "struct<matches:int,inliers:int,scale:double,rotation:double,dx:double,dy:double>"


def compared(one: Column, two: Column, radius: int, min_inliers: int) -> Column:
    """What two images' corners have in common, all of one with all of the other; null if too few matches agree."""

    def f(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = ("matches", "inliers", "scale", "rotation", "dx", "dy")
        kind = pa.struct([*((k, pa.int32()) for k in names[:2]), *((k, pa.float64()) for k in names[2:])])
        for a, b in batches:
            (ga, pa_, da), (gb, pb, db) = arrays(a), arrays(b)
            out: list[dict | None] = []
            for n in range(len(a)):
                x, y = slice(*np.searchsorted(ga, (n, n + 1))), slice(*np.searchsorted(gb, (n, n + 1)))
                u, v = [], []
                for r in range(x.start, x.stop, 1024):  # in parts, however many corners there are
                    part = da[r : min(r + 1024, x.stop)]
                    off = np.zeros((len(part), y.stop - y.start), np.uint16)
                    for k in range(4):
                        off += np.bitwise_count(part[:, k, None] ^ db[None, y, k])
                    i, j = np.nonzero(off <= radius)
                    u.append(i + r)
                    v.append(j + y.start)
                u, v = (np.concatenate(z) if z else np.zeros(0, int) for z in (u, v))
                c = consensus(np.concatenate([pa_[u], pb[v]], axis=1), least=min_inliers) if len(u) >= min_inliers else (0,)
                out.append(dict(zip(names, (len(u), *map(float, c)))) | {"inliers": c[0]} if c[0] >= min_inliers else None)
            yield pa.array(out, kind)

    # else the optimizer would have it run twice, in a worker more, once for a filter on its result
    return F.arrow_udf(f, _COPY).asNondeterministic()(one, two)


def candidates(once: DataFrame) -> DataFrame:
    """``(i, j)``, i < j: images of ``(img, c)`` of which two features meet in tables and agree."""
    spark = once.sparkSession
    features_ = once.select("img", "c").mapInArrow(keyed, "key bigint, img bigint, place bigint")
    # hot keys, exactly: cells of keys are counted first, which the maps do nearly alone, and then the keys of full cells
    rows = (once.agg(F.sum(F.size("c"))).first()[0] or 0) * NEAR * TABLES
    cells = max(1, rows // CELL)
    cell = F.pmod(F.col("key"), F.lit(cells))
    full = stored(features_.groupBy(cell.alias("cell")).count().where(F.col("count") > FULL).select("cell"), "cells")
    # the joins' tasks hold both sides sorted, so there are as many as the features ask for, whatever the session's number
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    one, two = (features_.repartition(parts, "key").select("key", F.col("img").alias(i), F.col("place").alias(p)) for i, p in (("i", "p"), ("j", "q")))
    if full.isEmpty():
        met = one.join(two, "key").where("i < j").select("i", "j", meeting(F.col("p"), F.col("q")))
    else:
        hot = stored(features_.withColumn("cell", cell).join(full, "cell").groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("n")), "hot")
        cold = features_.join(hot, "key", "left_anti").repartition(parts, "key")
        one, two = (cold.select("key", F.col("img").alias(i), F.col("place").alias(p)) for i, p in (("i", "p"), ("j", "q")))
        # a hot key's features in n blocks, each pair of blocks (x, y), x <= y, a group of its own
        warm = features_.join(hot, "key").withColumn("x", F.pmod(F.xxhash64("img", "place"), F.col("n")).cast("int"))
        left = warm.select("key", F.col("img").alias("i"), F.col("place").alias("p"), "x", F.explode(F.sequence("x", F.col("n") - 1)).alias("y"))
        right = warm.select("key", F.col("img").alias("j"), F.col("place").alias("q"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), "x")).alias("x"))
        within = left.join(right, ["key", "x", "y"]).where("i < j or i > j and x < y")
        swap = F.col("i") > F.col("j")
        within = within.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(swap, meeting(F.col("q"), F.col("p"))).otherwise(meeting(F.col("p"), F.col("q"))).alias("t"))
        met = one.join(two, "key").where("i < j").select("i", "j", meeting(F.col("p"), F.col("q"))).unionByName(within)
    return met.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "t").mapInArrow(agreeing, "i bigint, j bigint")


def copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", radius: int = RADIUS, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """``(a, b, matches, inliers, scale, rotation, dx, dy)``: pairs of images of which one is a copy of the other, a < b.

    The transform takes places in a to places in b. Images equal byte by byte are paired with the least id among them alone,
    as identical (null matches and inliers), and only that one is compared with others. Rows with a null id or image are left
    out, repeated rows count once, and of an id with several images the one with the least hash is compared; what is no PGM image,
    and what has no corners, is paired only with what is identical to it. An empty table gives none. Other columns, whatever their names, are ignored.
    """
    configure(images.sparkSession)
    # nulls are left out of what is stored, as a filter before that would have the images made twice
    rows = images.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), seen(F.col(image_col)).alias("s"))
    all_ = stored(rows.select("id", "s.h", "s.c", F.monotonically_increasing_id().alias("img")), "corners").where("h is not null")
    names = all_.select("id", "h", "img")
    least = names.groupBy("h").agg(F.min(F.struct("id", "img")).alias("m"), F.max("id").alias("z")).select("h", F.col("m.id").alias("a"), "m.img", "z")
    same = names.select("id", "h").distinct().join(least.where("a < z"), "h").where("id > a").select("a", F.col("id").alias("b"))
    # what is compared: one row of each image that is the first of its id; the others are few, as a rule, and taken out
    first = least.groupBy("a").agg(F.min_by("img", "h").alias("img"))
    repeated = stored(names.join(first.select("img"), "img", "left_anti").select("img"), "repeated")  # stored, so that its size is known to the joins
    once = all_.where(F.size("c") >= min_inliers).join(repeated, "img", "left_anti")
    found = stored(candidates(once), "candidates")
    # each pair's two images, by one join; then the corners of both side by side
    sides = found.select(F.explode(F.array(F.struct("i", "j", F.col("i").alias("img")), F.struct("i", "j", F.col("j").alias("img")))).alias("s")).select("s.*")
    # only the corners of images in pairs move
    wanted = once.select("img", "id", "c").join(stored(sides.select("img").distinct(), "paired"), "img", "left_semi")
    with_corners = sides.join(wanted, "img").groupBy("i", "j").agg(F.min_by(F.struct("id", "c"), "id").alias("x"), F.max_by(F.struct("id", "c"), "id").alias("y"))
    near = with_corners.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), compared(F.col("x.c"), F.col("y.c"), radius, min_inliers).alias("m")).where("m is not null").select("a", "b", "m.*")
    null = lambda kind: F.lit(None).cast(kind)
    equal = same.select("a", "b", null("int").alias("matches"), null("int").alias("inliers"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("rotation"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return near.select("a", "b", "matches", "inliers", F.round("scale", 6).alias("scale"), F.round("rotation", 6).alias("rotation"), F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy")).unionByName(equal)


# --- images for tables that have none


SIDE = 96


def picture(vector: np.ndarray, edit: int = 0) -> np.ndarray:
    """A grey picture of a vector: its values as a coarse relief, finer relief drawn from their bits; ``edit`` crops or edits it.

    0 leaves it, 1 crops, 2 brightens and crops, 3 turns by 90 degrees, 4 adds noise, 5 pastes a patch over it.
    """
    v = np.asarray(vector, np.float32)
    rng = np.random.default_rng(np.frombuffer(v.tobytes(), np.uint8))
    side = max(1, int(np.sqrt(len(v))))
    coarse = resize(v[: side * side].reshape(1, side, side).astype(float), SIDE, SIDE)[0]
    fine = [resize(rng.normal(size=(1, n, n)), SIDE, SIDE)[0] for n in (12, 24)]
    x = coarse / (coarse.std() + 1e-9) * 0.5 + fine[0] + 0.7 * fine[1]
    grey = np.clip(128 + 40 * x, 0, 255).astype(np.uint8)
    if edit in (1, 2):
        a, b = rng.integers(0, 20, 2)
        grey = grey[a : a + 76, b : b + 76]
    if edit == 2:
        grey = np.clip(grey * 0.8 + 30, 0, 255).astype(np.uint8)
    elif edit == 3:
        grey = np.rot90(grey)
    elif edit == 4:
        grey = np.clip(grey + np.rint(rng.normal(0, 1.5, grey.shape)), 0, 255).astype(np.uint8)
    elif edit == 5:
        grey = grey.copy()
        grey[10:40, 30:60] = 200
    return grey


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(image_id, image)``: a picture of every row, as no table of the lake has images.

    About every fourth row (by its id's hash) shows its predecessor's vector, cropped or edited. Null and empty vectors give null.
    """
    rows = vectors.select(F.col(id_col).alias("image_id"), F.col(vector_col).cast("array<float>").alias("v"))
    before = rows.select((F.col("image_id") + 1).alias("image_id"), F.col("v").alias("w")).dropDuplicates(["image_id"])
    h = F.xxhash64("image_id")
    both = rows.join(before, "image_id", "left").select("image_id", F.when((F.pmod(h, F.lit(4)) == 0) & F.col("w").isNotNull(), F.col("w")).otherwise(F.col("v")).alias("v"), F.when((F.pmod(h, F.lit(4)) == 0) & F.col("w").isNotNull(), F.pmod(F.shiftright(h, 8), F.lit(6)).cast("int")).otherwise(F.lit(0)).alias("e"))

    @F.arrow_udf("binary")
    def draw(v: pa.Array, e: pa.Array) -> pa.Array:
        return pa.array([encode(picture(np.array(x, np.float32), k)) if x and None not in x else None for x, k in zip(v.to_pylist(), e.to_pylist())], pa.binary())

    return both.select("image_id", draw(F.col("v"), F.col("e")).alias("image"))
