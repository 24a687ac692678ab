"""Vectorised text kernels over the byte buffers of Arrow string arrays.

Every operator that reads text works on whole Arrow batches: no Python loop over tokens or bytes.
A *token* is a maximal run of ASCII letters, digits and bytes from 0x80 on; its hash folds ASCII and Latin-1 case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))

_LUT = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _LUT[_b] = _b
    elif 65 <= _b <= 90:
        _LUT[_b] = _b + 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse mod 2**64, grown on demand."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SEGMENT + 1)
        a, b = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def as_large(arr: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, nulls as empty strings."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    return arr if pa.types.is_large_string(arr.type) else arr.cast(pa.large_string())


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after another, and the n + 1 offsets of the strings in them."""
    arr = as_large(arr)
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def groups_by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole strings of about ``limit`` bytes; a longer string makes its own range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def stems(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash and string number of each token, and the hashes of its first ``lengths`` bytes, its own hash where it is no longer than these."""
    parts = [_segment(data, offsets, a, b, lengths) for a, b in _cuts(data, offsets)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in lengths]
    h, s, _, *p = (np.concatenate(x) for x in zip(*parts))
    return h, np.searchsorted(offsets, s, "right") - 1, p


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte and string number of each token, in order."""
    parts = [_segment(data, offsets, a, b) for a, b in _cuts(data, offsets)]
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, s, e, np.searchsorted(offsets, s, "right") - 1


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Segments that end at a separator or a string's end, so that no token is split."""
    a, n = 0, len(data)
    while a < n:
        b = a + SEGMENT
        if b >= n:
            yield a, n
            return
        back = np.flatnonzero(_LUT[data[max(a, b - 4096) : b]] == 0)
        if len(back):
            b = max(a, b - 4096) + int(back[-1]) + 1
        else:
            k = int(np.searchsorted(offsets, b))
            end = int(offsets[k]) if k < len(offsets) else n
            ahead = np.flatnonzero(_LUT[data[b:end]] == 0)
            b = b + int(ahead[0]) + 1 if len(ahead) else end
        yield a, b
        a = b


def _segment(data: np.ndarray, offsets: np.ndarray, a: int, b: int, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    raw = data[a:b]
    v = _LUT[raw]
    after = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    v[1:][after] += 32
    on = v != 0
    start, end = on.copy(), on.copy()
    start[1:] &= ~on[:-1]
    end[:-1] &= ~on[1:]
    lo, hi = np.searchsorted(offsets, a, "right"), np.searchsorted(offsets, b, "left")
    edge = offsets[lo:hi] - a
    if len(edge):
        edge = edge[edge < b - a]
        start[edge] = on[edge]
        end[edge - 1] = on[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(v * power[: len(raw)], out=sums[1:])
    upto = lambda end: mix((sums[end] - sums[s]) * inverse[s] ^ (end - s).astype(np.uint64))
    return upto(e), s + a, e + a, *[upto(np.minimum(e, s + n)) for n in lengths]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ordered, disjoint byte spans, compared byte by byte (no case folding)."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] ^ (e - s).astype(np.uint64))
        i = j
    return out


def token_hash(word: str) -> int:
    """The hash that ``tokens`` gives one word."""
    h, *_ = tokens(*bytes_of(pa.array([word])))
    return int(h[0]) if len(h) else 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)
