"""SentencePiece encoding and decoding by a max-plus scan, equal to the library's ids.

The vocabulary is of the BPE kind. A sequence of pieces is the BPE encoding of a text iff every two neighbours are what BPE
makes of their own concatenation, so encoding is a best path in the lattice of pieces whose transitions weigh 0
(neighbours agree) or minus infinity (they don't): a max-plus product, with one finite path. ``Transfer`` is such a matrix of
a chunk, from the pieces that can lie across its left boundary to those across its right one. Giant texts are split at
any character; chunks yield their matrices in parallel. The product is associative, so runs of ``FAN`` matrices are multiplied
to one, runs of these again, until a text has one; then the states at the boundaries go down the same tree, from a product's two
ends to those of its factors, and each chunk is traced back on its own between its two boundary states. No task holds more than
``FAN`` matrices of a text. Where no piece of the vocabulary joins two characters, as
before a blank, the matrix has one state, so shorter texts are a product of words, each solved once a worker.

Text goes in as it is: no normalisation but the leading blank and U+2581 for blanks; unknown characters become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm import arrowtext as at
from gritstone.llm.shared import configure, id_key, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: characters from which on a text is split into chunks, and of a chunk; matrices of one product
GIANT, CHUNK, FAN = 24_576, 4_096, 8
#: distinct words that a worker remembers; beyond it starts anew, with the same results
REMEMBER = 600_000
#: words solved in lockstep; bytes of text, or of ids, that are worked on at once
LOCKSTEP, PART = 10_000, 1 << 20
BLANK = "▁"
START = (-1, 0)
State = tuple[int, int]  # a piece and where it starts, relative to the boundary


class Pieces:
    """Vocabulary, and the two exact predicates that make the lattice: which pieces stand alone, which may be neighbours."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.text: list[str] = []
        self.score: list[float] = []
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            self.text.append(p)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[p] = i
                self.raw.append(p.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.ids))
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: nothing joins a character to a blank after it, nor anything to a line break
        self.cuts = not any(b[1] == BLANK and b[0] != BLANK or "\n" in b for b in inner) and "\n" not in self.ids
        self.width = np.array([len(x) for x in self.raw])
        self.place = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        #: True where no piece joins two ASCII characters
        self.apart = np.zeros((256, 256), bool)
        if self.cuts:
            self.apart[:128, :128] = True
            for x, y in ((x, y) for x, y in inner if max(x, y) < "\x80" or BLANK in (x, y)):
                x, y = x.replace(BLANK, " "), y.replace(BLANK, " ")
                if max(x, y) < "\x80":
                    self.apart[ord(x), ord(y)] = False
        self._table = None
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def merge(self, chars: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours, leftmost first, become one until none is in the vocabulary."""
        parts = list(chars)
        while True:
            best, k = -np.inf, -1
            for i in range(len(parts) - 1):
                t = self.ids.get(parts[i] + parts[i + 1])
                if t is not None and self.score[t] > best:
                    best, k = self.score[t], i
            if k < 0:
                return parts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def pair(self, a: int, b: int) -> bool:
        ok = self._pairs.get((a, b))
        if ok is None:
            ok = self._pairs[a, b] = self.alone(a) and self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return ok

    def alone(self, a: int) -> bool:
        ok = self._alone.get(a)
        if ok is None:
            ok = self._alone[a] = self.merge(self.text[a]) == [self.text[a]]
        return ok

    def weight(self, before: int, t: int) -> bool:
        """True for weight 0, false for minus infinity; byte pieces and the start are neighbours of all."""
        return self.alone(t) if before < 0 else self.pair(before, t)

    def run(self, s: str, a: int, b: int, before: int) -> list[int]:
        """The piece of the finite path that ends at each position from a to b of ``s`` (-2: none), after piece ``before``."""
        last = [-2] * (b - a + 1)
        last[0] = before
        ids, longest = self.ids, self.longest
        for i in range(a + 1, b + 1):
            for n in range(min(longest, i - a), 0, -1):
                t = ids.get(s[i - n : i])
                if t is not None:
                    prev = last[i - n - a]
                    if prev != -2 and self.weight(prev, t):
                        last[i - a] = t
                        break
        return last

    def back(self, last: list[int], a: int, end: int) -> list[int]:
        out, i = [], end
        while i > a:
            t = last[i - a]
            out.append(t)
            i -= len(self.text[t])
        return out[::-1]

    def known_runs(self, s: str) -> Iterator[tuple[str, bool]]:
        """Maximal runs of characters in the vocabulary and of others; nothing joins the two."""
        i = 0
        while i < len(s):
            j, known = i + 1, s[i] in self.ids
            while j < len(s) and (s[j] in self.ids) == known:
                j += 1
            yield s[i:j], known
            i = j

    def encode_many(self, words: list[str]) -> list[list[int]]:
        """``encode`` of many short words at once: the same recursion, position by position over all of them."""
        out: list[list[int]] = [[]] * len(words)
        if self._table is None:
            names = sorted(self.ids)
            h = _code_hashes("".join(names), np.array([len(x) for x in names]))
            order = np.argsort(h)
            self._table = h[order], np.array([self.ids[x] for x in names])[order]
            self._known = np.zeros(0x110000, bool)
            self._known[[ord(x) for x in self.ids if len(x) == 1]] = True
            self._length = np.array([len(x) for x in self.text])
            self._seen, self._fine = np.zeros(0, np.int64), np.zeros(0, bool)
        todo = []
        for i, w in enumerate(words):
            if len(w) <= 48:
                todo.append(i)
            else:
                out[i] = self.encode(w)
        for a in range(0, len(todo), LOCKSTEP):
            part = todo[a : a + LOCKSTEP]
            for i, ids in zip(part, self._lockstep([words[i] for i in part])):
                out[i] = self.encode(words[i]) if ids is None else ids
        return out

    def _lockstep(self, words: list[str]) -> list[list[int] | None]:
        size = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.cumsum(size) - size
        wide = int(size.max(initial=0))
        grid = np.zeros((len(words), wide), np.uint64)
        row, col = np.repeat(np.arange(len(words)), size), np.arange(len(code)) - np.repeat(start, size)
        grid[row, col] = code
        plain = np.ones(len(words), bool)
        plain[row[~self._known[code]]] = False
        power, inverse = at._powers(wide + 1)
        sums = np.zeros((len(words), wide + 1), np.uint64)
        np.cumsum(grid * power[:wide], axis=1, out=sums[:, 1:])
        hashes, ids = self._table
        last = np.full((len(words), wide + 1), -2, np.int64)
        last[:, 0] = -1
        for i in range(1, wide + 1):
            open_ = np.flatnonzero((size >= i) & plain)
            for n in range(min(self.longest, i), 0, -1):
                if not len(open_):
                    break
                prev = last[open_, i - n]
                h = at.mix((sums[open_, i] - sums[open_, i - n]) * inverse[i - n] ^ np.uint64(n))
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero((hashes[k] == h) & (prev != -2))
                if not len(hit):
                    continue
                t = ids[k[hit]]
                fine = self._weights(prev[hit], t)
                done = hit[fine]
                last[open_[done], i] = t[fine]
                rest = np.ones(len(open_), bool)
                rest[done] = False
                open_ = open_[rest]
        out: list[list[int] | None] = []
        for w, ok, path in zip(words, plain.tolist(), last.tolist()):
            out.append(self.back(path, 0, len(w)) if ok else None)
        return out

    def _weights(self, before: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = (before + 1) << 32 | t
        k = np.searchsorted(self._seen, key)
        seen = self._seen[np.minimum(k, len(self._seen) - 1)] == key if len(self._seen) else np.zeros(len(key), bool)
        if not seen.all():
            new = np.unique(key[~seen])
            fine = np.array([self.weight((x >> 32) - 1, x & 0xFFFFFFFF) for x in new.tolist()], bool)
            place = np.searchsorted(self._seen, new)
            self._seen, self._fine = np.insert(self._seen, place, new), np.insert(self._fine, place, fine)
            k = np.searchsorted(self._seen, key)
        return self._fine[k]

    def encode(self, s: str) -> list[int]:
        """Ids of ``s``, in which blanks are already U+2581."""
        out: list[int] = []
        for part, known in self.known_runs(s):
            if known:
                out += self.back(self.run(part, 0, len(part), -1), 0, len(part))
            else:
                out += [self.byte[b] for b in part.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.raw[i] for i in ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _code_hashes(s: str, size: np.ndarray) -> np.ndarray:
    """Hashes of strings of ``size`` characters, one after another in ``s``."""
    code = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    power, inverse = at._powers(int(size.max()) + 1)
    start = np.cumsum(size) - size
    col = np.arange(len(code)) - np.repeat(start, size)
    return at.mix(np.add.reduceat(code * power[col], start) ^ size.astype(np.uint64))


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


# --- giant texts: chunks, transfer matrices, scan, backtrace


class Transfer:
    """A max-plus matrix whose finite entries are 0: the pairs of boundary states that a finite path connects."""

    def __init__(self, entries: set[tuple[State, State]]) -> None:
        self.entries = entries

    def __matmul__(self, other: Transfer) -> Transfer:
        after: dict[State, list[State]] = {}
        for a, b in other.entries:
            after.setdefault(a, []).append(b)
        return Transfer({(a, c) for a, b in self.entries for c in after.get(b, ())})


class Chunk:
    """A chunk ``s[a:b]`` of a text with as much of the text around it as the longest piece has."""

    def __init__(self, v: Pieces, s: str, a: int, b: int, first: bool, last: bool) -> None:
        self.v, self.s, self.a, self.b, self.first, self.last = v, s, a, b, first, last
        ok = [c in v.ids for c in s]
        self.ok = ok
        #: positions inside at which no piece crosses and which ask nothing of their neighbours
        cut = lambda i: not ok[i - 1] or not ok[i] or (v.cuts and s[i] == BLANK and s[i - 1] != BLANK)
        inside = range(a + 1, b)
        self.head = next((i for i in inside if cut(i)), None)
        self.tail = next((i for i in reversed(inside) if cut(i)), None)
        self.free = {i for i in (a, b) if 0 < i < len(s) and cut(i)}

    def _across(self, at_: int) -> list[State]:
        """All pieces that start before position ``at_`` and end there or beyond, as (piece, start - at_)."""
        v, s = self.v, self.s
        if at_ in self.free or at_ == 0 or at_ == len(s):
            return [START]
        out = []
        for i in range(max(0, at_ - v.longest), at_):
            for j in range(at_, min(len(s), i + v.longest) + 1):
                t = v.ids.get(s[i:j])
                if t is not None and v.alone(t):
                    out.append((t, i - at_))
        return out

    def _enter(self, e: State) -> tuple[int, int]:
        return (self.a, -1) if e == START else (self.a + e[1] + len(self.v.text[e[0]]), e[0])

    def _reach(self, p: int, before: int, end: int) -> list[int]:
        """Like run, from position p on, through characters that the vocabulary lacks, which are passed as -1."""
        v, s = self.v, self.s
        last = [-2] * (end - p + 1)
        last[0] = before
        for i in range(p + 1, end + 1):
            if not self.ok[i - 1]:
                last[i - p] = -1 if last[i - 1 - p] != -2 else -2
                continue
            for n in range(min(v.longest, i - p), 0, -1):
                t = v.ids.get(s[i - n : i])
                if t is not None and last[i - n - p] != -2 and v.weight(last[i - n - p], t):
                    last[i - p] = t
                    break
        return last

    def _exits(self, p: int, before: int) -> list[tuple[State, list[int]]]:
        """States at b that paths from position p reach."""
        v, s, b = self.v, self.s, self.b
        if p >= b:
            ends = b in self.free or b == len(s) or before < 0
            return [(START if ends else (before, p - len(v.text[before]) - b), [])]
        last = self._reach(p, before, b)
        if b in self.free or b == len(s):
            return [(START, last)] if last[-1] != -2 else []
        out = []
        for t, k in self._across(b):
            i = b + k
            if i >= p and last[i - p] != -2 and v.weight(last[i - p], t):
                out.append(((t, k), last))
        return out

    def transfer(self) -> Transfer:
        entries = [START] if self.first else self._across(self.a)
        pairs: set[tuple[State, State]] = set()
        if self.head is None:
            for e in entries:
                pairs |= {(e, x) for x, _ in self._exits(*self._enter(e))}
            return Transfer(pairs)
        exits = [x for x, _ in self._exits(self.tail, -1)]
        for e in entries:
            p, before = self._enter(e)
            if p == self.head or p < self.head and self._reach(p, before, self.head)[-1] != -2:
                pairs |= {(e, x) for x in exits}
        return Transfer(pairs)

    def trace(self, e: State, x: State) -> list[int]:
        """Ids of the pieces that start in the chunk, between the states at its boundaries."""
        if self.head is None:
            return self._spell(*self._enter(e), x)
        p, before = self._enter(e)
        return self._spell(p, before, None) + self._middle() + self._spell(self.tail, -1, x)

    def _middle(self) -> list[int]:
        # between two positions at which nothing joins, word by word
        words = re.findall(f"{BLANK}*[^{BLANK}]*" if self.v.cuts else ".*", self.s[self.head : self.tail], re.S)
        return [i for w in words if w for i in word(self.v, w)]

    def _spell(self, p: int, before: int, x: State | None) -> list[int]:
        """Pieces from p to the state x at b (to the head if None), without the piece before p."""
        v, s = self.v, self.s
        end = self.head if x is None else self.b if x == START else self.b + x[1]
        out: list[int] = [] if x is None or x == START or self.b + x[1] < p else [x[0]]
        if end <= p:
            return out
        last = self._reach(p, before, end)
        i = end
        while i > p:
            if not self.ok[i - 1]:
                out = [v.byte[c] for c in s[i - 1].encode()] + out
                i -= 1
            else:
                out = [last[i - p], *out]
                i -= len(v.text[last[i - p]])
        return out


@lru_cache(maxsize=200_000)
def _word(model_id: int, w: str) -> tuple[int, ...]:
    return tuple(_models[model_id].encode(w))


_models: dict[int, Pieces] = {}


def word(v: Pieces, w: str) -> tuple[int, ...]:
    _models[id(v)] = v
    return _word(id(v), w)


def product(matrices: list[Transfer]) -> Transfer:
    out = matrices[0]
    for m in matrices[1:]:
        out = out @ m
    return out


def boundary_states(matrices: list[Transfer], first: State = START, last: State = START) -> list[State]:
    """The state of the one finite path at every boundary, from ``first`` to ``last``: what each product so far reaches, then back."""
    before = [{first}]
    for m in matrices:
        before.append({b for a, b in m.entries if a in before[-1]})
    states = [next(iter(before[-1] & {last}))]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(next(a for a, b in matrices[k].entries if b == states[-1] and a in before[k]))
    return states[::-1]


def chunks(v: Pieces, s: str, size: int) -> list[tuple[str, int, int]]:
    """Each chunk as its text with margins, and where it starts and stops in that."""
    out, edge = [], v.longest
    for a in range(0, len(s), size):
        b = min(a + size, len(s))
        lo, hi = max(0, a - edge), min(len(s), b + edge)
        out.append((s[lo:hi], a - lo, b - lo))
    return out


def encode_chunked(v: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """One text through chunks, matrices, scan and backtrace; the distributed form is ``encode_giants``."""
    s = (" " + text).replace(" ", BLANK) if text else ""
    parts = chunks(v, s, max(size, 2 * v.longest))
    made = [Chunk(v, c, a, b, k == 0, k == len(parts) - 1) for k, (c, a, b) in enumerate(parts)]
    states = boundary_states([c.transfer() for c in made])
    return [i for k, c in enumerate(made) for i in c.trace(states[k], states[k + 1])]


# --- all other texts: words, each solved once a worker


class Words:
    """The worker's memory of words already solved, by hash, and the vectorised paths from bytes to ids and back."""

    def __init__(self, v: Pieces) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start, self.size, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat, self.used = np.zeros(8192, np.int32), 0

    def _add(self, ids: list[int]) -> int:
        if self.n == len(self.start):
            self.start, self.size = np.resize(self.start, 2 * self.n), np.resize(self.size, 2 * self.n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n], self.size[self.n] = self.used, len(ids)
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def _learn(self, h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        new, where = np.unique(h, return_index=True)
        raw = data.tobytes()
        found = self.v.encode_many([raw[s[i] : e[i]].decode().replace(" ", BLANK) for i in where.tolist()])
        place = np.searchsorted(self.hash, new)
        self.hash, self.slot = np.insert(self.hash, place, new), np.insert(self.slot, place, [self._add(x) for x in found])

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, the texts' edges in them, and whether decoding gives each text back."""
        arr = at.as_large(arr)
        empty = np.asarray(pc.equal(pc.binary_length(arr), 0))
        data, off = at.bytes_of(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), arr, pa.scalar("", pa.large_string())))
        if self.n > REMEMBER:
            self.clear()
        begin = np.zeros(len(data) + 1, bool)
        begin[off] = True
        if self.v.cuts and len(data):
            begin[1:-1] |= self.v.apart[data[:-1], data[1:]]
            # before a blank also after other characters, but not after U+2581 in the text itself, a blank to the vocabulary
            literal = np.zeros(len(data), bool)
            literal[2:] = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
            begin[1:-1] |= (data[1:] == 32) & (data[:-1] != 32) & ~literal[:-1]
        edge = np.flatnonzero(begin)
        s, e = edge[:-1], edge[1:]
        h = at.span_hashes(data, s, e)
        k = np.searchsorted(self.hash, h)
        known = self.hash[np.minimum(k, len(self.hash) - 1)] == h if len(self.hash) else np.zeros(len(h), bool)
        if not known.all():
            self._learn(h[~known], data, s[~known], e[~known])
            k = np.searchsorted(self.hash, h)
        slot = self.slot[k] if len(h) else np.zeros(0, np.int64)
        doc = np.searchsorted(off, s, "right") - 1
        size = np.where(empty[doc], 0, self.size[slot])
        ids = self.flat[at.ragged(self.start[slot], size)]
        edges = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=len(arr)).astype(np.int64))])
        return ids, edges, self._lossless(ids, edges, data, off, empty)

    def _lossless(self, ids: np.ndarray, edges: np.ndarray, data: np.ndarray, off: np.ndarray, empty: np.ndarray) -> np.ndarray:
        raw, cut = self.decode(ids, edges)
        want = np.where(empty, 0, np.diff(off))
        same = np.diff(cut) == want
        if same.all() and not empty.any():
            wrong = np.flatnonzero(raw != data)
        else:
            both = same & ~empty
            a, b = at.ragged(cut[:-1][both], want[both]), at.ragged(off[:-1][both], want[both])
            wrong = b[raw[a] != data[b]]
        same[np.searchsorted(off, wrong, "right") - 1] = False
        return same

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after another, each with its leading blank, and their edges."""
        v = self.v
        width = v.width[ids]
        sums = np.concatenate([[0], np.cumsum(width)])
        return v.bytes[at.ragged(v.place[ids], width)], sums[edges]


@lru_cache(maxsize=2)
def words_of(model: str) -> Words:
    return Words(load(model))


_RESULT = "struct<ids:array<int>,lossless:boolean>"
_TYPE = pa.struct([("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])


def _list(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _parts(arr: pa.Array, size: np.ndarray) -> Iterator[pa.Array]:
    """Slices of at most ``PART`` in all, or of one row, so that what is made beside a batch doesn't follow its size."""
    upto, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PART, "right")) - 1)
        yield arr.slice(i, j - i)
        i = j


def _encoded(memory: Words, arr: pa.Array) -> pa.Array:
    out = [pa.array([], _TYPE)]
    for part in _parts(arr, pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
        ids, edges, same = memory.encode(part)
        out.append(pa.StructArray.from_arrays([_list(ids, edges), pa.array(same)], fields=list(_TYPE)))
    return pa.concat_arrays(out)


def encoded(text: Column, model: str = MODEL) -> Column:
    """Struct of a text's ids and whether they decode to the text; no ids for null and empty texts."""

    @F.arrow_udf(_RESULT)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = words_of(model)
        for arr in batches:
            yield _encoded(memory, arr)

    return f(text)


def _decoded(memory: Words, arr: pa.Array) -> pa.Array:
    out = [pa.array([], pa.string())]
    for part in _parts(arr, 4 * pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
        flat, size = pc.list_flatten(part), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(size)])
        if flat.null_count:
            there = np.concatenate([[0], np.cumsum(np.asarray(pc.is_valid(flat)).astype(np.int64))])
            flat, edges = pc.drop_null(flat), there[edges]
        number = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(number) and not (0 <= number.min() and number.max() < len(memory.v.raw)):
            raise ValueError("an id that the vocabulary lacks")
        raw, cut = memory.decode(number, edges)
        out.append(_strings(raw, cut, np.asarray(pc.is_null(part))))
    return pa.concat_arrays(out)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of ids, parts of batches at once; null for null, an error for ids that the vocabulary lacks. Null ids have no text."""

    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = words_of(model)
        for arr in batches:
            yield _decoded(memory, arr)

    return f(ids)


def _strings(raw: np.ndarray, cut: np.ndarray, none: np.ndarray) -> pa.Array:
    """Texts without their leading blank, from bytes; what is no UTF-8, as after a part of a character, is replaced."""
    begin = cut[:-1] + ((np.diff(cut) > 0) & (raw[np.minimum(cut[:-1], max(len(raw) - 1, 0))] == 32) if len(raw) else 0)
    whole = raw.tobytes()
    texts = [None if n else whole[a:b].decode("utf-8", "replace") for a, b, n in zip(begin.tolist(), cut[1:].tolist(), none.tolist())]
    return pa.array(texts, pa.string())


def _matrix(m: list[int]) -> Transfer:
    return Transfer({((m[i], m[i + 1]), (m[i + 2], m[i + 3])) for i in range(0, len(m), 4)})


def _multiply(table: pa.Table) -> pa.Table:
    """The product of a run of matrices ``(key, up, k, m)``."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    m = product([_matrix(r["m"]) for r in rows])
    return pa.table({"key": [rows[0]["key"]], "k": pa.array([rows[0]["up"]], pa.int32()), "m": pa.array([[x for p, q in m.entries for x in (*p, *q)]], pa.list_(pa.int32()))})


def _states(table: pa.Table) -> pa.Table:
    """The states at both ends of each matrix of a run ``(key, up, k, m, e)``; e has those at the ends of the run."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    e = rows[0]["e"]
    states = boundary_states([_matrix(r["m"]) for r in rows], (e[0], e[1]), (e[2], e[3]))
    out = {"key": [r["key"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32())}
    return pa.table(out | {"e": pa.array([[*states[i], *states[i + 1]] for i in range(len(rows))], pa.list_(pa.int32()))})


def encode_giants(rows: DataFrame, model: str = MODEL, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(key, ids)`` of ``rows`` (key, text): every chunk is a row of its own, in both passes, and every product of the tree between."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                parts = chunks(v, (" " + text).replace(" ", BLANK), max(size, 2 * v.longest))
                n = len(parts)
                s, a, b = zip(*parts)
                for i in range(0, n, 256):  # a giant's chunks go on in parts, whatever its length
                    j = min(i + 256, n)
                    yield pa.RecordBatch.from_pydict({"key": [key] * (j - i), "k": pa.array(range(i, j), pa.int32()), "n": pa.array([n] * (j - i), pa.int32()), "s": list(s[i:j]), "a": pa.array(a[i:j], pa.int32()), "b": pa.array(b[i:j], pa.int32())})

    def chunk(r: dict) -> Chunk:
        return Chunk(load(model), r["s"], r["a"], r["b"], r["k"] == 0, r["k"] == r["n"] - 1)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [[x for p, q in chunk(r).transfer().entries for x in (*p, *q)] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["k"], pa.array(flat, pa.list_(pa.int32()))], names=["key", "k", "m"])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [chunk(r).trace((r["e"][0], r["e"][1]), (r["e"][2], r["e"][3])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["k"], pa.array(ids, pa.list_(pa.int32()))], names=["key", "k", "ids"])

    parts = stored(rows.select("key", "text").mapInArrow(split, "key string, k int, n int, s string, a int, b int").repartition(F.col("key"), F.col("k")), "chunks")
    longest = parts.agg(F.max("n")).first()[0] or 0
    up = F.floor(F.col("k") / fan).cast("int")
    levels = [stored(parts.mapInArrow(matrices, "key string, k int, m array<int>"), "matrices")]
    width = longest
    while width > fan:
        levels.append(stored(levels[-1].withColumn("up", up).groupBy("key", "up").applyInArrow(_multiply, "key string, k int, m array<int>"), "products"))
        width = -(-width // fan)
    # at the top a text is one run, from its start to its end
    ends = F.array(*[F.lit(x) for x in (*START, *START)])
    states = levels[-1].withColumn("up", F.lit(0)).withColumn("e", ends).groupBy("key").applyInArrow(_states, "key string, k int, e array<int>")
    for level in levels[-2::-1]:
        above = states.select("key", F.col("k").alias("up"), "e")
        states = level.withColumn("up", up).join(above, ["key", "up"]).groupBy("key", "up").applyInArrow(_states, "key string, k int, e array<int>")
    traced = parts.join(states, ["key", "k"]).select("key", "k", "n", "s", "a", "b", "e").mapInArrow(traces, "key string, k int, ids array<int>")
    return traced.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), model: str = MODEL, giant: int = GIANT, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(id, *keep, ids, n_tokens, lossless)`` for every row of ``docs``. Texts of ``giant`` characters or more go through the scan.

    Null and empty texts have no ids and are lossless. A text that holds U+2581 itself isn't: it decodes to blanks. Repeated
    rows give repeated rows, null ids stay null, an empty table gives an empty one.
    """
    configure(docs.sparkSession)
    cols = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    small = docs.where(F.coalesce(F.length(text_col), F.lit(0)) < giant).select(*cols, encoded(F.col(text_col), model).alias("__e")).select(*cols, "__e.ids", "__e.lossless")
    key = F.concat_ws("-", id_key(id_col), F.hex(F.xxhash64(F.col(text_col))), F.length(text_col).cast("string"))
    big = docs.where(F.length(text_col) >= giant)
    once = big.select(key.alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    made = encode_giants(once, model, size, fan)
    back = big.withColumn("__key", key).join(made.select(F.col("key").alias("__made"), F.col("ids").alias("__ids")), F.col("__key") == F.col("__made"))
    big = back.select(*cols, F.col("__ids").alias("ids"), decoded(F.col("__ids"), model).eqNullSafe(F.col(text_col)).alias("lossless"))
    return small.unionByName(big).select(*cols, "ids", F.size("ids").alias("n_tokens"), "lossless")
