"""PII by a skip-chain conditional random field.

The labels are e-mail and IPv4 addresses, card and phone numbers. Names, postal addresses, IPv6 and numbers of documents or
accounts are outside them and never found.

Nodes are the words that can be part of personal data: those with a digit or an @, stripped of punctuation around them. Words that
join addresses or numbers to others, as in lists, URLs and assignments, are cut there; a card number in groups with blanks is one node if its check digit fits. Every
other word is O for certain, so the field falls apart into what lies between them, exactly. Node potentials come from a word's
shape and its neighbours; chain potentials link words next to each other; skip potentials link a word to the last one
before it in the document that is equal or similar (the same digits, the same address), however far, and favour one label.
Messages are passed round this loopy graph, all edges of all documents of a batch at once; each document stops when its own settle, and
those that ``ROUNDS`` don't settle go on by sweeps forth and back, each of which carries evidence over any number of repeats. Each node
takes its best marginal. Weights are fitted piece by piece on generated sentences: personal data in all their forms, and
numbers that are none.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.shared import configure

LABELS = ("O", "EMAIL", "IP", "CARD", "PHONE", "PHONE+")  # PHONE+ goes on with the phone number before it
#: rounds over whole batches, and sweeps over documents that these don't settle, at most
ROUNDS, SWEEPS, DAMPING, SETTLED = 30, 200, 0.25, 1e-4
#: generated sentences that the fit reads, and its seed
FIT_SENTENCES, SEED = 3000, 7
_WORD = re.compile(r"\S+")
_CORE = re.compile(r"[+(]?[0-9A-Za-z](?:.*[0-9A-Za-z)])?", re.S)
_CUT, _PIECE = re.compile(r"[,;:/=|&?<>\[\]{}\"']"), re.compile(r"[^,;:/=|&?<>\[\]{}\"']+")
_NUMBER, _QUAD = re.compile(r"[+\-]?\d+(?:[.,:/\-]\d+)*"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)")
_GROUPS = re.compile(r"(?<![\w.\-+])(?<!\d )(?:\d{4}[ \u00a0]\d{4}[ \u00a0]\d{4}[ \u00a0]\d{1,7}|\d{4}[ \u00a0]\d{6}[ \u00a0]\d{5})(?!\w)")
_HINTS = {
    "phone": {"phone", "tel", "telephone", "mobile", "cell", "call", "fax", "whatsapp", "telefon", "anrufen", "téléphone", "teléfono", "móvil"},
    "mail": {"email", "mail", "e-mail", "contact", "write", "correo", "courriel"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte"},
    "ip": {"ip", "host", "server", "address", "from", "login", "client"},
    "not": {"order", "invoice", "isbn", "version", "id", "no", "nr", "ref", "page", "item", "item", "sku", "ticket", "serial", "build", "v"},
}


@dataclass(frozen=True)
class Node:
    """A word that can be part of personal data: its place in characters, its core, its number among the words."""

    start: int
    stop: int
    core: str
    index: int
    before: str
    after: str


def _pieces(word: str) -> list[tuple[int, str]]:
    """A word, cut where addresses and numbers are joined to others or to names; dates, times and decimals stay whole."""
    if not _CUT.search(word) or (_NUMBER.fullmatch(word.strip("\"'<>()[]{},;:.!?")) and not _QUAD.search(word)):
        return [(0, word)]
    return [(m.start(), m.group()) for m in _PIECE.finditer(word)]


def nodes_of(text: str) -> list[Node]:
    out = []
    # a card number in groups is one node
    groups = iter([m for m in _GROUPS.finditer(text) if 13 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and luhn(d)])
    card = next(groups, None)
    prev, held = "", None
    for i, m in enumerate(_WORD.finditer(text)):
        for at_, w in _pieces(m.group()):
            start = m.start() + at_
            while card is not None and card.end() <= start:
                card = next(groups, None)
            if card is not None and card.start() < start + len(w):
                if start <= card.start():
                    if held is not None:
                        out.append(Node(*held, card.group()))
                    held = (card.start(), card.end(), card.group(), i, prev if start == card.start() else w[: card.start() - start])
                    prev = card.group()
                continue
            if held is not None:
                out.append(Node(*held, w))
                held = None
            if any(c.isdigit() for c in w) or "@" in w:
                core = _CORE.search(w)
                if core:
                    held = (start + core.start(), start + core.end(), core.group(), i, prev)
            prev = w
    if held is not None:
        out.append(Node(*held, ""))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}")
_SHAPES = [
    ("email", _EMAIL),
    ("paren3", re.compile(r"\(\d{3}\)")),
    ("3-4", re.compile(r"\d{3}[-.]\d{4}")),
    ("3-3-4", re.compile(r"\(?\d{3}[).\-]{1,2}\d{3}[-.]?\d{4}")),
    ("+cc", re.compile(r"\+\d{1,3}")),
    ("+cc-rest", re.compile(r"\+\d{1,3}[-.(]?\d[\d().\-]{5,14}")),
    ("+digits", re.compile(r"\+\d{8,15}")),
    ("digits", re.compile(r"\d+")),
    ("0digits", re.compile(r"0\d{6,12}")),
    ("groups4", re.compile(r"(?:\d{4}[- \u00a0]){3}\d{1,7}")),
    ("date", re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")),
    ("time", re.compile(r"\d{1,2}:\d\d(?::\d\d)?")),
    ("decimal", re.compile(r"\d+[.,]\d+")),
    ("alnum", re.compile(r"(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9]+")),
    ("assign", re.compile(r".*[=:/].*")),
]
_N = len(_SHAPES) + 24


def features(n: Node) -> list[int]:
    """Numbers of the features that a node has."""
    c = n.core
    out = [k for k, (_, rx) in enumerate(_SHAPES) if rx.fullmatch(c)]
    k = len(_SHAPES)
    digits = re.sub(r"\D", "", c)
    d = len(digits)
    out.append(k + (0 if d == 0 else 1 if d <= 3 else 2 if d <= 6 else 3 if d <= 9 else 4 if d <= 12 else 5 if d <= 16 else 6 if d <= 19 else 7))
    k += 8
    plain = digits == re.sub(r"[ \u00a0\-]", "", c)
    if plain and 13 <= d <= 19:
        out += [k, k + 1] if luhn(digits) else [k]
    quad = c.split(".")
    if len(quad) == 4 and all(q.isdigit() and len(q) <= 3 for q in quad):
        out.append(k + 2 if all(int(q) <= 255 for q in quad) else k + 3)
    before = re.sub(r"\W+$", "", n.before.lower())
    for j, words in enumerate(_HINTS.values()):
        if before in words or before.rsplit("=", 1)[-1].rstrip(":") in words:
            out.append(k + 4 + j)
    if re.fullmatch(r"\+\d{1,3}", re.sub(r"[^\d+]+$", "", n.before)):
        out.append(k + 9)
    if re.fullmatch(r"\(?\d{2,4}\)?", re.sub(r"[^\d)]+$", "", n.before)):
        out.append(k + 10)
    if re.match(r"\(?\d{3}\)?\b", n.after):
        out.append(k + 11)
    if re.match(r"\d{3}[-.]\d{4}", n.after):
        out.append(k + 12)
    if "@" in c:
        out.append(k + 13)
    if n.before.endswith(("$", "€", "£", "#", "v")) or n.after.lower().strip(".,") in {"%", "usd", "eur", "kg", "km"}:
        out.append(k + 14)
    return [*out, k + 15]


def address(core: str) -> tuple[int, int] | None:
    """Where the first e-mail address in a word lies. From each @ outwards, so a word is passed once, however long it is."""
    at_ = core.find("@")
    while at_ >= 0:
        start = at_
        while start and core[start - 1] in _LOCAL:
            start -= 1
        if start < at_ and (m := _DOMAIN.match(core, at_ + 1)):
            return start, m.end()
        at_ = core.find("@", at_ + 1)
    return None


def similar(core: str) -> str:
    """What equal or similar words share: the address of a mail, the digits of a long number, else the lower-case core."""
    m = address(core)
    if m:
        return core[m[0] : m[1]].lower()
    digits = re.sub(r"\D", "", core)
    if "." in core and re.fullmatch(r"[\d.]+", core):
        return core
    return digits if len(digits) >= 7 else core.lower()


# --- fit


def _generate(count: int, seed: int) -> Iterator[list[tuple[str, str]]]:
    """Sentences as (word, label) lists."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    a = lambda lo, hi: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(lo, hi)))

    def card() -> str:
        x = r.choice("3456") + d(14)
        if r.random() < 0.5:
            return x + d(1)
        return next(x + str(k) for k in range(10) if luhn(x + str(k)))

    def phone() -> list[tuple[str, str]]:
        kind = r.randrange(6)
        if kind == 0:
            return [(f"+{r.randint(1, 99)}", "PHONE"), (f"({d(3)})", "PHONE+"), (f"{d(3)}-{d(4)}", "PHONE+")]
        if kind == 1:
            return [(f"({d(3)})", "PHONE"), (f"{d(3)}-{d(4)}", "PHONE+")]
        if kind == 2:
            return [(f"{d(3)}-{d(3)}-{d(4)}", "PHONE")]
        if kind == 3:
            return [(f"+{r.randint(1, 99)}{r.choice('-.')}{d(3)}{r.choice('-.')}{d(3)}{r.choice('-.')}{d(4)}", "PHONE")]
        if kind == 4:
            return [(f"+{r.randint(1, 9)}{d(r.randint(9, 12))}", "PHONE")]
        return [(f"+{r.randint(1, 99)}", "PHONE"), (f"{d(3)}-{d(3)}-{d(4)}", "PHONE+")]

    def none() -> list[tuple[str, str]]:
        forms = [lambda: d(r.randint(1, 6)), lambda: f"{d(4)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", lambda: f"{d(2)}.{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: a(2, 5) + d(r.randint(1, 6)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{a(3, 8)}={a(2, 4)}{d(8)}", lambda: f"{d(3)}.{d(3)},{d(2)}", lambda: f"@{a(4, 9)}", lambda: d(r.randint(7, 10)), lambda: f"{r.randint(256, 999)}.{d(3)}.{d(1)}.{d(2)}", lambda: d(r.randint(20, 26)), lambda: f"({d(r.randint(1, 2))})", lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))]
        hint = [(r.choice(sorted(_HINTS["not"])), "O")] if r.random() < 0.4 else []
        return [*hint, (r.choice(forms)(), "O")]

    for _ in range(count):
        words: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 4)):
            words += [(a(1, 9) + r.choice(["", "", ".", ","]), "O") for _ in range(r.randint(0, 6))]
            kind = r.randrange(8)
            hint = lambda what: [(r.choice(sorted(_HINTS[what])) + r.choice(["", ":"]), "O")] if r.random() < 0.25 else []
            if kind == 0:
                words += hint("mail") + [(f"{a(2, 8)}{r.choice(['', '.', '_'])}{r.choice([d(2), a(2, 6)])}@{a(3, 8)}{r.choice(['', d(1)])}.{r.choice(['com', 'org', 'example.com', 'de', 'co.uk'])}", "EMAIL")]
            elif kind == 1:
                words += hint("ip") + [(".".join(str(r.randint(0, 255)) for _ in range(4)), "IP")]
            elif kind == 2:
                words += hint("card") + [(card(), "CARD")] * r.choice([1, 1, 1, 2])
            elif kind == 3:
                words += hint("phone") + phone()
            else:
                words += none()
        if r.random() < 0.3:  # what was said is said again
            words += [(a(2, 6), "O"), *r.choice([[x] for x in words if x[1] in ("EMAIL", "IP", "CARD")] or [[("x", "O")]])]
        yield words


@dataclass(frozen=True)
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # label before x label; O stands for all words that are no nodes
    skip: float


@lru_cache(maxsize=1)
def fit(sentences: int = FIT_SENTENCES, seed: int = SEED) -> Model:
    number = {x: i for i, x in enumerate(LABELS)}
    rows, gold = [], []
    chain = np.full((len(LABELS), len(LABELS)), 0.5)
    agree = [1.0, 1.0]
    for words in _generate(sentences, seed):
        labels = [number[y] for _, y in words]
        for x, y in zip([0, *labels], [*labels, 0]):
            chain[x, y] += 1
        seen: dict[str, int] = {}
        for n in nodes_of(" ".join(w for w, _ in words)):
            rows.append(features(n))
            gold.append(labels[n.index])
            key = similar(n.core)
            if key in seen:
                agree[seen[key] != labels[n.index]] += 1
            seen[key] = labels[n.index]
    x = np.zeros((len(rows), _N))
    for i, f in enumerate(rows):
        x[i, f] = 1
    y = np.eye(len(LABELS))[gold]
    w, m, v = np.zeros((_N, len(LABELS))), 0.0, 0.0
    for t in range(1, 401):  # Adam on the multinomial loss with a small L2 penalty
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - y) / len(rows) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    joint = chain / chain.sum()
    # the piece of an edge: how much likelier two labels stand together than apart
    pmi = np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)))
    pmi[0, 0] = 0.0
    return Model(w, np.clip(pmi, -6, 3), float(np.log(agree[0] / agree[1])))


# --- inference


def sweep(node: np.ndarray, msg: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, back: np.ndarray, edges: np.ndarray) -> None:
    """Pass a document's messages a -> b forth, by the order of the nodes that send them, and back, until they settle."""
    total = node.copy()
    np.add.at(total, b[edges], msg[edges])
    forth, rest = edges[a[edges] < b[edges]], edges[a[edges] > b[edges]]
    order = [*forth[np.argsort(a[forth], kind="stable")].tolist(), *rest[np.argsort(-a[rest], kind="stable")].tolist()]
    for _ in range(SWEEPS):
        moved = 0.0
        for e in order:
            out = (total[a[e]] - msg[back[e]])[:, None] + w[e]
            top = out.max(axis=0)
            new = np.log(np.exp(out - top).sum(axis=0)) + top
            new = (1 - DAMPING) * (new - new.max()) + DAMPING * msg[e]
            moved = max(moved, np.abs(new - msg[e]).max())
            total[b[e]] += new - msg[e]
            msg[e] = new
        if moved < SETTLED:
            break


def infer(model: Model, docs: list[list[Node]]) -> tuple[np.ndarray, int]:
    """Marginals of all nodes of all documents, and the rounds that the messages took."""
    flat = [n for doc in docs for n in doc]
    k = len(LABELS)
    if not flat:
        return np.zeros((0, k)), 0
    x = np.zeros((len(flat), _N))
    for i, n in enumerate(flat):
        x[i, features(n)] = 1
    node = x @ model.unary
    src, dst, pot, of = [], [], [], []
    skip = model.skip * np.eye(k)
    i = 0
    for number, doc in enumerate(docs):
        last: dict[str, int] = {}
        for j, n in enumerate(doc):
            of += [number] * (len(src) - len(of))
            if j and doc[j - 1].index == n.index - 1:
                src.append(i - 1)
                dst.append(i)
                pot.append(model.chain)
            else:
                node[i] += model.chain[0]
            if j + 1 == len(doc) or doc[j + 1].index != n.index + 1:
                node[i] += model.chain[:, 0]
            key = similar(n.core)
            if key in last:
                src.append(last[key])
                dst.append(i)
                pot.append(skip)
            last[key] = i
            i += 1
    node -= node.max(axis=1, keepdims=True)
    rounds = 0
    total = node.copy()
    if src:
        a, b = np.array([*src, *dst]), np.array([*dst, *src])
        w = np.array(pot)
        w = np.concatenate([w, w.transpose(0, 2, 1)])  # source label x target label
        back = np.concatenate([np.arange(len(src), 2 * len(src)), np.arange(len(src))])
        of += [len(docs) - 1] * (len(src) - len(of))
        of = np.array([*of, *of])
        msg = np.zeros((len(a), k))
        going = np.arange(len(a))
        while len(going) and rounds < ROUNDS:
            rounds += 1
            total = node.copy()
            np.add.at(total, b, msg)
            out = (total[a[going]] - msg[back[going]])[:, :, None] + w[going]
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new = (1 - DAMPING) * new + DAMPING * msg[going]
            moved = np.zeros(len(docs))
            np.maximum.at(moved, of[going], np.abs(new - msg[going]).max(axis=1))
            msg[going] = new
            going = going[moved[of[going]] >= SETTLED]
        for number in np.unique(of[going]):
            sweep(node, msg, a, b, w, back, np.flatnonzero(of == number))
        total = node.copy()
        np.add.at(total, b, msg)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), rounds


def entities(model: Model, texts: list[str | None]) -> list[list[dict]]:
    """Entities of each text: start, stop, label, p (the least marginal of its words)."""
    docs = [nodes_of(t) if t else [] for t in texts]
    p, _ = infer(model, docs)
    label, best = p.argmax(axis=1).tolist() if len(p) else [], p.max(axis=1).tolist() if len(p) else []
    out, i = [], 0
    for doc in docs:
        found: list[dict] = []
        prev = None
        for n in doc:
            y, q = label[i], best[i]
            i += 1
            if y == 5 and found and prev is not None and prev.index == n.index - 1 and found[-1]["label"] == "PHONE" and found[-1]["stop"] == prev.stop:
                found[-1] = found[-1] | {"stop": n.stop, "p": min(found[-1]["p"], q)}
            elif y:
                start, stop = n.start, n.stop
                if y == 1 and (m := address(n.core)):
                    start, stop = n.start + m[0], n.start + m[1]
                found.append({"start": start, "stop": stop, "label": LABELS[min(y, 4)], "p": q})
            prev = n
        out.append(found)
    return out


_KIND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("p", pa.float64())]))


def personal(text: Column, model: Model) -> Column:
    """Array of a text's entities; empty for null and empty texts."""

    @F.arrow_udf("array<struct<start:int,stop:int,label:string,p:double>>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(entities(model, arr.to_pylist()), _KIND)

    return f(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, stop, label, entity, p)``: a row an entity, places in characters.

    Repeated rows give repeated rows; null ids stay null; null and empty texts give none; long texts, and long words, are read
    whole, in time linear in their length; of labels alike in probability the first in ``LABELS`` is taken. An empty table gives none.
    """
    configure(docs.sparkSession)
    model = fit()
    # no node is possible without a digit or an @ (any decimal digit, as in Python): decided before the text goes to Python
    likely = docs.where(F.col(text_col).rlike(r"[\p{Nd}\p{No}@]")).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    hits = likely.select("__id", "__t", F.explode(personal(F.col("__t"), model)).alias("__e"))
    return hits.select(F.col("__id").alias(id_col), "__e.start", "__e.stop", "__e.label", F.substring(F.col("__t"), F.col("__e.start") + 1, F.col("__e.stop") - F.col("__e.start")).alias("entity"), F.round("__e.p", 6).alias("p"))
