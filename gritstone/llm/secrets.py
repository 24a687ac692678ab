"""Secret scan by assignments: name-literal pairs, constants followed through names, literals scored by what they are assigned to.

A small lexer reads the syntax that source and configuration files share: ``name = "x"``, ``name: x``, ``"name": "x"``,
``name := x``, ``name=x`` (also as an argument, after export or in a URL's query), ``["name"] = x``, ``<name>x</name>``,
``key="name" value="x"`` in a tag, ``name: |`` with an indented block, ``a, name = x, y``, and user:password in a URL. A right
side is a literal (quoted once or three times), another name, a list of these or a sum of them; a sum through names is joined
where each name has one value. Names are resolved through each other to a fixed point, in time linear in what they hold, so a
literal counts under every name that it reaches. Literals in no assignment count if their form is one of the published key
formats. No form is cut by its length: repeats in the lexer are possessive, so that a scan stays linear.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.shared import configure

THRESHOLD = 4.0
_STRONG = {"password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "apikey", "credential", "credentials", "bearer", "authorization", "passcode", "secretkey", "accesskey", "privatekey", "authtoken"}
_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("auth", "key"), ("encryption", "key"), ("signing", "key"), ("account", "key"), ("client", "secret")}
_WEAK = {"key", "auth", "login", "cert", "salt", "signature", "session", "cookie", "pin"}
_AGAINST = {"public", "count", "length", "size", "type", "name", "path", "file", "dir", "url", "uri", "max", "min", "limit", "field", "label", "hint", "prompt", "policy", "expires", "expiry", "ttl", "header", "tokenizer", "tokens", "column", "primary", "foreign", "sort"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|null|none|true|false|undefined|todo|tbd|n/?a|example.*|sample.*|dummy.*|test|your[-_ ].*|change[-_ ]?me.*|redacted|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?%?|\$\w+)$")
_FORMAT = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]+|glpat-[\w-]{20}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: unquoted words that tell a kind of value
_KINDS = {"str", "string", "int", "integer", "bytes", "bool", "boolean", "float", "any", "text", "char", "varchar", "optional", "required", "object", "list", "dict", "self"}
#: what stands before a value that has its line for itself
_ALONE = re.compile(r"[\s\-{,]*(?:export\s+)?[\"']?[\w.\-]+[\"']?\s*(?::=|=>|[:=])\s*")
_NAME = r"(?:\"[\w.\-]++\"|'[\w.\-]++'|[^\W\d][\w.\-]*+)"
_LEFT = re.compile(rf"(?:\[[ \t]*+({_NAME})[ \t]*+\]|(?<![\w.\-])({_NAME})|<([A-Za-z][\w.\-]*+)>(?=[^<>\s]++</))(?:[ \t]*+(:=|=>|[=:])(?![=:])[ \t]*+|(?<=>))")
_STRING = re.compile(r"[bBrRfFuU]{0,2}(?:\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|\'\'\'((?:[^\'\\]|\\.|\'(?!\'\'))*+)\'\'\'|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)", re.S)
_BARE = re.compile(r"[^\s\"'`,;<>()\[\]{}&#]+")
_IDENT = re.compile(r"[^\W\d][\w.]*$")
_URL = re.compile(r"(?<=[a-z0-9+.\-])://[^\s:/@\"']++:([^\s/@\"']++)@")
_PLUS, _COMMA = re.compile(r"[ \t]*+\+[ \t]*+"), re.compile(r"[ \t]*+,[ \t]*+")
_ITEM = re.compile(r"\s*+,?+\s*+")
_BLOCK = re.compile(r"[|>][-+0-9]*+[ \t]*+\n")
_TARGETS = re.compile(rf"^[ \t]*+(?:{_NAME}[ \t]*+,[ \t]*+)++$")
_TAG = re.compile(r"<[A-Za-z][^<>]*+>")
_ATTRIBUTE = re.compile(r"([A-Za-z][\w.\-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')")


def words_of(name: str) -> list[str]:
    """Lower-case words of a name in any of the usual styles."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def name_score(name: str) -> float:
    words = words_of(name)
    s = 0.0
    if any(w in _STRONG or w not in _AGAINST and w.removesuffix("s") in _STRONG for w in words) or any(p in _PAIRS for p in zip(words, words[1:])):
        s = 3.0
    elif set(words) & _WEAK:
        s = 1.0
    return s - 2.0 * len(set(words) & _AGAINST)


def literal_score(value: str, named: bool) -> float:
    """How much a literal looks like a secret: length and entropy count for it, placeholders and plain words against it."""
    if _FORMAT.search(value):
        return 5.0
    if len(value) < 4 or _PLACEHOLDER.match(value):
        return -5.0
    n = len(value)
    bits = n * -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    s = min(bits / 24, 3.0)
    if " " in value or "://" in value:
        s -= 2.0
    if re.fullmatch(r"[a-zA-Z]+[.,!?;:]?", value):
        s -= 1.5 if value[:1].isupper() or not named else 0.5
    if re.fullmatch(r"[\d.]+", value) and n < 8:
        s -= 1.0
    return s


def plain(text: str, a: int, b: int) -> bool:
    """Whether the literal at a:b counts under a strong name however short and regular it is.

    Quoted and tagged ones do, and unquoted ones that are no expression or word of a sentence: those with a digit or a sign, after
    a bare =, or alone on their line. Placeholders and what has under four characters never do.
    """
    value = text[a:b]
    if len(value) < 4 or _PLACEHOLDER.match(value):
        return False
    if text[a - 1 : a] in ("\"", "'", "`", ">"):
        return True
    if value.lower() in _KINDS or text[b : b + 1] in ("(", "[") or "://" in value:
        return False
    if not _IDENT.match(value):
        return True
    if "." in value:
        return False
    line, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    rest = text[b : end if end >= 0 else len(text)].strip()
    return text[a - 1 : a] == "=" or any(c.isdigit() for c in value) or bool((not rest or rest[0] in ",;#}") and _ALONE.fullmatch(text, line, a))


Term = tuple[str, str, int, int]  # literal or name, value, start, stop


def _term(text: str, i: int) -> tuple[Term, int] | None:
    if m := _STRING.match(text, i):
        k = next(g for g in range(1, 6) if m.group(g) is not None)
        return ("literal", m.group(k), m.start(k), m.end(k)), m.end()
    if m := _BARE.match(text, i):
        stop = m.end()
        while stop > m.start() and text[stop - 1] in ".!?:":
            stop -= 1
        word = text[m.start() : stop]
        return ("name" if _IDENT.match(word) else "literal", word, m.start(), stop), m.end()
    return None


def _sum(text: str, i: int) -> tuple[list[Term], int]:
    """The terms of a sum at i, and where it ends; neighbouring literals are one."""
    terms: list[Term] = []
    while (found := _term(text, i)) is not None:
        term, i = found
        if terms and terms[-1][0] == term[0] == "literal":
            terms[-1] = ("literal", terms[-1][1] + term[1], terms[-1][2], term[3])
        else:
            terms.append(term)
        if not (m := _PLUS.match(text, i)):
            break
        i = m.end()
    return terms, i


def _block(text: str, i: int, line: int) -> list[Term]:
    """The lines of an indented block from i on, each a literal; ``line`` is where the assignment's own line begins."""
    out, indent = [], len(text[line:i]) - len(text[line:i].lstrip(" "))
    while i < len(text):
        end = text.find("\n", i)
        end = len(text) if end < 0 else end
        own = text[i:end].strip()
        if own:
            at = text.index(own, i)
            if at - i <= indent:
                break
            out.append(("literal", own, at, at + len(own)))
        i = end + 1
    return out


def assignments(text: str) -> list[tuple[str, list[Term]]]:
    """All ``(name, terms)`` of a text, in order; several terms are a sum. A list gives an assignment an item."""
    out: list[tuple[str, list[Term]]] = []
    for m in _LEFT.finditer(text):
        name = (m.group(1) or m.group(2) or m.group(3)).strip("\"'")
        i = m.end()
        if m.group(3) is not None:
            j = text.find("<", i)
            out.append((name, [("literal", text[i:j], i, j)]))
            continue
        if m.group(4) is None:
            continue
        line = text.rfind("\n", 0, m.start()) + 1
        if m.group(4) == ":" and (block := _BLOCK.match(text, i)):
            out += [(name, [t]) for t in _block(text, block.end(), line)]
            continue
        if text[i : i + 1] in ("[", "("):
            i = _ITEM.match(text, i + 1).end()
            while (found := _sum(text, i))[0]:
                out.append((name, found[0]))
                i = _ITEM.match(text, found[1]).end()
            continue
        # a, b = x, y: the names before this one on its line take the values before its own
        before = [x.strip().strip("\"'") for x in text[line : m.start()].split(",")[:-1]] if m.group(4) == "=" and m.start() - line < 4096 and _TARGETS.match(text[line : m.start()]) else []
        for target in (*before, name):
            terms, i = _sum(text, i)
            if not terms:
                break
            out.append((target, terms))
            if not (c := _COMMA.match(text, i)) or target == name:
                break
            i = c.end()
    for tag in _TAG.finditer(text):
        pairs = {k.group(1).lower(): k for k in _ATTRIBUTE.finditer(text, tag.start(), tag.end())}
        key, value = next((pairs[k] for k in ("key", "name", "id") if k in pairs), None), pairs.get("value")
        if key is not None and value is not None:
            g = 2 if value.group(2) is not None else 3
            out.append((key.group(2) or key.group(3) or "", [("literal", value.group(g), value.start(g), value.end(g))]))
    return out


def held(pairs: list[tuple[str, list[Term]]]) -> dict[str, dict[tuple[int, int], str]]:
    """The literals that each name can hold, by where they stand: those assigned to it, and those of the names assigned to it.

    A name is known by itself or by its last part (``self.b`` is ``b``). Literals go along the assignments once each.
    """
    names = {name for name, _ in pairs}
    last = {name.rsplit(".", 1)[-1]: name for name in names}
    own: dict[str, dict[tuple[int, int], str]] = {name: {} for name in names}
    flows: dict[str, set[str]] = {}
    for name, terms in pairs:
        for kind, value, a, b in terms:
            source = value if value in names else last.get(value.rsplit(".", 1)[-1])
            if kind == "literal" or source is None:
                # a bare word that no assignment defines is a value: password=hunter
                own[name][a, b] = value
            elif source != name:
                flows.setdefault(source, set()).add(name)
    todo = [(name, place) for name in names for place in own[name] if name in flows]
    while todo:
        name, place = todo.pop()
        for target in flows[name]:
            if place not in own[target]:
                own[target][place] = own[name][place]
                if target in flows:
                    todo.append((target, place))
    return own


def whole_sums(pairs: list[tuple[str, list[Term]]]) -> list[tuple[str, list[Term]]]:
    """``pairs`` with one term each: a sum through names becomes the literal that it makes, at its own literal's place.

    That needs names that hold one value each and a literal in the sum; of other sums each term is assigned by itself.
    """
    single = [(name, terms) for name, terms in pairs if len(terms) == 1]
    if len(single) == len(pairs):
        return pairs
    holds = held(single)
    last = {name.rsplit(".", 1)[-1]: name for name in holds}
    for name, terms in pairs:
        if len(terms) == 1:
            continue
        parts, place = [], None
        for kind, value, a, b in terms:
            if kind == "name":
                values = set(holds.get(value, holds.get(last.get(value.rsplit(".", 1)[-1], ""), {})).values())
                parts.append(values.pop() if len(values) == 1 else None)
            else:
                parts.append(value)
                place = (a, b)
        single += [(name, [("literal", "".join(parts), *place)])] if place and None not in parts else [(name, [t]) for t in terms]
    return single


def scan(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, str, float]]:
    """``(start, stop, name, format, score)`` of each literal at or above the threshold, under the name that scores highest.

    Of equal scores the name that is last in order. Text without assignments and key formats gives none.
    """
    holds = held(whole_sums(assignments(text)))
    best: dict[tuple[int, int], tuple[float, str]] = {}

    def judge(name: str, s: float, place: tuple[int, int], value: str) -> None:
        x = s + literal_score(value, s >= 3) if s > 0 or _FORMAT.search(value) else -1.0
        if s >= 3 and plain(text, *place):
            x = max(x, THRESHOLD)
        if place not in best or (x, name) > best[place]:
            best[place] = (x, name)

    for name, values in holds.items():
        s = name_score(name)
        for place, value in values.items():
            judge(name, s, place, value)
    for m in _URL.finditer(text):
        best[m.span(1)] = (4.0 + min(0.0, literal_score(m.group(1), True)), "url.password")
    good = deque(sorted((a, b) for a, b in best if best[a, b][0] >= threshold))
    reach = 0  # where the last of the literals that count so far ends
    for m in _FORMAT.finditer(text):
        while good and good[0][0] <= m.start():
            reach = max(reach, good.popleft()[1])
        if m.start() >= reach:
            best[m.span()] = (5.0, "")
    out = []
    for (a, b), (s, name) in sorted(best.items()):
        if s >= threshold and b > a:
            m = _FORMAT.search(text, a, b)
            out.append((a, b, name, m.group()[:4] if m else "", round(s, 6)))
    return out


_RESULT = "array<struct<start:int,stop:int,name:string,format:string,score:double>>"


def found(text: Column, threshold: float = THRESHOLD) -> Column:
    """Array of a text's secrets; empty for null and empty texts."""

    @F.arrow_udf(_RESULT)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string()), ("format", pa.string()), ("score", pa.float64())]))
        for arr in batches:
            yield pa.array([[dict(zip(("start", "stop", "name", "format", "score"), x)) for x in scan(t, threshold)] if t else [] for t in arr.to_pylist()], kind)

    return f(text)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, start, stop, name, format, score, shown)``: a row a secret, in characters, with its first two characters alone.

    Repeated rows give repeated rows; null ids stay null; null and empty texts give none; long texts are scanned whole, in time
    linear in their length; of names that score a literal alike the last in order is given. An empty table gives none.
    """
    configure(docs.sparkSession)
    # no assignment and no key format is possible without one of these: decided in the JVM, before any text goes to Python
    likely = F.col(text_col).rlike(r"[=:]|</|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|glpat-|-----BEGIN")
    rows = docs.where(likely).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    hits = rows.select("__id", "__t", F.explode(found(F.col("__t"), threshold)).alias("__h"))
    return hits.select(F.col("__id").alias(id_col), "__h.start", "__h.stop", "__h.name", "__h.format", "__h.score", F.concat(F.substring(F.col("__t"), F.col("__h.start") + 1, F.lit(2)), F.lit("…")).alias("shown"))
