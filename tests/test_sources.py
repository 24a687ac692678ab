from __future__ import annotations

import ast
import hashlib

import pytest

from gritstone.operators import gates as G
from gritstone.plans import similarity_gate
from gritstone.sources import pysource as P

SOURCE = '''@first
@second(1)
def f(a,
      b):
    """Doc."""
    # a note
    x = "no # comment"  # yes

    return a


class C:
    """C."""

    def __init__(self):
        pass

    async def m(self):
        return 1
'''


def table(spark, **files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_functions(spark):
    rows = P.functions(table(spark, a=SOURCE, bad="def (", none=None)).orderBy("ord").collect()
    assert [(r.ord, r.name, r.kind, r.start_line, r.end_line, r.loc) for r in rows] == [(0, "f", "function", 3, 9, 4), (1, "C", "class", 12, 19, 5), (2, "m", "function", 18, 19, 2)]
    f = rows[0]
    assert f.text_for_embedding == "\n".join(["@first", "@second(1)", "@second(1)", "def f(a,", "      b):", '"""Doc."""', "    # a note", '    x = "no # comment"  # yes'])
    assert f.text_hash == hashlib.sha256(f.text_for_embedding.encode()).hexdigest()
    assert f.hash == hashlib.sha256(P.tree_dump(ast.parse(SOURCE).body[0]).encode()).hexdigest()
    assert f.docstring == "Doc." and f.text.startswith("def f(a,")
    assert [r.name for r in P.functions(table(spark, a=SOURCE), min_loc=5).collect()] == ["C"]


def test_files(spark, tmp_path):
    for name, text in {"a.py": b"x = 1\n", "__init__.py": b"", "build/b.py": b"", "sub/c.py": b"\xff\xfe", "sub/d.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    good, bad = P.split_utf8(P.read_sources(spark, [str(tmp_path), str(tmp_path / "sub")]))
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["a.py"] and good.first().content == "x = 1\n"
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["c.py"]


def fn(source):
    return ast.parse(source).body[0]


@pytest.mark.parametrize(
    ("body", "cc", "cog"),
    [("pass", 1, 0), ("if a: pass", 2, 1), ("if a:\n  if b: pass", 3, 3), ("if a: pass\n elif b: pass\n else: pass", 3, 3), ("for x in y:\n  while z: pass", 3, 3), ("return a and b and c or d", 4, 2), ("try: pass\n except E: pass", 2, 1), ("return [x for x in y if x]", 3, 0), ("return 1 if a else 2", 2, 1), ("return f(1)", 1, 1), ("def g():\n  if a: pass", 3, 2)],
)
def test_complexity(body, cc, cog):
    node = fn("def f():\n " + body)
    assert (P.cyclomatic(node), P.cognitive(node)) == (cc, cog)


def test_raw_metrics_and_density(spark):
    source = '"""Module\n\ndoc."""\nx = 1  # c\n# alone\n\ny = """a\nb"""\n'
    assert P.raw_metrics(source) == {"loc": 8, "comments": 2, "multi": 2, "sloc": 3}
    r = P.file_metrics(table(spark, a=source)).first()
    assert (r.lines, r.density, r.exempt) == (8, 50.0, False) and 0 <= r.mi <= 100
    assert P.file_metrics(table(spark, a="def f():\n    return 1\n")).first().exempt
    assert P.file_metrics(table(spark, a="")).first().mi == 100


def test_docstring_items(spark):
    source = "import t\n@t.overload\ndef a(): ...\n@overload()\ndef b():\n  'd'\nclass C: pass\n"
    assert [tuple(r) for r in P.docstring_items(table(spark, a=source)).collect()] == [("a", "b", 5, True, "function"), ("a", "C", 7, False, "class")]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("def f(a, b): return g(a, b)", True),
        ("def f(a, b): return g(b, a)", False),
        ("def f(a): return g(a, 1)", False),
        ("def f(*a, k, **m): return o.g(*a, k=k, **m)", True),
        ("def f(*, k, j): return g(j=j, k=k)", False),
        ("def f(self, a): return self.g(a)", True),
        ("def f(self, a): return g(self, a)", True),
        ("async def f(a): return await g(a)", True),
        ("def f(a):\n  'd'\n  return g(a)", True),
        ("def f(a): return g(a).h", False),
        ("def f(a): return h[0](a)", False),
        ("def f(a): g(a)", False),
        ("def f(): return g()", True),
    ],
)
def test_forwarding(source, want):
    assert P.forwards(fn(source)) is want


def test_wrappers(spark):
    source = "class A:\n  def f(self): return self.g()\n  def __len__(self): return size(self)\n  @property\n  def p(self): return self.q()\n  @x.keep\n  def k(self): return self.f()\ndef h(a): return inner(a)\nh(1); o.h(2)\n"
    s = table(spark, m=source)
    rows = {r.identifier: r.call_count for r in G.few_calls(P.wrappers(s, exempt=["keep"]), P.call_counts(s)).collect()}
    assert rows == {"m:A.f": 1}
    assert {r.identifier for r in P.wrappers(s, exclude=["m:A.*"]).collect()} == {"m:h"}
    assert G.few_calls(P.wrappers(s), P.call_counts(s), 2).count() == 3


def test_the_gate_end_to_end(spark):
    body = "    x = 1\n    return x\n"
    files = table(spark, a=f"def f():\n{body}def g():\n{body}", b=f"def h():\n{body}class K:\n    def m(self):\n        return 2\n")
    fs = P.functions(files)
    vec = {"f": [1.0, 0.0], "g": [1.0, 0.01], "h": [1.0, 0.02], "K": [0.0, 1.0], "m": [0.0, 1.0]}
    hashes = {r.name: r.text_hash for r in fs.collect()}
    cache = spark.createDataFrame([(hashes[k], v) for k, v in vec.items()], "content_hash string, vec array<float>")
    metrics = P.complexity_map(P.complexity(files))
    plan = similarity_gate.run(fs, cache, "openai_text", {"refactor_index_threshold": 1.0}, metrics, P.code_lines(files))
    assert {(r.name_i, r.name_j) for r in plan["pairs"].collect()} == {("f", "g"), ("f", "h"), ("g", "h")}  # K holds m
    assert [(r.i, r.n) for r in plan["neighbours"].collect()] == [(0, 2)]
    assert {r.ord for r in plan["refactor"].collect()} == {0, 1, 2}
    rows = similarity_gate.report({"openai_text": plan}).collect()
    assert sorted(r.kind for r in rows) == ["neighbours", *["pair"] * 3, *["refactor"] * 3]
    assert any("a:1 f() has 2 similar functions: a:4 g() (100.0%), b:1 h() (100.0%)" == r.message for r in rows)
    assert any("a:1 f() - a:4 g() - similarity: 100.0%" in r.message for r in rows)
    lacking = similarity_gate.advice(fs, cache.limit(0), "text_hash", 2).first()
    assert lacking.missing == 5 and lacking["first"] == ["a:1 f()", "a:4 g()"]


def test_functions_without_vectors_and_symmetrized_providers(spark):
    body = "    x = 1\n    return x\n"
    deep = "".join(f"{'    ' * (k + 1)}if x:\n" for k in range(8)) + "    " * 9 + "pass\n"
    files = table(spark, a=f"def f():\n{body}def g():\n{body}def h(x):\n{deep}")
    fs = P.functions(files)
    hashes = {r.name: r.text_hash for r in fs.collect()}
    cache = spark.createDataFrame([("jina_text_query", hashes["f"], [1.0, 0.0]), ("jina_text_passage", hashes["f"], [1.0, 0.0]), ("jina_text_query", hashes["g"], [1.0, 0.0]), ("jina_text_passage", hashes["g"], [0.0, 1.0])], "cache_key string, content_hash string, vec array<float>")
    metrics = P.complexity_map(P.complexity(files))
    plans, skipped = similarity_gate.run_all(fs, cache, config={"similarity_threshold_pair": 0.4, "refactor_index_threshold": 5.0}, metrics=metrics)
    assert list(plans) == ["jina_text"] and skipped["openai_ast"].first().missing == 3
    assert [(r.name_i, r.name_j, round(r.score, 6)) for r in plans["jina_text"]["pairs"].collect()] == [("f", "g", 0.5)]
    assert [(r.ord, r.max_sim) for r in plans["jina_text"]["refactor"].collect()] == [(2, 0.0)]  # no vector, but complex


def test_broken_and_deep_files_are_rejects(spark):
    files = table(spark, ok="def f():\n    return 1\n", broken="def f(:\n# c\n", deep="x = " + "1+" * 20_000 + "1\n", wide="def g():\n    return " + "+".join(["1"] * 2800) + "\n")
    assert {r.name for r in P.functions(files).collect()} >= {"f"}
    assert {"broken", "deep"} <= {r.file for r in P.rejects(files).collect()} and "ok" not in {r.file for r in P.rejects(files).collect()}
    m = {r.file: r for r in P.file_metrics(files).collect()}
    assert len(m) == 4 and m["broken"].mi == 0.0 and m["broken"].lines == 2 and m["broken"].comments <= 1 and m["ok"].mi > 0
    P.complexity(files).collect()


def test_notebooks_and_paths_from_the_root(spark):
    book = '{"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["%time\\n", "def f():\\n", "    return 1"]}]}'
    files = spark.createDataFrame([("file:/r/nb/a.ipynb", book), ("/r/b.py", "def g():\n    return 2\n"), ("/other/c.py", "x = 1\n"), ("/r/no.ipynb", "[]")], "path string, content string")
    got = {(r.file, r.name) for r in P.functions(P.with_notebooks(P.relative(files, "/r"))).collect()}
    assert got == {("nb/a.ipynb", "f"), ("b.py", "g")}
