"""Python sources as relations: functions, docstring items, complexity, comments, wrappers and calls.

A source table is ``(path, content)``. Files are parsed where they lie, a batch at a time, once for all that is asked of them;
what doesn't parse, or nests too deeply for the parser, has no rows but in ``rejects`` and ``file_metrics``.
"""

from __future__ import annotations

import ast
import io
import json
import math
import tokenize
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gritstone.functions import text as T

SHORT_BODY = 10
EXEMPT_TAILS = {"property", "cached_property", "abstractmethod", "override", "overload"}
EXEMPT_NAMES = {f"{cli}.{kind}" for cli in ("app", "typer") for kind in ("command", "callback")} | {"pytest.fixture", "pytest.hookimpl"}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


# --- scans


def read_sources(spark: SparkSession, roots: list[str], notebooks: bool = False) -> DataFrame:
    """``(path, content)`` of the Python files below ``roots``; private ``__*`` files and ignored directories are left out."""
    glob = "*.{py,ipynb}" if notebooks else "*.py"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    files = reader.load(collapse_roots(roots)).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~F.startswith(name, F.lit("__")) & ~T.ignored_path(F.col("path")))


def collapse_roots(roots: list[str]) -> list[str]:
    """Roots without repeats and without those that lie below another."""
    once = list(dict.fromkeys(r.rstrip("/") or "/" for r in roots))
    return [r for r in once if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in once)]


def relative(files: DataFrame, root: str) -> DataFrame:
    """``files`` with paths from ``root`` on, as baselines and exclusions have them on every machine; paths elsewhere stay."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    base = root.rstrip("/") + "/"
    return files.withColumn("path", F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(F.col("path")))


def notebook_code(content: str) -> str | None:
    """The code cells of a notebook, one after another, magics as comments; None for what is no notebook."""
    try:
        cells = json.loads(content)["cells"]
        code = ["".join(c["source"]) for c in cells if c["cell_type"] == "code"]
    except (ValueError, KeyError, TypeError):
        return None
    return "\n".join("# " + x if x.lstrip()[:1] in ("%", "!") else x for c in code for x in c.split("\n")) + ("\n" if code else "")


def with_notebooks(files: DataFrame) -> DataFrame:
    """Text files ``(path, content)`` in which a notebook's content is its code; what is no notebook keeps its own, and is rejected as source."""

    @F.arrow_udf("string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([x if x is None or (c := notebook_code(x)) is None else c for x in arr.to_pylist()], pa.string())

    return files.withColumn("content", F.when(F.endswith("path", F.lit(".ipynb")), code(F.col("content"))).otherwise(F.col("content")))


def split_utf8(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose content is UTF-8, with it as a string, and the paths of the others."""
    good = F.is_valid_utf8("content")
    return files.where(good).select("path", F.col("content").cast("string").alias("content")), files.where(~good).select("path")


def code_lines(sources: DataFrame) -> DataFrame:
    """``(file, line, is_code)``: every line, and whether it is neither blank nor a comment."""
    lines = sources.select(F.col("path").alias("file"), F.posexplode(T.split_lines(F.col("content"))).alias("line", "t"))
    return lines.select("file", (F.col("line") + 1).alias("line"), ((F.trim("t") != "") & ~F.startswith(F.trim("t"), F.lit("#"))).alias("is_code"))


#: what a file may do to the parser, or to a walk over its tree
_BAD = (SyntaxError, ValueError, RecursionError, MemoryError)


def _parse(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except _BAD:
        return None


def _scan(sources: DataFrame, rows_of: Callable[[str, str, ast.Module], list[tuple]], schema: str, broken: Callable[[str, str], list[tuple]] = lambda path, source: []) -> DataFrame:
    """Rows of every file; of one that doesn't parse, or is too deep to walk, those of ``broken``."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def of(path: str, source: str) -> list[tuple]:
        tree = _parse(source)
        if tree is None:
            return broken(path, source)
        try:
            return rows_of(path, source, tree)
        except (RecursionError, MemoryError):
            return broken(path, source)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, source in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                if source is not None:
                    rows += of(path, source)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return sources.select("path", "content").mapInArrow(f, schema)


def rejects(sources: DataFrame) -> DataFrame:
    """``(file, reason)`` of files that the scans give no rows: they don't parse, or nest too deeply."""

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        ast.unparse(tree)
        tree_dump(tree)
        return []

    def broken(path: str, source: str) -> list[tuple]:
        try:
            ast.parse(source)
        except (SyntaxError, ValueError) as e:
            return [(path, f"{type(e).__name__}: {e}")]
        except (RecursionError, MemoryError):
            pass
        return [(path, "nested too deeply")]

    return _scan(sources, rows_of, "file string, reason string", broken)


# --- functions


def _has_doc(node: ast.AST) -> bool:
    b = node.body  # type: ignore[attr-defined]
    return bool(b) and isinstance(b[0], ast.Expr) and isinstance(b[0].value, ast.Constant) and isinstance(b[0].value.value, str)


def executable_line_count(node: ast.AST, lines: list[str]) -> int:
    doc = range(node.body[0].lineno, node.body[0].end_lineno + 1) if _has_doc(node) else range(0)
    return sum(1 for n in range(node.lineno, node.end_lineno + 1) if n not in doc and (s := lines[n - 1].strip()) and s[0] != "#")


def comment_lines(lines: list[str], first: int, last: int) -> list[str]:
    """Lines with a comment; of what can't be tokenised, lines with a #."""
    own = lines[first - 1 : last]
    try:
        at = [t.start[0] for t in tokenize.generate_tokens(io.StringIO("\n".join(own)).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return [x for x in own if "#" in x]
    return [own[k - 1] for k in at if k <= len(own)]


def embedding_text(node: ast.AST, lines: list[str]) -> str:
    """Decorators, signature, docstring and comments: with several decorators, what follows each of them is repeated."""
    out: list[str] = []
    for d in node.decorator_list:
        out += lines[d.lineno - 1 : max(node.lineno - 1, d.lineno - 1)]
    out += lines[node.lineno - 1 : node.body[0].lineno - 1]
    if doc := ast.get_docstring(node):
        out.append(f'"""{doc}"""')
    known = set(out)
    for line in comment_lines(lines, node.lineno, node.end_lineno):
        if line not in known:
            known.add(line)
            out.append(line)
    return "\n".join(out)


def tree_dump(node: ast.AST) -> str:
    """The dump without places, in the form that shows empty lists, whatever the version of Python."""
    try:
        return ast.dump(node, annotate_fields=True, include_attributes=False, show_empty=True)
    except TypeError:
        return ast.dump(node, annotate_fields=True, include_attributes=False)


def functions(sources: DataFrame, min_loc: int = 1) -> DataFrame:
    """Functions and classes of at least ``min_loc`` executable lines, breadth first, without ``__init__``.

    ``ord`` numbers all rows by directory, file and place in the file. Hashes are made in the JVM. The rows are kept on the
    executors' disks while they are numbered, so that files are read and parsed once.
    """

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        lines, out = source.splitlines(), []
        for node in ast.walk(tree):
            if isinstance(node, (*_DEFS, ast.ClassDef)) and node.name != "__init__":
                loc = executable_line_count(node, lines)
                if loc >= min_loc:
                    out.append((path, len(out), node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno, loc, tree_dump(node), "\n".join(lines[node.lineno - 1 : node.end_lineno]), embedding_text(node, lines), ast.unparse(node), ast.get_docstring(node) or ""))
        return out

    rows = _scan(sources, rows_of, "file string, place int, name string, kind string, start_line int, end_line int, loc int, dump string, text string, text_for_embedding string, ast_text string, docstring string")
    hashed = rows.withColumn("hash", T.content_hash(F.col("dump"))).withColumn("text_hash", T.content_hash(F.col("text_for_embedding"))).drop("dump").persist(StorageLevel.DISK_ONLY)
    # a function's number is what its directory, its file and itself have before them: only the directories meet in one task
    folder = F.regexp_replace("file", "[^/]*$", "")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = hashed.groupBy("file").agg((F.max("place") + 1).alias("n")).withColumn("folder", folder)
    folders = files.groupBy("folder").agg(F.sum("n").alias("n")).select("folder", before(Window.orderBy("folder")).alias("base"))
    offsets = files.withColumn("own", before(Window.partitionBy("folder").orderBy("file"))).join(folders, "folder").select("file", (F.col("base") + F.col("own")).alias("before"))
    return hashed.join(offsets, "file").withColumn("ord", (F.col("before") + F.col("place")).cast("bigint")).drop("before", "place")


def distinct_functions(rows: DataFrame) -> DataFrame:
    """One row of each (file, name, start_line, hash, text_hash): the first."""
    from gritstone.operators.cache import first_of

    return first_of(rows, ["file", "name", "start_line", "hash", "text_hash"], "ord")


def docstring_items(sources: DataFrame) -> DataFrame:
    """``(file, name, line, has_doc, kind)`` of functions and classes, overload stubs apart."""

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        out = []
        for node in ast.walk(tree):
            if isinstance(node, (*_DEFS, ast.ClassDef)):
                stub = not isinstance(node, ast.ClassDef) and any(isinstance(d, (ast.Name, ast.Attribute)) and (dotted(d) or "").rsplit(".", 1)[-1] == "overload" for d in node.decorator_list)
                if not stub:
                    out.append((path, node.name, node.lineno, ast.get_docstring(node) is not None, "class" if isinstance(node, ast.ClassDef) else "function"))
        return out

    return _scan(sources, rows_of, "file string, name string, line int, has_doc boolean, kind string")


# --- complexity, from the published definitions


def cyclomatic(node: ast.AST) -> int:
    """McCabe: 1, and 1 for each decision: if, loop, handler, assert, comprehension and its conditions, boolean operand beyond the first, case."""
    n = 1
    todo = list(ast.iter_child_nodes(node))
    while todo:
        x = todo.pop()
        if isinstance(x, (*_DEFS, ast.ClassDef)):
            n += 0 if isinstance(x, ast.ClassDef) else cyclomatic(x)
            continue
        if isinstance(x, (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)):
            n += 1
        elif isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            n += 1 + bool(x.orelse)
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.match_case):
            n += not (isinstance(x.pattern, ast.MatchAs) and x.pattern.pattern is None and x.guard is None)
        todo += ast.iter_child_nodes(x)
    return n


def cognitive(node: ast.AST) -> int:
    """Cognitive complexity: breaks in the linear flow cost 1 and their nesting; else branches, boolean sequences and recursion 1."""
    name = getattr(node, "name", None)

    def of(nodes: list[ast.AST], depth: int) -> int:
        return sum(one(x, depth) for x in nodes)

    def children(x: ast.AST, depth: int) -> int:
        return of(list(ast.iter_child_nodes(x)), depth)

    def branch(x: ast.If, depth: int, chained: bool) -> int:
        n = (1 if chained else 1 + depth) + one(x.test, depth) + of(x.body, depth + 1)
        if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If):
            return n + branch(x.orelse[0], depth, True)
        return n + (1 + of(x.orelse, depth + 1) if x.orelse else 0)

    def one(x: ast.AST, depth: int) -> int:
        if isinstance(x, ast.If):
            return branch(x, depth, False)
        if isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            head = one(x.test, depth) if isinstance(x, ast.While) else one(x.iter, depth)
            return 1 + depth + head + of(x.body, depth + 1) + (1 + of(x.orelse, depth + 1) if x.orelse else 0)
        if isinstance(x, ast.ExceptHandler):
            return 1 + depth + of(x.body, depth + 1)
        if isinstance(x, ast.IfExp):
            return 1 + depth + children(x, depth + 1)
        if isinstance(x, ast.Match):
            return 1 + depth + one(x.subject, depth) + sum(of(c.body, depth + 1) for c in x.cases)
        if isinstance(x, ast.BoolOp):
            return 1 + children(x, depth)
        if isinstance(x, (*_DEFS, ast.Lambda)):
            return of(x.body, depth + 1) if isinstance(x.body, list) else one(x.body, depth + 1)
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == name:
            return 1 + children(x, depth)
        return children(x, depth)

    return of(node.body, 0)


_OPERATORS = (ast.BinOp, ast.UnaryOp, ast.AugAssign)


def maintainability(source: str, tree: ast.Module) -> float:
    """The maintainability index on 0 to 100: Halstead's volume, cyclomatic complexity and source lines, without comments."""
    ops: list[str] = []
    operands: list[str] = []
    for x in ast.walk(tree):
        if isinstance(x, _OPERATORS):
            ops.append(type(x.op).__name__)
            operands += [ast.dump(y) for y in ([x.left, x.right] if isinstance(x, ast.BinOp) else [x.operand] if isinstance(x, ast.UnaryOp) else [x.target, x.value])]
        elif isinstance(x, ast.BoolOp):
            ops.append(type(x.op).__name__)
            operands += [ast.dump(y) for y in x.values]
        elif isinstance(x, ast.Compare):
            ops += [type(o).__name__ for o in x.ops]
            operands += [ast.dump(y) for y in (x.left, *x.comparators)]
    kinds = len(set(ops)) + len(set(operands))
    volume = (len(ops) + len(operands)) * math.log2(kinds) if kinds else 0.0
    sloc = raw_metrics(source)["sloc"]
    if volume <= 0 or sloc <= 0:
        return 100.0
    mi = (171 - 5.2 * math.log(volume) - 0.23 * cyclomatic(tree) - 16.2 * math.log(sloc)) * 100 / 171
    return min(max(0.0, mi), 100.0)


def complexity(sources: DataFrame) -> DataFrame:
    """``(file, name, line, cc, cog)`` of every function; methods are functions."""

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        return [(path, n.name, n.lineno, cyclomatic(n), cognitive(n)) for n in ast.walk(tree) if isinstance(n, _DEFS)]

    return _scan(sources, rows_of, "file string, name string, line int, cc int, cog int")


def complexity_map(rows: DataFrame) -> DataFrame:
    """``(file, name, cc, cog)``: of functions of one name in a file the last one."""
    return rows.groupBy("file", "name").agg(F.max_by("cc", "line").alias("cc"), F.max_by("cog", "line").alias("cog"))


# --- lines and comments


def raw_metrics(source: str) -> dict[str, int]:
    """loc: lines; comments: # tokens; multi: non-blank lines of strings over several lines; sloc: lines of code without these and without docstrings."""
    lines = source.splitlines()
    comments, multi, code, start_of_line = 0, set(), set(), True
    skip = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                comments += 1
            elif t.type == tokenize.STRING and start_of_line:
                (multi if t.end[0] > t.start[0] else set()).update(range(t.start[0], t.end[0] + 1))
                start_of_line = False
            elif t.type not in skip:
                code.update(range(t.start[0], t.end[0] + 1))
                start_of_line = False
            if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT):
                start_of_line = True
    except (tokenize.TokenError, SyntaxError):
        pass
    blank = {i for i, x in enumerate(lines, 1) if not x.strip()}
    return {"loc": len(lines), "comments": comments, "multi": len(multi - blank), "sloc": len(code - blank)}


def body_lines(node: ast.AST) -> int:
    """Lines of a function after the first, docstring apart."""
    doc = node.body[0].end_lineno - node.body[0].lineno + 1 if _has_doc(node) else 0
    return max(node.end_lineno - node.lineno - doc, 0)


def file_metrics(sources: DataFrame) -> DataFrame:
    """``(file, lines, sloc, comments, density, exempt, mi)`` of every file; exempt has functions, all of them short.

    What doesn't parse has its lines and comments all the same, and the worst maintainability, 0: it passes no gate by being broken.
    """

    def row(path: str, source: str, exempt: bool, mi: float) -> tuple:
        m = raw_metrics(source)
        code = m["loc"] - m["multi"] - m["comments"]
        return (path, source.count("\n") + (bool(source) and source[-1] != "\n"), m["sloc"], m["comments"], 100.0 * m["comments"] / code if code > 0 else 0.0, exempt, mi)

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        bodies = [body_lines(n) for n in ast.walk(tree) if isinstance(n, _DEFS)]
        return [row(path, source, bool(bodies) and max(bodies) < SHORT_BODY, round(maintainability(source, tree), 2))]

    return _scan(sources, rows_of, "file string, lines int, sloc int, comments int, density double, exempt boolean, mi double", lambda path, source: [row(path, source, False, 0.0)])


# --- wrappers


def dotted(x: ast.AST) -> str | None:
    """The dotted name of a decorator, also of one that is called."""
    if isinstance(x, ast.Call):
        return dotted(x.func)
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute):
        head = dotted(x.value)
        return x.attr if head is None else f"{head}.{x.attr}"
    return None


def callee(call: ast.Call) -> str | None:
    return call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else None


def forwards(node: ast.AST) -> bool:
    """True if all that a function does is to return a call that takes its parameters, all of them, as they are."""
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    if len(body) != 1 or not isinstance(body[0], ast.Return):
        return False
    call = body[0].value
    if isinstance(call, ast.Await) and isinstance(node, ast.AsyncFunctionDef):
        call = call.value
    if not isinstance(call, ast.Call) or callee(call) is None:
        return False
    a = node.args
    want = [("", p.arg) for p in (*a.posonlyargs, *a.args)]
    if want and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name) and call.func.value.id == want[0][1]:
        del want[0]  # self.f(x) takes self by its target
    want += [("*", a.vararg.arg)] if a.vararg else []
    named = [(p.arg, p.arg) for p in a.kwonlyargs] + ([(None, a.kwarg.arg)] if a.kwarg else [])
    name = lambda x: x.id if isinstance(x, ast.Name) else None
    got = [("*", name(x.value)) if isinstance(x, ast.Starred) else ("", name(x)) for x in call.args]
    return got == want and [(k.arg, name(k.value)) for k in call.keywords] == named


def wrappers(sources: DataFrame, exclude: list[str] | None = None, exempt: list[str] | None = None) -> DataFrame:
    """``(identifier, name, line)`` of forwarding functions; dunder methods, excluded identifiers and exempt decorators apart."""
    exclude, exempt = exclude or [], exempt or []
    match = lambda x, globs: any(fnmatchcase(x, g) for g in globs)

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        out: list[tuple] = []

        def visit(node: ast.AST, outer: tuple[str, ...]) -> None:
            for x in ast.iter_child_nodes(node):
                inner = (*outer, x.name) if isinstance(x, (*_DEFS, ast.ClassDef)) else outer
                if isinstance(x, _DEFS) and forwards(x):
                    identifier = f"{path}:{'.'.join(inner)}"
                    names = [d for d in map(dotted, x.decorator_list) if d]
                    free = any(d.rsplit(".", 1)[-1] in EXEMPT_TAILS or d in EXEMPT_NAMES or match(d, exempt) or match(d.rsplit(".", 1)[-1], exempt) for d in names)
                    if not (x.name.startswith("__") and x.name.endswith("__")) and not free and not match(identifier, exclude):
                        out.append((identifier, x.name, x.lineno))
                visit(x, inner)

        visit(tree, ())
        return out

    return _scan(sources, rows_of, "identifier string, name string, line int")


def call_counts(sources: DataFrame) -> DataFrame:
    """``(name, n)``: calls by the last part of what is called."""

    def rows_of(path: str, source: str, tree: ast.Module) -> list[tuple]:
        return [(c,) for x in ast.walk(tree) if isinstance(x, ast.Call) and (c := callee(x)) is not None]

    return _scan(sources, rows_of, "name string").groupBy("name").agg(F.count("*").alias("n"))
