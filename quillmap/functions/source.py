"""Symbols, bindings, calls and figures of Python sources, and a line-based outline of others.

Sources are parsed on the executors, a batch of files at a time.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "file string, kind string, name string, qualified_name string, parent string, start_line int, end_line int, start_byte int, end_byte int, parameters int, loops int, loop_depth int, complexity int, returns string"
CALLS = "file string, callee string, kind string, receiver string, line int"
BINDINGS = "file string, kind string, module string, imported string, local string, line int"
LOOPS = (ast.For, ast.AsyncFor, ast.While, ast.comprehension)
DECISIONS = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension, ast.match_case)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
#: Declarations that the outline of other languages knows.
DECLARED = re.compile(r"^\s*(?:export\s+|public\s+|pub\s+|async\s+|static\s+|default\s+)*(class|interface|enum|struct|trait|function|func|fn|type|module|namespace)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)")


def _figures(node: ast.AST) -> tuple[int, int, int]:
    """Loops, deepest nesting of loops and cyclomatic complexity of a body, nested scopes left out."""
    loops = deepest = 0
    complexity = 1

    def walk(n: ast.AST, depth: int) -> None:
        nonlocal loops, deepest, complexity
        for child in ast.iter_child_nodes(n):
            if isinstance(child, SCOPES):
                continue
            d = depth
            if isinstance(child, LOOPS):
                loops, d = loops + 1, depth + 1
                deepest = max(deepest, d)
            if isinstance(child, DECISIONS):
                complexity += 1
            if isinstance(child, ast.BoolOp):
                complexity += len(child.values) - 1
            walk(child, d)

    walk(node, 0)
    return loops, deepest, complexity


def python_symbols(path: str, source: str) -> list[tuple]:
    """A row for the file and one for each class and function; only the file where the source does not parse."""
    raw = source.encode()
    lines = raw.split(b"\n")
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    out = [(path, "file", path.rsplit("/", 1)[-1], path, None, 1, len(lines), 0, len(raw), None, None, None, None, None)]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def walk(node: ast.AST, parents: list[str], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = ".".join([*parents, child.name])
                is_class = isinstance(child, ast.ClassDef)
                a = None if is_class else child.args
                figures = (None, None, None) if is_class else _figures(child)
                count = None if is_class else len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                returns = None if is_class or child.returns is None else ast.unparse(child.returns)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append((path, "class" if is_class else "method" if in_class else "function", child.name, name, ".".join(parents) or None, first, child.end_lineno, begins[first - 1], begins[child.end_lineno - 1] + child.end_col_offset, count, *figures, returns))
                walk(child, [*parents, child.name], is_class)
            else:
                walk(child, parents, in_class)

    walk(tree, [], False)
    return out


def other_symbols(path: str, source: str) -> list[tuple]:
    """Declarations at the beginning of lines; each lasts until the next."""
    lines = source.split("\n")
    found = [(i, m.group(1), m.group(2)) for i, line in enumerate(lines, 1) if (m := DECLARED.match(line))]
    out = [(path, "file", path.rsplit("/", 1)[-1], path, None, 1, len(lines), 0, len(source.encode()), None, None, None, None, None)]
    begins = [0]
    for text in lines:
        begins.append(begins[-1] + len(text.encode()) + 1)
    for (i, kind, name), end in zip(found, [f[0] - 1 for f in found[1:]] + [len(lines)], strict=False):
        kind, end = "function" if kind in ("func", "fn") else kind, max(i, end)
        out.append((path, kind, name, name, None, i, end, begins[i - 1], begins[end] - 1, None, None, None, None, None))
    return out


def python_calls(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out.append((path, n.func.id, "constructor" if n.func.id[:1].isupper() else "direct", None, n.lineno))
            elif isinstance(n.func, ast.Attribute):
                out.append((path, n.func.attr, "member", ast.unparse(n.func.value), n.lineno))
    return sorted(out, key=lambda r: (r[4], r[1]))


def python_bindings(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(path, "import", a.name, None, a.asname or a.name.split(".")[0], n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [(path, "import", "." * n.level + (n.module or ""), a.name, a.asname or a.name, n.lineno) for a in n.names]
    return sorted(out, key=lambda r: (r[5], r[4] or ""))


#: Bytes of a chunk and of what two neighbours share.
CHUNK_BYTES, OVERLAP_BYTES = 2500, 300
CHUNKS = "path string, id string, kind string, qualified_name string, start_line int, end_line int, start_byte int, end_byte int, content string"


def whole_characters(raw: bytes, first: int, last: int) -> tuple[int, int]:
    """The span without parts of characters at its ends."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    while first < last and inside(first):
        first += 1
    while last > first and inside(last):
        last -= 1
    return first, last


def byte_windows(raw: bytes, first: int, last: int, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Iterator[tuple[int, int]]:
    """Windows of at most ``size`` bytes over a span, each ``size - overlap`` behind the last; one that ends with the span is the last."""
    first, last = whole_characters(raw, first, last)
    for at in range(first, last, size - overlap):
        begin = whole_characters(raw, at, last)[0]
        begin, end = whole_characters(raw, begin, min(begin + size, last))
        if end > begin:
            yield begin, end
        if end == last:
            return


def uncovered_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What a text of so many bytes has outside of the spans."""
    out, reach = [], 0
    for a, b in [*sorted(spans), (size, size)]:
        if a > reach:
            out.append((reach, a))
        reach = max(reach, b)
    return out


def chunk_rows(path: str, content: str, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple]:
    """A file's chunks: windows of each symbol, then of what no symbol covers and is not blank."""
    raw = content.encode()
    symbols = python_symbols(path, content) if path.endswith(".py") else other_symbols(path, content)
    held = [(r[7], r[8], r[1], r[3]) for r in symbols if r[1] != "file" and r[7] is not None and r[8] > r[7]]
    gaps = [(a, b, None, None) for a, b in uncovered_spans([h[:2] for h in held], len(raw)) if raw[a:b].decode(errors="replace").strip()]
    breaks = [i for i, c in enumerate(raw) if c == 10]
    line = lambda at: bisect_left(breaks, at) + 1
    out = []
    for a, b, kind, name in held + gaps:
        for begin, end in byte_windows(raw, a, b, size, overlap):
            piece = raw[begin:end].decode()
            lines = line(begin), line(max(begin, end - 1))
            mark = json.dumps([path, len(out), begin, end, *lines, piece], ensure_ascii=False, separators=(",", ":"))
            out.append((path, "chunk_" + hashlib.sha256(mark.encode()).hexdigest()[:16], kind, name, *lines, begin, end, piece))
    return out


def chunks(files: DataFrame) -> DataFrame:
    return _rows(files, chunk_rows, CHUNKS)


def _rows(files: DataFrame, one, schema: str) -> DataFrame:
    """files: (path, content string)."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for path, content in zip(part["path"], part["content"], strict=True) for r in one(path, content or "")]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "content").mapInPandas(work, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _rows(files, lambda p, c: python_symbols(p, c) if p.endswith(".py") else other_symbols(p, c), SYMBOLS)


def calls(files: DataFrame) -> DataFrame:
    return _rows(files.filter("path LIKE '%.py'"), python_calls, CALLS)


def bindings(files: DataFrame) -> DataFrame:
    return _rows(files.filter("path LIKE '%.py'"), python_bindings, BINDINGS)


def excerpts(source: str, start: int, end: int, phrase: str | None, terms: list[str], budget: int) -> list[tuple[int, int]]:
    """Line ranges of a symbol within a byte budget: all of it, or its first and last line and the best matching lines with a line around."""
    lines = source.split("\n")[start - 1 : end]
    size = lambda i: len(lines[i].encode()) + 1
    if sum(map(size, range(len(lines)))) <= budget:
        return [(start, end)]
    score = lambda s: (10_000 if phrase and phrase in s.lower() else 0) + 100 * sum(t in s.lower() for t in terms)
    wanted = [0, len(lines) - 1] + [j for i in sorted(range(len(lines)), key=lambda i: (-score(lines[i]), i)) if score(lines[i]) for j in (i, i - 1, i + 1)]
    kept: set[int] = set()
    for i in wanted:
        if 0 <= i < len(lines) and i not in kept and sum(map(size, kept)) + size(i) <= budget:
            kept.add(i)
    out: list[tuple[int, int]] = []
    for i in sorted(kept):
        if out and out[-1][1] == start + i - 1:
            out[-1] = (out[-1][0], start + i)
        else:
            out.append((start + i, start + i))
    return out
