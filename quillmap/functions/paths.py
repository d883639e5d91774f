"""What a repository path says about a file."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.text import search_path

#: Folder names, endings and beginnings that decide a path's category.
GENERATED_FOLDERS, GENERATED_ENDS = ("dist", "build", "coverage", ".next", ".output", "generated"), (".min.js", ".min.css")
FIXTURE_FOLDERS = ("fixtures", "__fixtures__")
LANDING_FOLDERS = ("landing", "landing-page")
ARTIFACT_ROOTS = ("reports", "report", "investigations", "investigation")
TEST_FOLDERS = ("test", "tests", "__tests__")
DOC_FOLDERS, DOC_ENDS = ("docs", "doc", "documentation", "guide", "guides"), (".md", ".mdx", ".rst", ".adoc", ".txt")
EXAMPLE_FOLDERS = ("examples", "example", "demo", "samples", "sample")
ADAPTER_FOLDERS = ("adapters", "adapter", "tools", "cli")
ENTRY_NAMES = ("main", "index", "app", "server", "cli", "entry")
CONFIG_ENDS = (".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".xml", ".properties", ".env")
CONFIG_LANGUAGES = ("json", "yaml", "toml", "ini", "xml", "dockerfile", "config")


#: Folders and file endings of tests and fixtures as edges see them, and where ``tests`` folders are none.
GRAPH_FIXTURES, GRAPH_TESTS = ("__tests__", "__mocks__", "fixtures", "testdata", "test-data"), ("test", "tests")
TEST_MARKS, SCRIPT_ENDS = ("test", "spec"), ("js", "jsx", "ts", "tsx", "cjs", "cjsx", "cts", "ctsx", "mjs", "mjsx", "mts", "mtsx")


def _folder(path: Column, names: tuple[str, ...]) -> Column:
    """A folder of that name on the way, or a path that is the name; a file of that name in a folder is none."""
    one_of = "|".join(map(re.escape, names))
    return path.rlike(f"^({one_of})$|(^|/)({one_of})/")


def _ends(path: Column, ends: tuple[str, ...]) -> Column:
    return path.rlike("(" + "|".join(map(re.escape, ends)) + ")$")


def is_generated(p: Column) -> Column:
    return _folder(p, GENERATED_FOLDERS) | _ends(p, GENERATED_ENDS)


def is_fixture(p: Column) -> Column:
    return _folder(p, FIXTURE_FOLDERS)


def is_test(p: Column) -> Column:
    return _folder(p, TEST_FOLDERS) | p.rlike(r"\.(test|spec)\.[^/]+$")


def is_doc(p: Column) -> Column:
    return _folder(p, DOC_FOLDERS) | _ends(p, DOC_ENDS)


def is_config(p: Column) -> Column:
    return p.rlike("(^|/)dockerfile$") | _ends(p, CONFIG_ENDS)


def category(path: Column) -> Column:
    """The first of thirteen categories that fits."""
    p = search_path(path)
    return (
        F.when(is_generated(p), "generated")
        .when(is_fixture(p), "fixture")
        .when(_folder(p, LANDING_FOLDERS), "landing")
        .when(p.rlike("^(" + "|".join(ARTIFACT_ROOTS) + ")(/|$)"), "artifact")
        .when(is_test(p), "tests")
        .when(is_doc(p), "docs")
        .when(_folder(p, EXAMPLE_FOLDERS), "example")
        .when(p.rlike("^scripts(/|$)"), "scriptRuntime")
        .when(_folder(p, ADAPTER_FOLDERS), "adapter")
        .when(p.rlike(r"(^|/)(" + "|".join(ENTRY_NAMES) + r")\.[^/]*$"), "entrypoint")
        .when(p.contains("/core/"), "core")
        .when(p.contains("/src/"), "srcRuntime")
        .otherwise("neutral")
    )


def in_scope(scope: str, kind: Column) -> Column:
    if scope == "runtime":
        return ~kind.isin("docs", "generated", "artifact", "landing", "fixture")
    return kind == "docs" if scope == "docs" else F.lit(True)


def role(path: Column, language: Column, symbol_kind: Column) -> Column:
    p, kind = search_path(path), category(path)
    config = is_config(p) | F.coalesce(F.lower(language).isin(*CONFIG_LANGUAGES), F.lit(False)) | F.coalesce(symbol_kind == "config", F.lit(False))
    return (
        F.when(is_test(p), "test")
        .when(is_doc(p), "documentation")
        .when(is_generated(p), "generated")
        .when(is_fixture(p), "fixture")
        .when(kind == "example", "example")
        .when(config, "configuration")
        .when(kind.isin("core", "srcRuntime", "scriptRuntime", "adapter", "entrypoint", "neutral"), "implementation")
        .otherwise("unknown")
    )


def noise(path: Column) -> Column:
    p = search_path(path)
    return F.when(is_generated(p), "generated").when(is_test(p), "tests").when(is_fixture(p), "fixtures").when(is_doc(p), "docs").otherwise("runtime")


def graph_test_path(path: Column) -> Column:
    """Test or fixture, as edges see it."""
    parts = F.split(F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/"))), "/")
    marks = F.split(F.element_at(parts, -1), r"\.")
    named = (F.size(marks) > 2) & F.element_at(marks, -1).isin(*SCRIPT_ENDS) & F.try_element_at(marks, F.lit(-2)).isin(*TEST_MARKS)
    fixture = F.arrays_overlap(parts, F.array(*map(F.lit, GRAPH_FIXTURES)))
    # sources of a package keep their own ``test`` folders
    sources = F.exists(F.sequence(F.lit(1), F.size(parts)), lambda i: (F.try_element_at(parts, i) == "packages") & (F.try_element_at(parts, i + 1) != "") & (F.try_element_at(parts, i + 2) == "src") & (i + 2 < F.size(parts)))
    test = F.arrays_overlap(parts, F.array(*map(F.lit, GRAPH_TESTS))) & ~F.coalesce(sources, F.lit(False))
    return (F.trim(path) != "") & (F.coalesce(named, F.lit(False)) | fixture | test)


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over a whole path."""
    p = pattern.strip().replace("\\", "/")
    anchored = "/" in p.rstrip("/")
    folder = p.endswith("/")
    p = p.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i:]:
            end = p.index("]", i)
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" and body[:1] else body) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """gitignore matching: the last pattern that matches decides, ``!`` takes back."""
    out = F.lit(False)
    for line in patterns:
        line = line.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        back = line.startswith("!")
        out = F.when(path.rlike(glob_regex(line[back:])), F.lit(not back)).otherwise(out)
    return out
