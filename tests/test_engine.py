import pandas as pd
import pytest

from quillmap.engine import Engine
from quillmap.functions import source
from quillmap.plans.language import Request
from quillmap.sources.scan import Policy
from quillmap.sources.store import Store

A = '''"""Parsing."""
from pkg.b import helper_total


class Parser:
    def parse_http(self, raw, *, strict=False) -> str:
        for part in raw:
            for c in part:
                if c and strict or part:
                    return helper_total(c)
        return tidy_up(raw)


def tidy_up(x):
    return x
'''
B = "def helper_total(v):\n    return v + 1\n"
T = "from pkg.a import tidy_up\n\n\ndef test_tidy():\n    assert tidy_up(1) == 1\n"


@pytest.fixture
def tree(tmp_path):
    for name, body in {"src/pkg/a.py": A, "src/pkg/b.py": B, "tests/test_a.py": T, "web/view.ts": "export class View {\n}\nfunction draw() {}\n", "dist/x.py": "x = 1\n", "blob.py.bin": "no"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / "tree" / "raw.dat").write_bytes(b"\0\1\2")
    return tmp_path / "tree"


def test_index_search_navigate_and_sync(spark, tree, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "store")))
    counts = engine.build(str(tree))
    assert counts["files"] == 4
    symbols = {r.qualified_name: r for r in engine.store.read("symbols").filter("kind <> 'file'").collect()}
    assert {"Parser", "Parser.parse_http", "tidy_up", "helper_total", "test_tidy", "View", "draw"} == set(symbols)
    m = symbols["Parser.parse_http"]
    assert (m.kind, m.parameters, m.loops, m.loop_depth, m.complexity, m.returns) == ("method", 3, 2, 2, 6, "str")
    edges = {(r.type, r.confidence, r.file) for r in engine.store.read("edges").collect()}
    assert ("CALLS", "high", "src/pkg/a.py") in edges and ("CALLS", "medium", "src/pkg/a.py") in edges and ("TESTS", "medium", "tests/test_a.py") in edges

    found = engine.search(Request("parse http response", limit=3)).collect()
    assert found[0].file == "src/pkg/a.py" and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    raw = engine.search(Request("must:helper_total lang:python total", result_mode="raw")).collect()
    assert raw and all("helper_total" in r.content for r in raw)
    handle = engine.open_page(Request("tidy parser draw"))
    assert [r["rank"] for r in engine.continue_search(handle, 1, 2).collect()] == [2, 3]

    nodes, _ = engine.call_graph(m.symbol_key, depth=2)
    assert {"Parser.parse_http", "helper_total", "tidy_up"} == {r.qualified_name for r in nodes.collect()}
    callers, _ = engine.call_graph(symbols["tidy_up"].symbol_key, direction="callers")
    assert "test_tidy" in {r.qualified_name for r in callers.collect()}
    assert [r.name for r in engine.outline("src/pkg/a.py").collect()] == ["Parser", "parse_http", "tidy_up"]
    assert engine.read_file("src/pkg/b.py", 1, 1) == "def helper_total(v):"

    (tree / "src/pkg/b.py").write_text(B + "\n\ndef added_here():\n    pass\n")
    (tree / "src/pkg/c.py").write_text("c = 1\n")
    (tree / "web/view.ts").unlink()
    assert engine.sync(str(tree)) == {"added": 1, "modified": 1, "removed": 1}
    assert engine.sync(str(tree)) == {"added": 0, "modified": 0, "removed": 0}
    names = {r.name for r in engine.store.read("symbols").collect()}
    assert "added_here" in names and "View" not in names


C = """from pkg import b
from pkg.a import Parser as P, tidy_up
import pkg.b as other


class Child:
    def first(self):
        return self.second() + b.helper_total(1)

    def second(self):
        return other.helper_total(2)


def use(raw):
    made = P()
    P.parse_http(made, raw)
    tidy_up(raw)
    missing.helper_total(3)
    return Child()
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in {"src/pkg/__init__.py": "from .a import tidy_up\n", "src/pkg/a.py": A, "src/pkg/b.py": B, "src/pkg/c.py": C, "tests/test_a.py": T, "docs/notes.md": "the parser reads http text\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    made = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("store"))))
    made.build(str(root))
    return made


def test_edges_of_members_and_imports(engine):
    at = engine.store.snapshot()
    names = {r.symbol_key: (r.file.rsplit("/", 1)[-1], r.qualified_name if r.kind != "file" else "") for r in engine.store.read("symbols", at["symbols"]).collect()}
    edges = {(r.type, names[r.src], names[r.dst], r.confidence) for r in engine.store.read("edges", at["edges"]).collect()}
    calls = {(s, d): c for t, s, d, c in edges if t == "CALLS"}
    assert calls[("c.py", "Child.first"), ("c.py", "Child.second")] == "high"  # its own class
    assert ("b.py", "helper_total") in {d for (s, d) in calls if s == ("c.py", "Child.first")}  # from pkg import b
    assert ("b.py", "helper_total") in {d for (s, d) in calls if s == ("c.py", "Child.second")}  # import pkg.b as other
    assert ("a.py", "Parser.parse_http") in {d for (s, d) in calls if s == ("c.py", "use")}  # a class under another name
    assert calls[("c.py", "use"), ("c.py", "Child")] == "low"  # a class of its own file
    assert calls[("c.py", "use"), ("a.py", "tidy_up")] == "medium"  # low, raised by the import
    assert ("b.py", "helper_total") not in {d for (s, d) in calls if s == ("c.py", "use")}  # a receiver that nothing brings in
    imports = {(s[0], d) for t, s, d, _ in edges if t == "IMPORTS"}
    assert {("c.py", ("b.py", "")), ("c.py", ("a.py", "Parser")), ("test_a.py", ("a.py", "tidy_up")), ("__init__.py", ("a.py", "tidy_up"))} <= imports
    assert ("TESTS", ("test_a.py", "test_tidy"), ("a.py", "tidy_up"), "medium") in edges


def test_exact_path_and_fallback(engine):
    hit = engine.answer(Request("parse_http"))
    assert hit.passes == ["exact_registry"] and [(r.name, r.file) for r in hit.rows.collect()] == [("Parser.parse_http", "src/pkg/a.py")]
    wide = engine.answer(Request("where is nothing_of_that_name"))
    assert "primary" in wide.passes


def test_passes_and_reasons(engine):
    few = engine.answer(Request("explain reading plain http words", match_mode="any_terms"))
    assert few.expansion == "primary_candidate_pool_small" and few.passes == ["primary", "expanded"]
    bound = engine.answer(Request("lang:python must:strict explain reading http words", result_mode="raw"))
    assert bound.must == "lane_completed_within_backend_results" and "must_lane" in bound.passes
    rows = bound.rows.collect()
    assert rows and all("strict" in r.content for r in rows) and {r.staleness for r in rows} == {"fresh"}
    quoted = engine.answer(Request('"return helper_total(c)"', result_mode="raw"))
    assert "lexical_files" in quoted.passes and quoted.rows.orderBy("rank").first().path == "src/pkg/a.py"


def test_scores_do_not_depend_on_filters(engine):
    def score(query):
        found = engine._scores(["helper_total"], "any_terms", engine.store.snapshot())
        return {r.id: r.score for r in found.collect()}, engine.answer(Request(query, result_mode="raw")).rows.count()

    assert score("helper_total words")[0] == score("path:src/pkg/a.py helper_total words")[0]


def test_changed_files_stand_in_for_indexed_ones(spark, engine):
    changed = spark.createDataFrame([("src/pkg/b.py", "def brand_new_thing(v):\n    return strictly(v)\n")], "path string, content string")
    found = engine.answer(Request("brand_new_thing values", result_mode="raw"), changed=changed)
    assert "dirty_overlay" in found.passes
    rows = found.rows.collect()
    assert any(r.path == "src/pkg/b.py" and "brand_new_thing" in r.content for r in rows[:2])
    old = engine.answer(Request("helper_total values", result_mode="raw"), changed=changed).rows.collect()
    assert not any(r.path == "src/pkg/b.py" and "v + 1" in r.content for r in old)
    live = engine.answer(Request("path:src/pkg/b.py anything else", result_mode="raw"), changed=changed)
    assert "live_path" in live.passes and [r.path for r in live.rows.collect()] == ["src/pkg/b.py"]


def test_reranker_fills_the_places_it_was_given(spark, engine):
    asked = []

    def backwards(query, documents):
        asked.extend(documents)
        return [(i, float(i)) for i in range(len(documents))]

    plain = engine.answer(Request("explain reading plain http words tidy", result_mode="raw", match_mode="any_terms", limit=10))
    engine.reranker = backwards
    try:
        again = engine.answer(Request("explain reading plain http words tidy", result_mode="raw", match_mode="any_terms", limit=10))
    finally:
        engine.reranker = None
    first, second = [[r.id for r in sorted(x.rows.collect(), key=lambda r: r["rank"])] for x in (plain, again)]
    assert asked and sorted(first) == sorted(second) and all(len(d.encode()) <= 4000 for _, d in asked)


def test_pages_expire_and_context_fits(engine):
    handle = engine.open_page(Request("tidy parser draw", match_mode="any_terms"))
    assert engine.continue_search(handle, 0, 1).count() == 1
    with pytest.raises(ValueError, match="results"):
        engine.continue_search(handle, 999, 1)
    began = int(handle.split("-")[0], 16)
    with pytest.raises(ValueError, match="expired"):
        engine.continue_search(handle, 0, 1, now=began + 901)
    other = engine.open_page(Request("parser"))
    assert engine.drop_expired(now=began + 5000) == [f"results_{other}"]
    key = next(r.symbol_key for r in engine.store.read("symbols", engine.store.snapshot()["symbols"]).collect() if r.qualified_name == "tidy_up")
    context = engine.symbol_context(key)
    assert context["parts"][0][2].startswith("def tidy_up") and {side for side, *_ in context["relations"]} == {"caller"}
    with pytest.raises(ValueError):
        engine.symbol_context("nothing")


def test_policy(spark, tree):
    from quillmap.sources.scan import code_files, observe

    names = lambda p: {r.path for r in code_files(spark, str(tree), p).collect()}
    for name in ("src/pkg/__init__.py", "__tests__/deep/x.py", ".git/x.py", ".dockerignore"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("x = 1\n")
    assert {"src/pkg/__init__.py", "__tests__/deep/x.py", ".dockerignore"} == {n for n in names(Policy()) if n.split("/")[0] in ("__tests__", ".dockerignore", ".git") or "__init__" in n}
    for name in ("src/pkg/__init__.py", "__tests__/deep/x.py", ".dockerignore"):
        (tree / name).unlink()
    assert names(Policy.of_profile("minimal")) == {"src/pkg/a.py", "src/pkg/b.py", "tests/test_a.py", "web/view.ts"}
    assert "blob.py.bin" in names(Policy.of_profile("all-text")) and "raw.dat" not in names(Policy.of_profile("all-text"))
    assert "web/view.ts" not in names(Policy.from_toml('[index]\nignore = ["web/"]\n'))
    files = code_files(spark, str(tree))
    assert observe(files, "src/pkg/b.py").first().state == "indexed" and observe(files, "none.py").first().state == "absent"


def test_store_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = lambda i, v: spark.createDataFrame([(i, v)], "id long, v string")
    store.upsert("t", row(1, "a"))
    staged = store.stage("t", row(9, "z"))
    assert store.read("t").count() == 1
    store.discard("t", staged)
    store.upsert("t", row(1, "b").union(row(2, "c")))
    store.upsert("t", row(3, "d"))
    assert {(r.id, r.v) for r in store.read("t").collect()} == {(1, "b"), (2, "c"), (3, "d")}
    assert store.prune("t", keep=1) and store.read("t").count() == 3
    with pytest.raises(ValueError):
        store.publish("t", 99)
    store.fork("t", "u")
    assert store.names() == ["t", "u"]


def test_coverage_stream(spark, tmp_path):
    from quillmap.streaming.freshness import coverage, on_changes

    seen = []
    for i, rows in enumerate([[("r", 1, "event"), ("r", 2, "begin")], [("r", 3, "event")], [("r", 4, "end")]]):
        spark.createDataFrame(rows, "root string, seq long, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("root string, seq long, kind string").parquet(str(tmp_path / "in"))
        q = coverage(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert (seen[-1].epoch, seen[-1].covered, seen[-1].pending) == (2, 1, 1)
    total = []
    on_changes(spark.readStream.schema("root string, seq long, kind string").parquet(str(tmp_path / "in")), lambda df, n: total.append(df.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(total) == 4


def test_chunks_are_windows_of_bytes():
    body = A + "\n# " + "é漢" * 3000 + "\n" + "x = 1\n" * 10 + "\n\n"
    raw, rows = body.encode(), source.chunk_rows("src/a.py", body)
    named = {}
    for path, key, kind, name, first, last, a, b, text in rows:
        assert path == "src/a.py" and key.startswith("chunk_") and raw[a:b].decode() == text and b - a <= 2500
        assert (first, last) == (raw[:a].count(b"\n") + 1, raw[: b - 1].count(b"\n") + 1)
        named.setdefault(name, []).append((a, b))
    assert {"Parser", "Parser.parse_http", "tidy_up", None} == set(named)
    covered = bytearray(len(raw))
    for spans in named.values():
        for a, b in spans:
            covered[a:b] = b"\1" * (b - a)
    assert not raw.translate(None, b"") == b"" and all(c or chr(r).isspace() for c, r in zip(covered, raw, strict=True))
    gaps = sorted(named[None])
    long = [s for s in gaps if s[1] - s[0] > 2000]
    assert len(long) > 5 and all(0 < a_end - b_start <= 303 for (_, a_end), (b_start, _) in zip(long, long[1:]))
    assert len({r[1] for r in rows}) == len(rows) and source.chunk_rows("a.py", "") == [] and source.chunk_rows("a.txt", " \n ") == []
    assert [r[3] for r in source.chunk_rows("v.ts", "import x\nexport class View {\n}\nfunction draw() {}\n")] == ["View", "draw", None]
    assert list(source.byte_windows(b"abcdefghij", 0, 10, 4, 1)) == [(0, 4), (3, 7), (6, 10)]


def test_excerpts():
    body = "\n".join(["def f():", *[f"    x{i} = {i}" for i in range(200)], "    needle here", "    return x1"])
    assert source.excerpts(body, 1, 203, None, [], 100_000) == [(1, 203)]
    parts = source.excerpts(body, 1, 203, "needle", ["here"], 120)
    assert parts[0][0] == 1 and any(a <= 202 <= b for a, b in parts) and parts[-1][1] == 203
    assert isinstance(pd.DataFrame(source.python_calls("a.py", A)), pd.DataFrame) and source.python_symbols("bad.py", "def (")[0][1] == "file"
