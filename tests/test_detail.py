import pytest

from quillmap.operators import detail, shape


def test_policies():
    assert detail.must_coverage(None) is None and detail.must_coverage(None, skipped=True) == "lane_skipped_primary_limit_filled"
    assert [detail.must_coverage(k) for k in ("unsupported", "failed", "budget", "completed")] == ["lane_unavailable", "lane_failed", "partial_candidate_budget", "lane_completed_within_backend_results"]
    assert detail.retry_limits(5, True) == [40, 80, 80] and detail.retry_limits(1, False) == [32]
    assert detail.rerank_start([True]) is None and detail.rerank_start([True, False]) == 1 and detail.rerank_start([False, False]) == 0
    assert detail.reranks("auto", True, "runtime", True) and not detail.reranks("auto", True, "docs", True)
    assert shape.candidate_limit(1) == 32 and shape.candidate_limit(50) == 80 and shape.rerank_budget(5, True) == 20 and shape.rerank_budget(5, False) == 10


def test_paths_by_hand(spark):
    """Expected values written down by hand."""
    from pyspark.sql import functions as F

    from quillmap.functions import paths, text

    cases = [
        ("scripts/build", "scriptRuntime"), ("build", "generated"), ("a/build/x.py", "generated"), ("src/test", "neutral"), ("x/src/test", "srcRuntime"), ("tests/a.py", "tests"),
        ("a.test.ts", "tests"), ("docs/x.py", "docs"), ("lib/x.md", "docs"), ("demo/x.py", "example"), ("cli/x.py", "adapter"), ("lib/main.py", "entrypoint"), ("reports/x.py", "artifact"),
        ("a/reports/x.py", "neutral"), ("lib/core/x.py", "core"), ("/Docs/X.py", "docs"), ("./docs/x.py", "docs"), ("fixtures/docs/x.md", "fixture"), ("x/fixtures", "neutral"),
    ]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = {r.i: (r.c, r.p, r.s) for r in rows.select("i", "p", paths.category(F.col("p")).alias("c"), text.search_path(F.col("p")).alias("s")).collect()}
    assert [(p, got[i][0]) for i, (p, _) in enumerate(cases)] == cases
    assert got[16][2] == "./docs/x.py" and got[15][2] == "docs/x.py"
    graph = {"a/b.spec.tsx": True, "a/b.spec.py": False, "x/testdata/y": True, "tests/x.py": True, "packages/a/src/test/x.ts": False, "packages/a/test/x.ts": True, "packages/a/src/fixtures/x.ts": True, "": False, "a/latest/x": False}
    rows = spark.createDataFrame(list(graph.items()), "p string, w boolean")
    assert {r.p: r.t for r in rows.select("p", paths.graph_test_path(F.col("p")).alias("t")).collect()} == graph


def test_status_output_by_hand(spark):
    from quillmap.sources import scan

    lines = ['M  a.py', '?? new.py', '!! gone.py', 'R  old.py -> "my \\"x\\".py"', " M ../out.py", "M  /abs.py", "xx", " M .."]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.path for r in scan.git_status(rows).collect()] == ["a.py", 'my "x".py', "abs.py"]
    assert "new.py" in {r.path for r in scan.git_status(rows, untracked=True).collect()}
    raw = "M  a.py\0R  new.py\0old.py\0?? b.py\0R  c.py\0R  d.py\0 M e f.py\0!! g\0"
    got = lambda **k: {r.path for r in scan.git_status_z(spark.createDataFrame([(raw,)], "output string"), **k).collect()}
    assert got() == {"a.py", "new.py", "c.py", "e f.py"} and got(untracked=True) == {"a.py", "new.py", "c.py", "e f.py", "b.py"}


def test_rerank_document_stays_within_its_bytes():
    import json

    base = {"path": "a.py", "role": "implementation", "kind": "function", "label": "f", "declaration": "def f():"}
    refs = [{"path": f"p{i}", "label": "g"} for i in (3, 1, 2, 0)]
    small = json.loads(detail.rerank_json(base | {"content": "def f():\n    pass", "direct_callers": refs, "supporting_tests": refs}, []))
    assert small["query_relevant_source_excerpt"] == "def f():\n    pass" and [r["path"] for r in small["structural_context"]["direct_callers"]] == ["p0", "p1", "p2"]
    assert len(small["structural_context"]["supporting_tests"]) == 2 and list(small) == sorted(small)
    body = "\n".join(["def f():", *[f"    x{i} = {i}  # plain words" for i in range(400)], "    needle here", "    return x"])
    for content in (body, "\x01" * 5000, '"\\' * 3000, "é" * 4000, "x" * 50_000, "\n".join(['"' * 90] * 300)):
        made = detail.rerank_json(base | {"content": content, "direct_callers": refs}, ["needle"])
        assert len(made.encode()) <= detail.RERANK_BYTES and json.loads(made)["repository_relative_path"] == "a.py"
    chosen = json.loads(detail.rerank_json(base | {"content": body}, ["needle"]))["query_relevant_source_excerpt"]
    assert "needle here" in chosen and chosen.startswith("def f():")
    with pytest.raises(ValueError):
        detail.rerank_json(base | {"content": "", "label": "l" * 5000}, [])


def test_places_and_budgets(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    values = [(i, rng.randint(0, 30), rng.randint(0, 9)) for i in range(500)]
    rows = spark.createDataFrame(values, "id long, v int, size int").repartition(7)
    want = sorted(values, key=lambda r: (-r[1], r[0]))
    got = sorted((r["rank"], r.id) for r in shape.ranked(rows, [F.desc("v"), "id"]).collect())
    assert got == [(k, r[0]) for k, r in enumerate(want, 1)]
    assert shape.ranked(rows.limit(0), ["id"]).collect() == []
    for budget in (-1, 0, 100, 1000, 10**9):
        total, keep = 0, []
        for r in want:
            total += r[2]
            if total > budget:
                break
            keep.append((r[0], total))
        assert sorted((r.id, r.total_bytes) for r in shape.byte_budget(rows, F.col("size"), budget, [F.desc("v"), "id"]).collect()) == sorted(keep)


def test_cursors(spark):
    rows = spark.createDataFrame([(f"k{i:02d}",) for i in range(25)], "k string").repartition(4)
    seen, cursor = [], None
    while True:
        page, cursor = shape.keyset_page(rows, "k", 10, cursor)
        seen += [r.k for r in page.collect()]
        if cursor is None:
            break
    assert seen == [f"k{i:02d}" for i in range(25)]
    _, cursor = shape.keyset_page(rows, "k", 10)
    with pytest.raises(ValueError, match="changed"):
        shape.keyset_page(rows.union(rows.limit(1)), "k", 10, cursor)


def test_counts_of_results():
    assert shape.result_counts(5, 3) == {"requested": 5, "available": 3, "shown": 3, "left": 0}
    assert shape.result_counts(5, 900) == {"requested": 5, "available": 900, "shown": 5, "left": 195}
    assert shape.disclosed([10, 20, 30], 3, 45, 10) == 2 and shape.disclosed([10, 20], 1, 1000) == 1 and shape.disclosed([50], 1, 10) == 0


def test_innermost_matches_all_pairs(spark):
    import random

    from quillmap.operators import joins

    rng = random.Random(3)
    outer = []
    for k in range(300):
        s = rng.randint(1, 20_000)
        outer.append((rng.randint(0, 2), s, s + rng.choice([0, 5, 60, 500, 5000, 100_000]), rng.randint(0, 2), f"k{k}"))
    inner = [(i, rng.randint(0, 3), (a := rng.randint(1, 25_000)), a + rng.choice([0, 3, 200])) for i in range(400)]
    got = joins.innermost(spark.createDataFrame(inner, "id long, file long, start_line long, end_line long"), spark.createDataFrame(outer, "file long, s long, e long, kind_rank int, symbol_key string"), keys=["id"])
    for r in got.collect():
        _, file, a, b = inner[r.id]
        hits = sorted((e - s, kind, key) for f, s, e, kind, key in outer if f == file and s <= a and b <= e)
        assert (r.owner, r.containing) == (hits[0][2] if hits else None, len(hits))


def test_store_rules(spark, tmp_path):
    from quillmap.sources import store

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "c"), (3, "c")], "id long, v string")
    once = sorted(tuple(r) for r in store.upserted(old, new).collect())
    assert [r[0] for r in once] == [1, 2, 3] and sorted(tuple(r) for r in store.upserted(store.upserted(old, new), new.orderBy("v")).collect()) == once
    turns = spark.createDataFrame([(2, "x", 1), (2, "y", 0)], "id long, v string, _turn int")
    assert (2, "x") in {tuple(r) for r in store.upserted(old, turns).collect()}
    with pytest.raises(Exception, match="reserved"):
        store.deleted(old.selectExpr("cast(id as string) id", "v"), spark.createDataFrame([("__meta",)], "id string")).collect()
    s = store.Store(spark, str(tmp_path / "s"))
    first = {n: s.stage(n, old) for n in ("a", "b")}
    assert s.snapshot() == {} and s.publish_all(first) == 1 and s.snapshot() == first
    s.stage("a", new)
    assert s.read("a").count() == 2 and not s.changed(first)
    s.publish_all({"a": 2})
    assert s.changed(first) and s.snapshot() == {"a": 2, "b": 1} and s.read("a").count() == 4 and s.names() == ["a", "b"]


def test_guards(spark):
    bad = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "id string, score double")
    with pytest.raises(Exception, match="finite"):
        detail.sound(bad).collect()
    twice = spark.createDataFrame([("k", 1), ("k", 2)], "symbol_key string, v int")
    with pytest.raises(Exception, match="twice"):
        detail.unique_symbols(twice).collect()


def test_golden_fusion(spark):
    """Shared third in one arm and first in the other; each chunk owned by its file."""
    from quillmap.operators import search

    dense = spark.createDataFrame([("shared", "s", 3.0), ("dense", "d", 2.0), ("dense", "d", 1.0)], "id string, owner string, score double")
    lexical = spark.createDataFrame([("lexical", "l", 2.0), ("shared", "s", 1.0)], "id string, owner string, score double")
    got = {r.id: r.score for r in search.fuse([dense, lexical]).collect()}
    assert got["shared"] == pytest.approx(1 / 101 + 1 / 102) and got["dense"] == pytest.approx(1 / 102) and got["lexical"] == pytest.approx(1 / 101)
    owners = spark.createDataFrame([("a-1", "a", 3.0), ("a-2", "a", 2.0), ("b", "b", 1.0)], "id string, owner string, score double")
    assert {r.id: r.score for r in search.fuse([owners]).collect()} == {"a-1": pytest.approx(1 / 101), "b": pytest.approx(1 / 102)}
