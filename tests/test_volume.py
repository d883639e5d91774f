"""What operators move and hold: plans without needless exchanges, and the same rows as a plain count."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmap.functions import text
from quillmap.operators import graph, joins, lexical
from quillmap.plans import registry, structure  # the registry first: it imports the others
from quillmap.sources import store


def exchanges(df):
    return len(re.findall(r"^\W*Exchange ", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1], re.M))


def test_postings_move_once(spark):
    contents = {1: "b a b a-b", 2: "", 3: None, 4: "...", 5: "x" * (text.TOKEN_MAX + 1) + " é_1 É_1", 6: "a"}
    rows = spark.createDataFrame(list(contents.items()), "id long, content string")
    made = lexical.postings(rows)
    want = set()
    for key, content in contents.items():
        tokens = [t for t in re.findall(r"\w+", content or "") if len(t) <= text.TOKEN_MAX]
        want |= {(key, term, tf, len(tokens)) for term, tf in Counter(tokens).items()}
    got = [(r.id, r.term, r.tf, r.dl) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    assert dict(made.dtypes) == {"id": "bigint", "dl": "int", "term": "string", "tf": "int", "bucket": "int"}
    assert exchanges(made) == 1


def test_tasks_that_sort_postings_follow_the_tokens(spark, monkeypatch):
    # whatever the session's partitions are, a task sorts about as many postings as it may
    monkeypatch.setattr(lexical, "TASK_TOKENS", 50, raising=False)
    rows = spark.range(400).selectExpr("id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', (id * 7 + i * 13) % 97))) AS content")
    for known in (None, 400 * 30):
        made = lexical.postings(rows, tokens=known) if known else lexical.postings(rows)
        got = made.rdd.glom().map(lambda part: [tuple(r) for r in part]).collect()
        assert exchanges(made) == 1 and len(got) >= 400 * 30 / 50
        assert max(map(len, got)) <= 4 * 50
        assert all(part == sorted(part, key=lambda r: (r[4], r[2], r[0])) for part in got)
        want = Counter((r.id, w) for r in rows.collect() for w in r.content.split())
        assert sorted((r[0], r[2], r[3]) for part in got for r in part) == sorted((*k, n) for k, n in want.items())


def test_index_is_staged_with_tasks_by_its_own_totals(spark, monkeypatch, tmp_path):
    said = []
    plain = lexical.postings
    monkeypatch.setattr(lexical, "postings", lambda rows, **how: said.append(how["tokens"]) or plain(rows, **how))
    kept = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "b")], "id long, content string")
    made = lexical.stage(kept, rows)
    assert said == [4.0]
    assert sorted(tuple(r) for r in kept.read("postings", made["postings"]).select("id", "term", "tf", "dl").collect()) == [(1, "a", 2, 3), (1, "b", 1, 3), (4, "b", 1, 1)]
    assert tuple(kept.read("totals", made["totals"]).first()) == (4.0, 1.0)
    empty = lexical.stage(kept, rows.filter("id > 4"))
    assert kept.spark.read.schema("id long").parquet(f"{kept.root}/postings/g{empty['postings']:08d}").count() == 0


def test_scores_do_not_depend_on_the_order_of_postings(spark):
    terms, most = ["a", "b", "c", "d"], 40
    counts = {"a": lambda k: k % 7 + 1, "b": lambda k: k % 5 + 1, "c": lambda k: k % 3 + 1, "d": lambda k: 1}
    # rows k and k + most hold the same counts, the ones' postings in the order of the terms, the others' behind it
    rows = [(t, k + most * back, counts[t](k), 20 + k) for back in (0, 1) for t in (terms[::-1] if back else terms) for k in range(most) if t != "d" or k % 4 == 0]
    index = spark.createDataFrame(rows, "term string, id long, tf int, dl int").withColumn("bucket", lexical.bucket_of(F.col("term"))).coalesce(1)
    sums = spark.createDataFrame([(100.0, 37.0)], "n double, mean double")
    held = Counter(r[0] for r in rows)
    for mode, need in (("any_terms", 1), ("all_terms", 4)):
        got = {r.id: r.score for r in lexical.bm25(index, sums, terms, mode=mode).collect()}
        assert set(got) == {k for k in range(2 * most) if need == 1 or k % most % 4 == 0}
        for k in got:
            assert got[k] == got[(k + most) % (2 * most)]
            parts = {t: math.log(1 + (100 - held[t] + 0.5) / (held[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 37)) for t, i, tf, dl in rows if i == k}
            assert math.isclose(got[k], sum(parts.values()), rel_tol=1e-12)


def test_edges_pass_a_sieve_before_they_move(spark):
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "b", "ü", "", None)], "node string")
    edges = spark.createDataFrame([(s, d) for s in ("a", "b", "ü", "", "x", None) for d in ("a", "b", "y", "", None)] + [("a", "b")], "src string, dst string")
    known = {"a", "b", "ü", ""}
    got = graph.with_nodes(edges, nodes)
    want = sorted((s, d) for s, d in map(tuple, edges.collect()) if s in known and d in known)
    assert sorted((r.src, r.dst) for r in got.collect()) == want
    words = graph.sieve(nodes, 1 << 12).first().words
    assert len(words) == 64 and 1 <= sum(bin(w % (1 << 64)).count("1") for w in words) <= len(known)
    # no join stands below the filter of either end
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and plan.index("scalar-subquery") > plan.rindex("LeftSemi")


def test_unique_parent_of_repeated_rows_ties_and_null_keys(spark):
    rows = [(1, n, n, n) for n in (1, 2, 2, 5, 9, 30)] + [(2, 1, 1, 4), (3, 1, 1, 1), (None, 1, 1, 1), (1, None, None, None)]
    parents = [(1, 1, 4, "b"), (1, 1, 4, "b"), (1, 2, 5, "a"), (1, 5, 20, "c"), (1, 9, 12, None), (1, 8, 11, "d"), (1, 30, 31, None), (1, 0, 99, "z"), (2, 1, 3, "e"), (2, 0, 9, "f"), (3, 7, 9, "g"), (None, 0, 9, "h")]
    got = joins.unique_parent(spark.createDataFrame(rows, "file long, line int, start_line int, end_line int"), spark.createDataFrame(parents, "file long, s int, e int, symbol_key string"), keys=["file", "line"], on=["file"])
    want = {}
    for file, line, start, end in rows:
        holds = [(e - s, key) for f, s, e, key in parents if None not in (file, start, f) and f == file and s <= start and end <= e]
        if holds:
            least = {key for size, key in holds if size == min(holds, key=lambda h: h[0])[0]} - {None}
            want[file, line] = least.pop() if len(least) == 1 else None
    assert sorted((tuple(r) for r in got.select("file", "line", "parent").collect())) == sorted((*k, v) for k, v in want.items())
    assert want[1, 1] == "b" and want[1, 2] is None and want[1, 9] == "d" and want[1, 30] is None and want[2, 1] == "f"


def test_lines_are_dealt_once_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(structure, "TASK_ROWS", 300)
    sf_dir = "/root/testdata/sf0.001"
    assert structure._by_file(spark, sf_dir).rdd.getNumPartitions() >= structure.table(spark, sf_dir, "lineitem").count() / 300
    # lines and symbols are dealt once each and joined where they lie
    assert exchanges(structure.d3_unique_parent(spark, sf_dir)) == 2
