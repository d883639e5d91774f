"""Ownership, resolution and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import text
from quillmap.operators import detail, graph, joins, lexical, shape
from quillmap.plans.inputs import CHUNKS, EDGES, chunks, edges, table
from quillmap.plans.registry import query


#: Rows of a task where a table is dealt out by file.
TASK_ROWS = 500_000


def _by_file(spark, sf_dir):
    """lineitem dealt out by l_orderkey over as many tasks as its rows ask for, so that none grows with the table."""
    l = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-l.count() // TASK_ROWS))  # the count reads the files' footers
    return l.repartition(tasks, "l_orderkey")


def _symbols(spark, sf_dir):
    s = _by_file(spark, sf_dir).groupBy(F.col("l_orderkey").alias("file"), "l_returnflag").agg(F.min("l_linenumber").alias("s"), F.max("l_linenumber").alias("e"))
    return s.select("file", "s", "e", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("kind_rank"), F.concat("file", F.lit(":"), "l_returnflag").alias("symbol_key"))


_SYMBOLS = """symbols AS (SELECT l_orderkey AS file, min(l_linenumber) AS s, max(l_linenumber) AS e, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS kind_rank, l_orderkey || ':' || l_returnflag AS symbol_key FROM lineitem GROUP BY l_orderkey, l_returnflag),
lines AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS line FROM lineitem)"""


@query(f"""WITH {_SYMBOLS}, j AS (SELECT l.file, l.line, symbol_key, row_number() OVER (PARTITION BY l.file, l.line ORDER BY e - s, kind_rank, symbol_key) AS rn, count(*) OVER (PARTITION BY l.file, l.line) AS containing
 FROM lines l JOIN symbols y ON l.file = y.file AND y.s <= l.line AND l.line <= y.e) SELECT file, line, symbol_key AS owner, containing FROM j WHERE rn = 1""")  # fmt: skip
def d1_owner_containment_join(spark, sf_dir):
    inner = _by_file(spark, sf_dir).select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct().withColumn("start_line", F.col("line")).withColumn("end_line", F.col("line"))
    return joins.innermost(inner, _symbols(spark, sf_dir), keys=["file", "line"]).select("file", "line", "owner", "containing")


@query(f"""WITH {_SYMBOLS}, sized AS (SELECT l.file, l.line, e - s AS size, count(DISTINCT symbol_key) AS n, min(symbol_key) AS parent FROM lines l JOIN symbols y ON l.file = y.file AND y.s <= l.line AND l.line <= y.e GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY size) AS rn FROM sized) SELECT file, line, CASE WHEN n = 1 THEN parent END AS parent FROM f WHERE rn = 1""")  # fmt: skip
def d3_unique_parent(spark, sf_dir):
    inner = _by_file(spark, sf_dir).select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).withColumn("start_line", F.col("line")).withColumn("end_line", F.col("line"))
    return joins.unique_parent(inner, _symbols(spark, sf_dir), keys=["file", "line"], on=["file"])


_CALLS = """calls AS (SELECT event_id AS call, 'n' || (user_id % 97) AS name, event_id % 11 AS file, event_id % 300 AS line FROM events),
targets AS (SELECT p_partkey AS key, 'N' || (p_partkey % 140) AS name, p_size % 11 AS file, p_partkey % 300 AS line FROM part)"""


def _calls(spark, sf_dir):
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    calls = e.select(F.col("event_id").alias("call"), F.concat(F.lit("n"), F.col("user_id") % 97).alias("name"), (F.col("event_id") % 11).alias("file"), (F.col("event_id") % 300).alias("line"))
    targets = p.select(F.col("p_partkey").alias("key"), F.concat(F.lit("N"), F.col("p_partkey") % 140).alias("name"), (F.col("p_size") % 11).cast("long").alias("file"), (F.col("p_partkey") % 300).alias("line"))
    return calls, targets


@query(f"""WITH {_CALLS}, h AS (SELECT lower(name) AS name, file, count(*) AS n, min(key) AS k FROM targets GROUP BY 1, 2), w AS (SELECT lower(name) AS name, count(*) AS n, min(key) AS k FROM targets GROUP BY 1)
SELECT call, CASE WHEN h.n = 1 THEN h.k WHEN h.n IS NULL AND w.n = 1 THEN w.k END AS target FROM calls c LEFT JOIN h ON c.name = h.name AND c.file = h.file LEFT JOIN w ON c.name = w.name""")  # fmt: skip
def d4_resolve_unambiguous(spark, sf_dir):
    calls, targets = _calls(spark, sf_dir)
    return joins.resolve_unambiguous(calls, targets.withColumn("name", F.lower("name")))


@query(f"""WITH {_CALLS}, p AS (SELECT call, key, c.file = t.file AS same, row_number() OVER (PARTITION BY call ORDER BY c.file <> t.file, abs(c.line - t.line), t.file, t.line, key) AS rn FROM calls c JOIN targets t ON lower(c.name) = lower(t.name))
SELECT call, key AS target, same AS same_file FROM p WHERE rn = 1""")  # fmt: skip
def d17_nearest_line(spark, sf_dir):
    return joins.nearest_line(*_calls(spark, sf_dir))


@query(f"""WITH {CHUNKS}, t AS (SELECT id AS import, unnest([path || 'x', 'lib/' || source || '/main.py', 'docs/' || source || '/main.py']) AS path, unnest([0, 1, 2]) AS turn FROM chunks)
SELECT import, min_by(t.path, turn) AS path FROM t JOIN (SELECT DISTINCT path FROM chunks) c ON t.path = c.path GROUP BY import""")  # fmt: skip
def d5_first_module(spark, sf_dir):
    c = chunks(spark, sf_dir)
    tries = F.array(F.concat("path", F.lit("x")), F.concat(F.lit("lib/"), "source", F.lit("/main.py")), F.concat(F.lit("docs/"), "source", F.lit("/main.py")))
    return joins.first_module(c.select(F.col("id").alias("import"), tries.alias("candidates")), c.select("path").distinct())


@query(f"""WITH {CHUNKS}, f AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM chunks), s AS (SELECT path, array_to_string(parts[i:], '.') AS name FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM f)),
o AS (SELECT name, min(path) AS path FROM s GROUP BY name HAVING count(DISTINCT path) = 1)
SELECT n.name, o.path FROM (SELECT DISTINCT source || '.worker.rs' AS name FROM chunks UNION SELECT DISTINCT 'core.' || source || '.main.py' FROM chunks) n LEFT JOIN o USING (name)""")  # fmt: skip
def d6_unique_suffix(spark, sf_dir):
    c = chunks(spark, sf_dir)
    names = c.select(F.concat("source", F.lit(".worker.rs")).alias("name")).union(c.select(F.concat(F.lit("core."), "source", F.lit(".main.py")))).distinct()
    return joins.unique_suffix(names, c.select("path").distinct())


@query(f"""WITH {EDGES}, r AS (SELECT src, dst, confidence, row_number() OVER (PARTITION BY dst ORDER BY src, confidence) AS n FROM edges WHERE type = 'CALLS' AND dst LIKE 'p%') SELECT src, dst, confidence FROM r WHERE n <= 3""")
def d10_capped_context(spark, sf_dir):
    e = edges(spark, sf_dir).filter((F.col("type") == "CALLS") & F.col("dst").like("p%")).select("src", "dst", "confidence")
    return joins.capped(e, "dst", ["src", "confidence"], 3)


@query("""WITH s AS (SELECT p_partkey AS key, p_name AS name FROM part), asked AS (SELECT DISTINCT p_partkey AS query, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR WHEN p_partkey % 3 = 1 THEN p_name ELSE lower(replace(p_name, '_', ' ')) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '?' END END AS term FROM part),
e AS (SELECT key, 0 AS tier, key::VARCHAR AS value FROM s UNION ALL SELECT key, 1, name FROM s UNION ALL SELECT key, 2, array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), ' ') FROM s),
c AS (SELECT query, tier, count(DISTINCT key) AS n, min(key) AS key FROM asked JOIN e ON term = value GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier) AS rn FROM c)
SELECT a.query, f.tier, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'hit' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN key END AS key FROM asked a LEFT JOIN f ON a.query = f.query AND rn = 1""")  # fmt: skip
def i15_exact_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    k = F.col("p_partkey")
    term = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lower(F.regexp_replace("p_name", "_", " ")), F.when(k % 2 == 0, "").otherwise("?")))
    asked = p.select(k.alias("query"), term.alias("term")).distinct()
    return joins.exact_lookup(s, asked, [("instance", F.col("key").cast("string")), ("name", F.col("name")), ("identity", text.normalized_identity(F.lower("name")))])


_BFS = f"""WITH {EDGES}, t AS (SELECT DISTINCT src, dst FROM edges WHERE confidence = 'high'), d0 AS (SELECT DISTINCT 'c' || (c_custkey) AS node FROM customer WHERE c_custkey <= 5),
d1 AS (SELECT DISTINCT dst AS node FROM t JOIN d0 ON src = node EXCEPT SELECT node FROM d0), d2 AS (SELECT DISTINCT dst AS node FROM t JOIN d1 ON src = node EXCEPT (SELECT node FROM d0 UNION SELECT node FROM d1)),
d3 AS (SELECT DISTINCT dst AS node FROM t JOIN d2 ON src = node EXCEPT (SELECT node FROM d0 UNION SELECT node FROM d1 UNION SELECT node FROM d2)),
seen AS (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3)
"""


def _start(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey <= 5").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


@query(_BFS + "SELECT node, depth FROM seen")
def l2_bfs_depth3(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), _start(spark, sf_dir), depth=3)[0]


@query(_BFS + "SELECT src, dst, type, e.file, confidence, depth + 1 AS depth FROM edges e JOIN seen ON src = node WHERE confidence <> 'high' AND depth < 3")
def l2_suppressed_edges(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), _start(spark, sf_dir), depth=3)[1].select("src", "dst", "type", "file", "confidence", "depth")


@query(f"WITH {EDGES} SELECT src, dst, type, confidence FROM edges WHERE (src = 'o1' OR dst = 'o1')")
def l1_incident_edges(spark, sf_dir):
    return graph.incident(edges(spark, sf_dir), "o1").select("src", "dst", "type", "confidence")


@query(f"WITH {EDGES} SELECT src, dst, type, confidence FROM edges WHERE file = 7")
def l3_file_edges(spark, sf_dir):
    return edges(spark, sf_dir).filter("file = 7").select("src", "dst", "type", "confidence")


@query(f"WITH {EDGES}, n AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT 'p' || p_partkey FROM part) SELECT src, dst, type, confidence FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def d7_edge_endpoints(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0"), table(spark, sf_dir, "part")
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("node")).union(p.select(F.concat(F.lit("p"), "p_partkey")))
    return graph.with_nodes(edges(spark, sf_dir), nodes).select("src", "dst", "type", "confidence")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation WHERE n_nationkey % 4 <> 0), c(a, b) AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a)
SELECT a, b FROM c""")  # fmt: skip
def d15_base_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0")
    return graph.closure(n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b")))


@query(f"""WITH {EDGES}, n AS (SELECT file, dst, count(*) AS k, count(DISTINCT src) AS s FROM edges WHERE type = 'CALLS' AND confidence = 'low' GROUP BY 1, 2), i AS (SELECT DISTINCT file, src AS dst FROM edges WHERE type = 'IMPORTS')
SELECT e.src, e.dst, e.file, CASE WHEN i.dst IS NOT NULL OR s = 1 THEN 'medium' ELSE 'low' END AS confidence FROM edges e JOIN n ON e.file = n.file AND e.dst = n.dst LEFT JOIN i ON e.file = i.file AND e.dst = i.dst WHERE type = 'CALLS' AND confidence = 'low'""")  # fmt: skip
def l5_confidence_upgrade(spark, sf_dir):
    e = edges(spark, sf_dir)
    low = e.filter("type = 'CALLS' AND confidence = 'low'").select("src", "dst", "file")
    imported = e.filter("type = 'IMPORTS'").select("file", F.col("src").alias("dst"), F.lit(True).alias("imported")).distinct()
    unique = low.groupBy("file", "dst").agg(F.countDistinct("src").alias("s"))
    return low.join(imported, ["file", "dst"], "left").join(unique, ["file", "dst"]).select("src", "dst", "file", F.when(F.col("imported") | (F.col("s") == 1), "medium").otherwise("low").alias("confidence"))


@query(f"""WITH {CHUNKS}, c AS (SELECT a.id AS src, b.id AS dst, a.path AS src_path, b.path AS dst_path FROM chunks a JOIN chunks b ON b.id = a.id + 2),
t AS (SELECT *, regexp_matches(src_path, '(?i)\\.(test|spec)\\.[cm]?[jt]sx?$') OR regexp_matches(src_path, '(?i)(^|/)(__tests__|__mocks__|fixtures|testdata|test-data)(/|$)') OR (regexp_matches(src_path, '(?i)(^|/)tests?(/|$)') AND NOT regexp_matches(src_path, '(?i)(^|/)packages/[^/]+/src/')) AS st,
 regexp_matches(dst_path, '(?i)\\.(test|spec)\\.[cm]?[jt]sx?$') OR regexp_matches(dst_path, '(?i)(^|/)(__tests__|__mocks__|fixtures|testdata|test-data)(/|$)') OR (regexp_matches(dst_path, '(?i)(^|/)tests?(/|$)') AND NOT regexp_matches(dst_path, '(?i)(^|/)packages/[^/]+/src/')) AS dt FROM c)
SELECT src, dst, 'TESTS' AS type FROM t WHERE st AND NOT dt""")  # fmt: skip
def l7_tests_edges(spark, sf_dir):
    c = chunks(spark, sf_dir)
    a, b = c.select(F.col("id").alias("src"), F.col("path").alias("src_path")), c.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
    return graph.tests_of(a.join(b, F.col("dst") == F.col("src") + 2)).select("src", "dst", "type")


@query(f"""WITH {EDGES}, old AS (SELECT DISTINCT src, dst, type, file, 'old' AS v FROM edges WHERE type = 'CALLS'), neu AS (SELECT src, dst, type, file, 'new' AS v FROM old WHERE file % 10 IN (1, 2) AND dst LIKE 'o%')
SELECT src, dst, type, file, v FROM old WHERE file % 10 <> 1 AND (src, dst, type, file) NOT IN (SELECT src, dst, type, file FROM neu) UNION ALL SELECT * FROM neu""")  # fmt: skip
def g3_relationship_delta(spark, sf_dir):
    old = edges(spark, sf_dir).filter("type = 'CALLS'").select("src", "dst", "type", "file").distinct()
    rebuilt = old.filter("file % 10 IN (1, 2) AND dst LIKE 'o%'").withColumn("v", F.lit("new"))
    affected = old.filter("file % 10 = 1").select("file").distinct()
    return graph.delta_merge(old.withColumn("v", F.lit("old")), rebuilt, affected, ["src", "dst", "type", "file"])


@query(f"""WITH {CHUNKS}, n AS (SELECT language AS kind, path, n_chars AS line, regexp_matches(path, '(?i)\\.(test|spec)\\.[cm]?[jt]sx?$') OR regexp_matches(path, '(?i)(^|/)(__tests__|__mocks__|fixtures|testdata|test-data)(/|$)') OR (regexp_matches(path, '(?i)(^|/)tests?(/|$)') AND NOT regexp_matches(path, '(?i)(^|/)packages/[^/]+/src/')) AS test FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY path, line, kind) AS k FROM n)
SELECT kind, path, line, 1::BIGINT AS count FROM r WHERE NOT test OR k <= 3 UNION ALL SELECT 'summary', '(more tests)', NULL, count(*) FROM r WHERE test AND k > 3 HAVING count(*) > 0""")  # fmt: skip
def l13_note_priorities(spark, sf_dir):
    return graph.prioritised_notes(chunks(spark, sf_dir).select(F.col("language").alias("kind"), "path", F.col("n_chars").alias("line")))


@query(f"""WITH RECURSIVE {EDGES}, {CHUNKS}, i AS (SELECT DISTINCT file, file + 1 AS target FROM edges WHERE type = 'CALLS'), x AS (SELECT DISTINCT file, file + 7 AS target FROM edges WHERE type = 'IMPORTS' AND file < 60),
reach(file, target) AS (SELECT file, target FROM i UNION SELECT r.file, x.target FROM reach r JOIN x ON r.target = x.file),
y AS (SELECT id AS symbol_key, 'f' || id % 40 AS name, id % 100 AS file FROM chunks), o AS (SELECT file, name FROM y GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT row_number() OVER (ORDER BY a.id, b.id) AS src, a.id % 100 AS file, b.id AS dst, 'f' || b.id % 40 AS name FROM chunks a JOIN chunks b ON b.id = a.id + 3)
SELECT c.src, c.dst, CASE WHEN r.file IS NOT NULL AND o.name IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
FROM c JOIN y ON c.dst = y.symbol_key LEFT JOIN reach r ON r.file = c.file AND r.target = y.file LEFT JOIN o ON o.file = y.file AND o.name = y.name""")  # fmt: skip
def d14_import_support(spark, sf_dir):
    e, d = edges(spark, sf_dir), chunks(spark, sf_dir)
    imports = e.filter("type = 'CALLS'").select("file", (F.col("file") + 1).alias("target"))
    exports = e.filter("type = 'IMPORTS' AND file < 60").select("file", (F.col("file") + 7).alias("target"))
    symbols = d.select(F.col("id").alias("symbol_key"), F.concat(F.lit("f"), F.col("id") % 40).alias("name"), (F.col("id") % 100).alias("file"), F.lit("function").alias("kind"))
    calls = d.select("id").join(d.select((F.col("id") - 3).alias("id"), F.col("id").alias("dst")), "id")
    calls = calls.select(F.col("id"), (F.col("id") % 100).alias("file"), "dst", F.concat(F.lit("f"), F.col("dst") % 40).alias("name"), F.lit("low").alias("confidence"))
    calls = shape.ranked(calls, ["id", "dst"], "src")
    return detail.upgraded_calls(calls, symbols, detail.reexports(imports, exports)).select("src", "dst", "confidence")


@query(f"""WITH {CHUNKS}, t AS (SELECT id, list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) <= 255) AS toks FROM chunks WHERE language = 'fr'), u AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM t)
SELECT term, id, count(*)::INT AS tf, dl::INT AS dl FROM u GROUP BY term, id, dl""")  # fmt: skip
def b4_postings_of_language(spark, sf_dir):
    """Postings of the rows of one language."""
    rows = chunks(spark, sf_dir).filter("language = 'fr'").select("id", "content")
    return lexical.postings(rows).select("term", "id", "tf", "dl")


@query(f"""WITH {CHUNKS}, f AS (SELECT DISTINCT path FROM chunks), i AS (SELECT id, path AS file, 'lib/' || source || '/main.py' AS module FROM chunks),
n AS (SELECT path, min(id) AS key FROM chunks GROUP BY path HAVING count(*) = 1)
SELECT DISTINCT i.file AS src, CASE WHEN n.key IS NOT NULL THEN 'f' || n.key ELSE f.path END AS dst, 'IMPORTS' AS type FROM i JOIN f ON i.module = f.path LEFT JOIN n ON n.path = f.path""")  # fmt: skip
def l8_import_edges(spark, sf_dir):
    """Files import a module by its path; the edge goes to the module's only symbol, or else to the module."""
    c = chunks(spark, sf_dir)
    tries = F.array(F.concat(F.lit("lib/"), "source", F.lit("/main.py")))
    found = joins.first_module(c.select(F.col("id").alias("import"), tries.alias("candidates")), c.select("path").distinct())
    modules = c.select(F.col("id").alias("import"), F.col("path").alias("file")).join(found, "import")
    names = c.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("key")).filter("n = 1")
    rows = modules.join(names.select("path", "key"), "path", "left")
    return rows.select(F.col("file").alias("src"), F.when(F.col("key").isNotNull(), F.concat(F.lit("f"), "key")).otherwise(F.col("path")).alias("dst"), F.lit("IMPORTS").alias("type")).distinct()
