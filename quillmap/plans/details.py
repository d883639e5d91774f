"""Guards, projections, repair, evidence and small plans over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillmap.functions import paths, source, text
from quillmap.operators import changes, detail, joins, search, shape
from quillmap.plans import language
from quillmap.plans.inputs import CHUNKS, EDGES, chunks, edges, lexical_scores, table
from quillmap.plans.registry import query
from quillmap.plans.shaping import _KINDS, _ROWS, _SPANS, _candidates, _spans
from quillmap.plans.structure import _CALLS, _SYMBOLS, _calls, _symbols


@query(f"WITH {_ROWS} SELECT count(*) AS n, sum(score) AS total FROM rows_")
def c13_sound_candidates(spark, sf_dir):
    return detail.sound(_candidates(spark, sf_dir)).agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"WITH {_ROWS} SELECT id, start_line IS NOT NULL AND start_line >= 1 AS kept FROM rows_")
def c14_invalid_spans(spark, sf_dir):
    good, bad = detail.valid_spans(_candidates(spark, sf_dir).withColumn("end_line", F.col("start_line") + 3))
    return good.select("id", F.lit(True).alias("kept")).unionByName(bad.select("id", F.lit(False).alias("kept")))


@query("SELECT p_partkey AS id FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#12', 'brand#13', 'brand#21', 'brand#22', 'brand#23') AND (contains(p_name, 'a') OR contains(p_type, 'a')) AND NOT (contains(p_name, '7') OR contains(p_type, '7'))")
def c15_symbol_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("language"), F.col("p_name").alias("label"), F.lit("x/y").alias("path"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.array("p_type").alias("parents"))
    brands = [f"brand#{i}{j}" for i in (1, 2) for j in (1, 2, 3)]
    return s.filter(detail.symbol_filter(lang=brands, must=["a"], exclude=["7"])).select("id")


@query(f"""WITH {CHUNKS}, b AS (SELECT *, list_filter(list_transform(string_split(path, '/'), lambda x: trim(x)), lambda x: x <> '')[1:2] AS crumbs FROM chunks)
SELECT id, array_to_string(crumbs, '>') AS crumbs, CASE WHEN id % 4 = 0 THEN 'unknown' WHEN id % 100 * 60 <= 30 THEN 'fresh' WHEN id % 100 * 60 <= 1440 THEN 'aging' ELSE 'stale' END AS staleness FROM b""")  # fmt: skip
def c20_result_projection(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = F.when(F.col("id") % 4 != 0, F.timestamp_micros(F.unix_micros(now) - F.col("id") % 100 * 3_600_000_000))
    rows = chunks(spark, sf_dir).withColumn("breadcrumbs", F.split("path", "/")).withColumn("indexed_at", at).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2)).withColumn("score", F.lit(0.0))
    return detail.result_row(rows, now).select("id", F.array_join("breadcrumbs", ">").alias("crumbs"), "staleness")


@query(f"""WITH {CHUNKS}, c AS (SELECT id, content, list_filter(range(0, length(content) + 1), lambda n: strlen(substring(content, 1, n::INT)) <= 60)[-1] AS n FROM (SELECT id, substring(content, 1, 80) AS content FROM chunks))
SELECT id, substring(content, 1, n::INT) AS preview FROM c""")  # fmt: skip
def k11_byte_cut(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", detail.utf8_cut(F.substring("content", 1, 80), 60).alias("preview"))


@query(f"""WITH {_SYMBOLS}, h AS (SELECT DISTINCT file * 10 + line AS id, file, line, file || ':' || (['R', 'A', 'N'])[line % 3 + 1] AS owner FROM lines),
k AS (SELECT h.id, h.owner FROM h JOIN symbols y ON h.owner = y.symbol_key AND y.file = h.file AND y.s <= h.line AND h.line <= y.e),
p AS (SELECT h.id, symbol_key, row_number() OVER (PARTITION BY h.id ORDER BY -(contains(lower(symbol_key), 'r')::INT), e - s, symbol_key) AS rn FROM h JOIN symbols y ON y.file = h.file AND y.s <= h.line AND y.e >= h.line WHERE h.id NOT IN (SELECT id FROM k))
SELECT id, owner, 'stored' AS source FROM k UNION ALL SELECT h.id, symbol_key, CASE WHEN symbol_key IS NULL THEN 'none' ELSE 'registry_repair' END FROM h LEFT JOIN p ON h.id = p.id AND rn = 1 WHERE h.id NOT IN (SELECT id FROM k)""")  # fmt: skip
def d9_repaired_owner(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    flag = F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("N")), F.col("line") % 3 + 1)
    hits = lines.select((F.col("file") * 10 + F.col("line")).alias("id"), "file", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.concat("file", F.lit(":"), flag).alias("owner"))
    return detail.repaired_owner(hits, _symbols(spark, sf_dir).withColumn("name", F.col("symbol_key")), ["r"])


@query("""WITH RECURSIVE i AS (SELECT n_nationkey AS file, n_regionkey AS target FROM nation), e AS (SELECT r_regionkey AS file, (r_regionkey + 1) % 5 AS target FROM region WHERE r_regionkey < 4),
r(file, target) AS (SELECT file, target FROM i UNION SELECT r.file, e.target FROM r JOIN e ON r.target = e.file) SELECT file, target FROM r""")  # fmt: skip
def d13_reexport_support(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_regionkey < 4")
    return detail.reexports(n.select(F.col("n_nationkey").alias("file"), F.col("n_regionkey").alias("target")), r.select(F.col("r_regionkey").alias("file"), ((F.col("r_regionkey") + 1) % 5).alias("target")))


@query(f"""WITH {CHUNKS}, d AS (SELECT DISTINCT source AS command, source || '/main.py' AS module FROM chunks), f AS (SELECT DISTINCT d.command, path FROM d JOIN chunks ON ends_with(path, module))
SELECT d.command, CASE WHEN count(path) = 1 THEN min(path) END AS path FROM d LEFT JOIN f USING (command) GROUP BY d.command""")  # fmt: skip
def d16_command_module(spark, sf_dir):
    c = chunks(spark, sf_dir)
    module = c.select(F.concat("source", F.lit(".main.py")).alias("name"), F.col("source").alias("command")).distinct()
    tails = F.regexp_replace("path", "^.*/([^/]+)/([^/]+)$", "$1.$2")
    found = c.select("path", tails.alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return module.join(found.select("name", "path"), "name", "left").select("command", "path")


_CAP = """f AS (SELECT lang AS language, CASE WHEN n_chars % 3 = 0 THEN 'bearing' WHEN n_chars % 3 = 1 THEN 'free' ELSE 'unavailable' END AS status FROM documents),
c AS (SELECT language, count(*) AS indexed, CASE WHEN language = 'fr' THEN 0 ELSE count(*) FILTER (status = 'bearing') END AS bearing, CASE WHEN language = 'fr' THEN 0 ELSE count(*) FILTER (status = 'free') END AS free, CASE WHEN language = 'fr' THEN 0 ELSE count(*) FILTER (status = 'unavailable') END AS unavailable FROM f GROUP BY language)"""


def _capability(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = F.col("n_chars") % 3
    return detail.capability(d.select(F.col("lang").alias("language"), F.when(m == 0, "bearing").when(m == 1, "free").otherwise("unavailable").alias("status")), search_only=["fr"])


@query(f"WITH {_CAP} SELECT *, bearing + unavailable AS eligible FROM c")
def e5_language_capability(spark, sf_dir):
    return _capability(spark, sf_dir)


@query("""WITH d AS (SELECT n_nationkey % 3 AS e, n_nationkey % 4 AS f, (['none', 'structural'])[n_nationkey % 2 + 1] AS parser, (['symbol_only', 'full', 'search_only'])[n_nationkey % 3 + 1] AS claim, (['none', 'production_ready', 'partial'])[n_regionkey % 3 + 1] AS calls FROM nation)
SELECT count(*) AS total_declarations, count(*) FILTER (e > 0 OR f = 1) AS recognized_routed, count(*) FILTER (parser <> 'none') AS parser_covered, count(*) FILTER (claim = 'symbol_only') AS symbol_only, count(*) FILTER (calls = 'production_ready') AS call_graph FROM d""")  # fmt: skip
def e6_capability_tiers(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    key = F.col("n_nationkey")
    names = lambda size: F.slice(F.array(*map(F.lit, (".a", ".b", ".c"))), F.lit(1), size.cast("int"))
    rows = n.select(
        names(key % 3).alias("extensions"), F.when(key % 4 == 1, names(F.lit(1))).when(key % 4 == 2, names(F.lit(0))).alias("filenames"),
        pick(["none", "structural"], key % 2).alias("parser"), pick(["symbol_only", "full", "search_only"], key % 3).alias("claim"), pick(["none", "production_ready", "partial"], F.col("n_regionkey") % 3).alias("calls"),
    )
    return detail.tier_counts(rows)


@query("""WITH f AS (SELECT lang, doc_id::VARCHAR AS path, n_chars::VARCHAR AS hash FROM documents), b AS (SELECT lang, substr(sha256(path), 1, 2) AS slice, count(*) AS n, sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path)) AS root FROM f GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS files, sha256(string_agg(slice || chr(0) || root || chr(10), '' ORDER BY slice)) AS digest FROM b GROUP BY lang""")  # fmt: skip
def e9_source_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("string").alias("hash"))
    return changes.source_digests(d, "lang")


@query(f"WITH {_SPANS} SELECT file, role, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS parts FROM spans GROUP BY file, role")
def e11_merged_spans(spark, sf_dir):
    return detail.merged_spans(_spans(spark, sf_dir), ["file", "role"])


@query(f"WITH {_SPANS} SELECT id, row_number() OVER (ORDER BY file, start_line, end_line DESC, role, conv_id, id) AS place FROM spans")
def f19_symbol_order(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("kind", F.col("role")).withColumn("qualified_name", F.col("conv_id"))
    return shape.ranked(s, detail.symbol_order(), "place").select("id", "place")


@query(f"WITH {EDGES}, d AS (SELECT DISTINCT src, dst, type, file FROM edges WHERE type = 'IMPORTS') SELECT src, dst, row_number() OVER (ORDER BY file, src, dst, type) AS place FROM d")
def f20_relationship_order(spark, sf_dir):
    e = edges(spark, sf_dir).filter("type = 'IMPORTS'").select("src", "dst", "type", "file").distinct()
    for c in ("line", "start_byte", "end_byte", "start_column", "end_column"):
        e = e.withColumn(c, F.lit(None).cast("int"))
    return shape.ranked(e, detail.relationship_order(), "place").select("src", "dst", "place")


_LEVELS = "(['high', 'medium', 'low'])"


@query(f"""WITH {_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY must DESC, exact DESC, score DESC, path, start_line NULLS LAST, label, id) AS rank, {_LEVELS}[id % 3 + 1] AS o, {_LEVELS}[id % 5 % 3 + 1] AS m FROM rows_)
SELECT rank, id, CASE WHEN id % 11 <> 0 AND o = 'high' THEN 'high_owner_confidence' WHEN id % 11 <> 0 AND o = 'medium' THEN 'medium_owner_confidence' WHEN m = 'high' THEN 'high_semantic_confidence' WHEN m = 'medium' THEN 'medium_semantic_confidence' ELSE 'ranked_candidate' END AS evidence FROM r""")  # fmt: skip
def f18_result_index(spark, sf_dir):
    level = lambda k: F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (k + 1).cast("int"))
    rows = _candidates(spark, sf_dir).withColumn("owner_confidence", F.when(F.col("id") % 11 != 0, level(F.col("id") % 3))).withColumn("semantic_confidence", level(F.col("id") % 5 % 3))
    return detail.evidence(shape.authoritative_rank(rows))


@query("""WITH t AS (SELECT doc_id AS id, sum(strlen(text) + 64) OVER (ORDER BY n_chars DESC, doc_id) AS total, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT id, rank, total AS total_bytes FROM t WHERE total <= 100000 AND rank <= 20""")
def f15_disclosure(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    # an answer shows the first few results; they are taken before they are numbered and summed
    head = shape.ranked(d.orderBy(F.desc("n_chars"), "id").limit(20), [F.desc("n_chars"), "id"])
    return shape.byte_budget(head, F.octet_length("text") + 64, 100_000, ["rank"]).select("id", "rank", "total_bytes")


@query(f"WITH {CHUNKS} SELECT id, sha256('{{\"path\":\"' || path || '\",\"language\":\"' || language || '\",\"symbolLabel\":\"' || label || '\"}}' || chr(10) || content) AS embedding_sha FROM chunks")
def h3_search_projections(spark, sf_dir):
    return detail.projections(chunks(spark, sf_dir)).select("id", F.sha2("embedding_text", 256).alias("embedding_sha"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT term, regexp_full_match(term, '(write|writes|writing|written|update|updates|updated|updating|create|creates|created|creating|generate|generates|generated|generating|emit|emits|emitted|emitting|persist|persists|persisted|persisting|configure|configures|configured|configuring|install|installs|installed|installing|build|builds|built|builder)') AS writer FROM w""")  # fmt: skip
def h22_writer_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term")).distinct()
    return words.select("term", text.is_writer_term(F.col("term")).alias("writer"))


@query(f"""WITH {CHUNKS}, d AS (SELECT DISTINCT path FROM chunks WHERE id % 3 = 0), h AS (SELECT id, c.path FROM chunks c JOIN d ON c.path = d.path WHERE regexp_matches(content, '(?i)(^|[^a-z0-9])token([^a-z0-9]|$)')), r AS (SELECT *, dense_rank() OVER (ORDER BY path) AS n FROM h)
SELECT id, path FROM r WHERE n <= 16""")  # fmt: skip
def j15_dirty_overlay(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return detail.dirty_overlay(c, c.filter("id % 3 = 0"), "token").select("id", "path")


@query(f"""WITH {CHUNKS} SELECT id, contains(content, 'Licensed') AND contains(content, 'CC') AS in_lane FROM chunks WHERE contains(content, 'Licensed') AND contains(content, 'CC')""")
def j10_must_lane(spark, sf_dir):
    lane = lexical_scores(spark, sf_dir, ["Licensed", "CC"]).join(chunks(spark, sf_dir), "id")
    return lane.filter(search.must(["content"], ["Licensed", "CC"])).select("id", F.lit(True).alias("in_lane"))


@query("SELECT true AS count_ok, bool_and(i BETWEEN 0 AND (SELECT count(*) FROM embeddings) - 1) AS index_ok, count(DISTINCT i) = count(*) AS unique_ok, true AS finite_ok FROM (SELECT vec_id % 499 AS i FROM embeddings)")
def j19_rerank_validation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 499).alias("index"), F.lit(0.5).alias("score"))
    return detail.rerank_valid(e, e.count())


@query(f"""WITH {_KINDS}, s AS (SELECT id, CASE WHEN category IN ('docs', 'generated', 'artifact', 'landing', 'fixture') THEN 0 WHEN language <> 'en' THEN 1 ELSE 2 END AS n FROM kinds)
SELECT id, (['retrieved', 'scoped', 'language'])[n + 1] AS last_stage, (['scoped', 'language', NULL])[n + 1] AS removed_at FROM s""")  # fmt: skip
def j21_candidate_survival(spark, sf_dir):
    c = chunks(spark, sf_dir)
    scoped = c.filter(paths.in_scope("runtime", paths.category(F.col("path"))))
    return detail.survival([("retrieved", c), ("scoped", scoped), ("language", scoped.filter("language = 'en'"))])


@query(f"""WITH {_CALLS}, p AS (SELECT call, key, c.file = t.file AS same, row_number() OVER (PARTITION BY call ORDER BY c.file <> t.file, abs(c.line - t.line), t.file, t.line, key) AS rn FROM calls c JOIN targets t ON lower(c.name) = lower(t.name))
SELECT c.call, key AS target, CASE WHEN same THEN 0.92 WHEN NOT same THEN 0.78 END::DOUBLE AS confidence, CASE WHEN key IS NULL THEN 'unresolved:' || name END AS note FROM calls c LEFT JOIN p ON c.call = p.call AND rn = 1""")  # fmt: skip
def l14_legacy_call_graph(spark, sf_dir):
    calls, targets = _calls(spark, sf_dir)
    found, notes = detail.legacy_calls(calls, targets, joins.nearest_line(calls, targets))
    return found.withColumn("note", F.lit(None).cast("string")).unionByName(notes.select("call", F.lit(None).cast("long").alias("target"), F.lit(None).cast("double").alias("confidence"), "note"))


@query(f"WITH {EDGES}, c AS (SELECT DISTINCT file FROM edges WHERE file % 25 = 3), w AS (SELECT DISTINCT dst, file FROM edges WHERE type = 'CALLS'), t AS (SELECT DISTINCT src AS dst, file AS dst_file FROM edges) SELECT DISTINCT file FROM (SELECT file FROM c UNION ALL SELECT w.file FROM w JOIN t USING (dst) WHERE dst_file IN (SELECT file FROM c))")
def l10_affected_files(spark, sf_dir):
    from quillmap.operators import graph

    e = edges(spark, sf_dir)
    owners = e.select(F.col("src").alias("dst"), F.col("file").alias("dst_file")).distinct()
    into = e.filter("type = 'CALLS'").select("dst", "file").distinct().join(owners, "dst")
    return graph.affected_files(into, e.filter("file % 25 = 3").select("file").distinct())


@query(f"""WITH {CHUNKS}, s AS (SELECT id, list_distinct(regexp_extract_all('x = ' || source || '(a); def go(b): ' || language || ' (c)', '(?:^|[^\\w.])([A-Za-z_]\\w*)\\s*\\(', 1)) AS names FROM chunks)
SELECT id, name FROM (SELECT id, unnest(names) AS name FROM s) WHERE name IN ('src1', 'src2', 'en', 'go')""")  # fmt: skip
def l12_fallback_calls(spark, sf_dir):
    body = F.concat(F.lit("x = "), "source", F.lit("(a); def go(b): "), "language", F.lit(" (c)"))
    return detail.fallback_calls(chunks(spark, sf_dir).select("id", body.alias("content")), ["src1", "src2", "en", "go"])


@query("SELECT n_name AS key, n_regionkey AS value FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0 UNION ALL SELECT n_name, -1 FROM nation WHERE n_nationkey % 2 <> 0 AND n_nationkey % 3 = 0 AND n_nationkey % 5 <> 0")
def b3_control_markers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"), "n_nationkey")
    keep = lambda c: n.filter(c).select("key", "value")
    return detail.controls(keep("n_nationkey % 2 = 0"), keep("n_nationkey % 3 = 0").withColumn("value", F.lit(-1)), keep("n_nationkey % 5 = 0"))


@query()
def j20_rerank_documents(spark, sf_dir):
    c = chunks(spark, sf_dir)
    near = lambda step: F.array(F.struct((F.concat(F.lit("src/"), F.col("id") + step)).alias("path"), F.lit("f").alias("label")))
    rows = c.withColumn("role", paths.role(F.col("path"), F.col("language"), F.lit("function"))).withColumn("kind", F.lit("function")).withColumn("declaration", F.col("label"))
    rows = rows.withColumn("direct_callers", near(1)).withColumn("direct_callees", near(2)).withColumn("supporting_tests", F.array().cast("array<struct<path:string,label:string>>"))
    return detail.rerank_documents(rows, ["token", "idiot"])


@query()
def i11_query_plans(spark, sf_dir):
    """Plans of all the benchmark's texts; a plan follows from its query alone, so tasks make them."""
    schema = "item_id long, route string, intent string, confidence string, mode string, terms array<string>, focus string"

    def work(parts):
        for part in parts:
            rows = []
            for i, q in zip(part["item_id"], part["text"], strict=True):
                ops = language.parse_operators(f"lang:EN must:token {q or ''}")
                plan = language.make_plan(ops.query, operators=ops)
                rows.append((i, plan.route, plan.intent, plan.confidence, plan.mode, [t for t, _ in plan.terms], language.answer_focus(plan)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(work, schema)


@query()
def k3_source_symbols(spark, sf_dir):
    """Symbols of small sources made from the part table."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("class C"), "p_partkey", F.lit(":\n    def run(self, x):\n        for y in x:\n            if y:\n                helper(y)\n"), F.lit("def helper(z):\n    return z\n")).alias("content"))
    return source.symbols(p)


@query("SELECT DISTINCT l_orderkey || ':' || l_returnflag AS symbol_key FROM lineitem")
def k6_symbol_registry(spark, sf_dir):
    return detail.unique_symbols(_symbols(spark, sf_dir)).select("symbol_key")


@query(f"""WITH {EDGES}, n AS (SELECT *, CASE WHEN src = 'o5' THEN 'callee' WHEN dst = 'o5' THEN 'caller' END AS side FROM edges WHERE src = 'o5' OR dst = 'o5'),
p AS (SELECT DISTINCT side, src, dst FROM n WHERE confidence IN ('high', 'medium'))
SELECT side, src, dst, 0::BIGINT AS n FROM p UNION ALL SELECT side, confidence, NULL, count(*) FROM n WHERE confidence = 'low' GROUP BY 1, 2""")  # fmt: skip
def l15_traversal_pages(spark, sf_dir):
    page, left_out = detail.traversal_pages(edges(spark, sf_dir), "o5", limit=100)
    rest = left_out.select("side", F.col("confidence").alias("src"), F.lit(None).cast("string").alias("dst"), "n")
    return page.select("side", "src", "dst", F.lit(0).cast("long").alias("n")).unionByName(rest)


@query(f"WITH {CHUNKS} SELECT id, path FROM chunks WHERE path = 'src/core/src0/main.py' OR starts_with(path, 'src/core/src0/main.py/')")
def j16_live_path(spark, sf_dir):
    return chunks(spark, sf_dir).filter(F.col("path").rlike(paths.glob_regex("src/core/src0/main.py"))).select("id", "path")


@query("SELECT count(*) AS rows, sum(strlen(text)) AS bytes FROM documents")
def e15_write_metrics(spark, sf_dir):
    rows, seen = detail.observed_counts(table(spark, sf_dir, "documents").select(F.col("text").alias("content")), "write")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["bytes"])], "rows long, bytes long")
