"""Filters, categories, ordering, grouping and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.functions import paths
from quillmap.operators import search, shape
from quillmap.plans.inputs import CHUNKS, chunks, table
from quillmap.plans.registry import query

_P = "lower(regexp_replace(replace(path, '\\', '/'), '^/+', ''))"
_GEN = "regexp_matches(p, '^(dist|build|coverage|\\.next|\\.output|generated)$|(^|/)(dist|build|coverage|\\.next|\\.output|generated)/') OR regexp_matches(p, '(\\.min\\.js|\\.min\\.css)$')"
_TEST = "regexp_matches(p, '^(test|tests|__tests__)$|(^|/)(test|tests|__tests__)/') OR regexp_matches(p, '\\.(test|spec)\\.[^/]+$')"
_DOC = "regexp_matches(p, '^(docs|doc|documentation|guide|guides)$|(^|/)(docs|doc|documentation|guide|guides)/') OR regexp_matches(p, '(\\.md|\\.mdx|\\.rst|\\.adoc|\\.txt)$')"
_FIX = "regexp_matches(p, '^(fixtures|__fixtures__)$|(^|/)(fixtures|__fixtures__)/')"
_CATEGORY = f"""CASE WHEN {_GEN} THEN 'generated' WHEN {_FIX} THEN 'fixture' WHEN regexp_matches(p, '^(landing|landing-page)$|(^|/)(landing|landing-page)/') THEN 'landing'
 WHEN regexp_matches(p, '^(reports|report|investigations|investigation)(/|$)') THEN 'artifact' WHEN {_TEST} THEN 'tests' WHEN {_DOC} THEN 'docs'
 WHEN regexp_matches(p, '^(examples|example|demo|samples|sample)$|(^|/)(examples|example|demo|samples|sample)/') THEN 'example' WHEN regexp_matches(p, '^scripts(/|$)') THEN 'scriptRuntime'
 WHEN regexp_matches(p, '^(adapters|adapter|tools|cli)$|(^|/)(adapters|adapter|tools|cli)/') THEN 'adapter' WHEN regexp_matches(p, '(^|/)(main|index|app|server|cli|entry)\\.[^/]*$') THEN 'entrypoint'
 WHEN contains(p, '/core/') THEN 'core' WHEN contains(p, '/src/') THEN 'srcRuntime' ELSE 'neutral' END"""
_KINDS = f"{CHUNKS}, normal AS (SELECT *, {_P} AS p FROM chunks), kinds AS (SELECT *, {_CATEGORY} AS category FROM normal)"


@query(f"WITH {_KINDS} SELECT id, path, category, category NOT IN ('docs', 'generated', 'artifact', 'landing', 'fixture') AS runtime, category = 'docs' AS docs FROM kinds")
def c4_path_category(spark, sf_dir):
    kind = paths.category(F.col("path"))
    return chunks(spark, sf_dir).select("id", "path", kind.alias("category"), paths.in_scope("runtime", kind).alias("runtime"), paths.in_scope("docs", kind).alias("docs"))


@query(f"""WITH {_KINDS} SELECT id, CASE WHEN {_TEST} THEN 'test' WHEN {_DOC} THEN 'documentation' WHEN {_GEN} THEN 'generated' WHEN {_FIX} THEN 'fixture' WHEN category = 'example' THEN 'example'
 WHEN regexp_matches(p, '(^|/)dockerfile$') OR regexp_matches(p, '(\\.json|\\.jsonc|\\.yaml|\\.yml|\\.toml|\\.ini|\\.xml|\\.properties|\\.env)$') THEN 'configuration'
 WHEN category IN ('core', 'srcRuntime', 'scriptRuntime', 'adapter', 'entrypoint', 'neutral') THEN 'implementation' ELSE 'unknown' END AS role,
 CASE WHEN {_GEN} THEN 'generated' WHEN {_TEST} THEN 'tests' WHEN {_FIX} THEN 'fixtures' WHEN {_DOC} THEN 'docs' ELSE 'runtime' END AS noise,
 regexp_matches(path, '(?i)\\.(test|spec)\\.[cm]?[jt]sx?$') OR regexp_matches(path, '(?i)(^|/)(__tests__|__mocks__|fixtures|testdata|test-data)(/|$)') OR (regexp_matches(path, '(?i)(^|/)tests?(/|$)') AND NOT regexp_matches(path, '(?i)(^|/)packages/[^/]+/src/')) AS graph_test FROM kinds""")  # fmt: skip
def c18_candidate_roles(spark, sf_dir):
    p = F.col("path")
    return chunks(spark, sf_dir).select("id", paths.role(p, F.col("language"), F.lit("function")).alias("role"), paths.noise(p).alias("noise"), paths.graph_test_path(p).alias("graph_test"))


@query(f"WITH {CHUNKS} SELECT id, path FROM chunks WHERE path <> 'lib/src3/main.py' AND id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND id <> 8")
def c1_filter_algebra(spark, sf_dir):
    tree = {"type": "and", "filters": [{"type": "comparison", "op": "ne", "field": "path", "value": "lib/src3/main.py"}, {"type": "in", "field": "id", "values": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]}, {"type": "comparison", "op": "ne", "field": "id", "value": 8}]}
    return chunks(spark, sf_dir).filter(search.compile_filter(tree)).select("id", "path")


@query(f"WITH {CHUNKS} SELECT id, language FROM chunks WHERE lower(language) IN ('en', 'fr') AND (path = 'src/core' OR starts_with(path, 'src/core/'))")
def c5_language_and_folder(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.filter(F.lower("language").isin("en", "fr") & ((F.col("path") == "src/core") | F.col("path").startswith("src/core/"))).select("id", "language")


@query(f"WITH {CHUNKS} SELECT id, path FROM chunks WHERE regexp_matches(path, '^(.*/)?src/[^/]*/src[0-9]/.*$') AND NOT (regexp_matches(path, '^(.*/)?[^/]*\\.md$') AND NOT regexp_matches(path, '^src/core/src1/.*$'))")
def c6_path_globs(spark, sf_dir):
    p = F.col("path")
    return chunks(spark, sf_dir).filter(p.rlike(paths.glob_regex("**/src/*/src[0-9]/**")) & ~paths.ignored(p, ["*.md", "# note", "!src/core/src1/**"])).select("id", "path")


@query(f"""WITH {CHUNKS} SELECT id, contains(content, 'the') OR contains(path, 'the') OR contains(label, 'the') AS must_the,
 NOT (contains(content, 'Licensed') OR contains(path, 'Licensed') OR contains(label, 'Licensed')) AND NOT (contains(content, 'docs') OR contains(path, 'docs') OR contains(label, 'docs')) AS allowed FROM chunks""")  # fmt: skip
def c7_must_exclude(spark, sf_dir):
    fields = ["content", "path", "label"]
    return chunks(spark, sf_dir).select("id", search.must(fields, ["the"]).alias("must_the"), search.exclude(fields, ["Licensed", "docs"]).alias("allowed"))


@query(f"""WITH {_KINDS}, r AS (SELECT CASE WHEN category IN ('docs', 'generated', 'artifact', 'landing', 'fixture') THEN 'scope' WHEN language NOT IN ('en', 'de') THEN 'language' WHEN NOT contains(content, 'en') THEN 'must' END AS reason FROM kinds)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")  # fmt: skip
def c11_removal_counters(spark, sf_dir):
    checks = [("scope", paths.in_scope("runtime", paths.category(F.col("path")))), ("language", F.col("language").isin("en", "de")), ("must", F.col("content").contains("en"))]
    return chunks(spark, sf_dir).groupBy(F.coalesce(search.first_removal(checks), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT id, path FROM chunks WHERE id % 3 <> 1 OR id % 5 = 0")
def c10_dirty_paths(spark, sf_dir):
    c = chunks(spark, sf_dir)
    dirty = c.filter("id % 3 = 1").select("path", F.col("id").alias("d"))
    overlay = c.filter("id % 5 = 0 AND id % 3 = 1")
    clean = c.join(dirty, (c["path"] == dirty["path"]) & (c["id"] == dirty["d"]), "left_anti")
    return clean.unionByName(overlay).select("id", "path")


@query("SELECT l_orderkey AS file, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY ALL")
def c16_outline_window(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return rows.filter((F.col("line") <= 4) & (F.col("line") >= 2)).groupBy("file", "line").agg(F.count("*").alias("n"))


_ROWS = "rows_ AS (SELECT doc_id AS id, n_chars % 3 = 0 AS must, n_chars % 7 = 0 AS exact, (n_chars % 50)::DOUBLE AS score, source AS path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars % 90 END AS start_line, lang AS label FROM documents)"


def _candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3 == 0).alias("must"), (F.col("n_chars") % 7 == 0).alias("exact"), (F.col("n_chars") % 50).cast("double").alias("score"), F.col("source").alias("path"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 90).alias("start_line"), F.col("lang").alias("label"))


@query(f"WITH {_ROWS} SELECT id, row_number() OVER (ORDER BY must DESC, exact DESC, score DESC, path, start_line NULLS LAST, label, id) AS rank FROM rows_")
def f3_native_order(spark, sf_dir):
    return shape.authoritative_rank(_candidates(spark, sf_dir)).select("id", "rank")


_SPANS = """spans AS (SELECT c.conv_id, c.turn, c.role, c.conv_id % 7 AS file, (c.turn * 20 + c.conv_id % 40 + 1)::BIGINT AS start_line, (c.turn * 20 + c.conv_id % 40 + 15)::BIGINT AS end_line,
  row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS rank, c.turn = 2 AS pinned, conv_id * 100 + turn AS id FROM conversations c)"""


def _spans(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    start = (F.col("turn") * 20 + F.col("conv_id") % 40 + 1).cast("long")
    c = shape.ranked(c.withColumn("size", F.length("text")).drop("text"), [F.desc("size"), "conv_id", "turn"])
    return c.select("conv_id", "turn", "role", (F.col("conv_id") % 7).alias("file"), start.alias("start_line"), (start + 14).alias("end_line"), "rank", (F.col("turn") == 2).alias("pinned"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))


@query(f"""WITH {_SPANS}, keyed AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'owner:' || file || ':k' || conv_id || ':i' || conv_id ELSE 'fallback:' || file || ':' || floor((start_line - 1) / 25)::BIGINT END AS k FROM spans)
SELECT k, min_by(id, (CASE WHEN pinned THEN 0 ELSE 1000000000 END) + rank) AS representative, min(start_line) AS start_line, max(end_line) AS end_line, max(turn) AS indexed_at, count(*) AS chunks, min(rank) AS best_rank FROM keyed GROUP BY k""")  # fmt: skip
def e1_group_candidates(spark, sf_dir):
    s = _spans(spark, sf_dir)
    symbol = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("k"), "conv_id"))
    key = shape.group_key(F.col("file").cast("string"), symbol, F.concat(F.lit("i"), "conv_id"), F.col("start_line"))
    return shape.reduce_groups(s.withColumn("k", key).withColumn("indexed_at", F.col("turn")), ["k"])


@query(f"WITH {_SPANS} SELECT id, 'grp_' || substr(sha1(file || ':' || start_line || '-' || end_line), 1, 16) AS group_id FROM spans")
def e2_fallback_group_id(spark, sf_dir):
    return _spans(spark, sf_dir).select("id", shape.fallback_id(F.col("file").cast("string"), F.col("start_line"), F.col("end_line")).alias("group_id"))


@query(f"WITH {_SPANS} SELECT file, role AS label, conv_id % 20 AS owner, min(rank) AS rank, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM spans GROUP BY ALL")
def f6_collapse_declarations(spark, sf_dir):
    s = _spans(spark, sf_dir).select("file", F.col("role").alias("label"), (F.col("conv_id") % 20).alias("owner"), "rank", F.array("id").alias("ids"))
    return shape.collapse_declarations(s).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {_SPANS}, top200 AS (SELECT id, conv_id AS symbol, file, rank FROM spans WHERE rank <= 200),
s1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rank) AS sr FROM top200), f1 AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) AS fr FROM s1 WHERE sr = 1)
SELECT id, rank::INT AS rank FROM f1 WHERE fr <= 2""")  # fmt: skip
def f7_diversity_caps(spark, sf_dir):
    s = _spans(spark, sf_dir).select("id", F.col("conv_id").alias("symbol"), "file", F.col("rank").cast("int").alias("rank"))
    # symbols nest in files and the limit equals what the caps allow, so one pass decides
    return shape.diversity(s, limit=14).filter("kept").select("id", "rank")


@query("SELECT doc_id AS id, total AS total_bytes FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS total FROM documents) WHERE total <= 40000")
def f11_byte_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return shape.byte_budget(d, F.octet_length("text"), 40_000, ["id"]).select("id", "total_bytes")


@query("""WITH t AS (SELECT doc_id AS id, source AS family, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank) AS turn FROM t)
SELECT id, row_number() OVER (ORDER BY (turn > 1)::INT, turn, rank) AS place FROM u WHERE turn <= 3 ORDER BY place LIMIT 30""")  # fmt: skip
def f9_family_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family"), "n_chars")
    d = shape.ranked(d, [F.desc("n_chars"), "id"])
    return shape.family_pool(d, 30).select("id", F.col("place").cast("long").alias("place"))


@query("""WITH t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, (doc_id * 37 % 101) AS s FROM documents),
c AS (SELECT *, row_number() OVER (ORDER BY rank) AS n, row_number() OVER (ORDER BY s DESC, rank) AS m FROM t WHERE rank <= 100 AND id % 3 = 0),
moved AS (SELECT b.id, a.rank FROM c a JOIN c b ON a.n = b.m)
SELECT t.id, coalesce(moved.rank, t.rank) AS rank FROM t LEFT JOIN moved USING (id)""")  # fmt: skip
def f12_rerank_slots(spark, sf_dir):
    d = shape.ranked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), "id"]).drop("n_chars")
    chosen = d.filter("rank <= 100 AND id % 3 = 0").select("id", (F.col("id") * 37 % 101).alias("rerank_score"))
    return shape.apply_rerank(d, chosen)


@query(f"WITH {_ROWS}, r AS (SELECT id, row_number() OVER (ORDER BY must DESC, exact DESC, score DESC, path, start_line NULLS LAST, label, id) AS rank FROM rows_) SELECT * FROM r WHERE rank > 20 AND rank <= 35")
def f16_continuation_page(spark, sf_dir):
    ranked = shape.authoritative_rank(_candidates(spark, sf_dir)).select("id", "rank")
    return shape.page(ranked, 20, 15)


@query("SELECT DISTINCT l_orderkey || '>' || l_partkey AS k FROM lineitem WHERE l_orderkey || '>' || l_partkey > '5' ORDER BY k LIMIT 40")
def f17_keyset_page(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit(">"), "l_partkey").alias("k")).distinct()
    return shape.after_key(keys, "k", "5", 40)


@query("""WITH t AS (SELECT lang, count(*) AS files, sum((n_chars % 3 <> 0)::INT) AS bearing, sum((n_chars % 11 = 0)::INT) AS missing FROM documents GROUP BY lang)
SELECT lang, files, bearing, files - bearing AS definition_free, missing, CASE WHEN files <= 0 THEN 'unknown' WHEN bearing / files >= 0.6 THEN 'symbol_rich' WHEN bearing / files >= 0.2 THEN 'mixed' ELSE 'symbol_sparse' END AS status FROM t""")  # fmt: skip
def e4_symbol_quality(spark, sf_dir):
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum((F.col("n_chars") % 3 != 0).cast("int")).alias("bearing"), F.sum((F.col("n_chars") % 11 == 0).cast("int")).alias("missing"))
    return t.select("lang", "files", "bearing", (F.col("files") - F.col("bearing")).alias("definition_free"), "missing", shape.quality(F.col("bearing") / F.col("files"), F.col("files")).alias("status"))


@query(f"""WITH {_KINDS}, top5 AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, id) AS rn FROM kinds)
SELECT CASE WHEN {_GEN} THEN 'generated' WHEN {_TEST} THEN 'tests' WHEN {_FIX} THEN 'fixtures' WHEN {_DOC} THEN 'docs' ELSE 'runtime' END AS noise, round(count(*) / 5, 2) AS ratio, count(*) / 5 >= 0.6 AS hint FROM top5 WHERE rn <= 5 GROUP BY 1""")  # fmt: skip
def e7_noise_ratio(spark, sf_dir):
    head = chunks(spark, sf_dir).orderBy(F.desc("n_chars"), "id").limit(5)
    return head.groupBy(paths.noise(F.col("path")).alias("noise")).agg(F.count("*").alias("n")).select("noise", F.round(F.col("n") / 5, 2).alias("ratio"), (F.col("n") / 5 >= 0.6).alias("hint"))


@query("""WITH r AS (SELECT source, d.doc_id, coalesce(quality, 0) AS rel, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d LEFT JOIN labels l USING (doc_id)),
q AS (SELECT source, max((rel = 1 AND rank = 1)::INT) AS at1, max((rel = 1 AND rank <= 3)::INT) AS at3, min(CASE WHEN rel = 1 THEN rank END) AS best FROM r GROUP BY source)
SELECT count(*) AS workloads, round(avg(at1), 6) AS owner_at_1, round(avg(at3), 6) AS owner_at_3, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM q""")  # fmt: skip
def e10_retrieval_metrics(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    r = d.join(l, "doc_id", "left").withColumn("rel", F.coalesce("quality", F.lit(0))).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    hit = F.col("rel") == 1
    q = r.groupBy("source").agg(F.max((hit & (F.col("rank") == 1)).cast("int")).alias("at1"), F.max((hit & (F.col("rank") <= 3)).cast("int")).alias("at3"), F.min(F.when(hit, F.col("rank"))).alias("best"))
    return q.agg(F.count("*").alias("workloads"), F.round(F.avg("at1"), 6).alias("owner_at_1"), F.round(F.avg("at3"), 6).alias("owner_at_3"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


@query("""WITH s AS (SELECT l_orderkey AS k, (l_linenumber * 100 + l_partkey % 60)::BIGINT AS start, (l_linenumber * 100 + l_partkey % 60 + l_suppkey % 80 + 1)::BIGINT AS e FROM lineitem),
c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s)
SELECT k, reach AS gap_start, start AS gap_end FROM c WHERE start > reach UNION ALL SELECT k, max(e), 1000 FROM s GROUP BY k HAVING max(e) < 1000""")  # fmt: skip
def e12_uncovered_gaps(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 100 + F.col("l_partkey") % 60).cast("long")
    spans = l.select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_suppkey") % 80 + 1).alias("end"), F.lit(0).cast("long").alias("begin"), F.lit(1000).cast("long").alias("finish"))
    return shape.uncovered(spans, ["k"], ("begin", "finish"))


@query("SELECT lang, count(DISTINCT source || ':' || n_chars) AS scoped, count(*) AS all_rows FROM documents GROUP BY lang")
def e13_distinct_candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct(F.concat("source", F.lit(":"), "n_chars")).alias("scoped"), F.count("*").alias("all_rows"))


@query(f"""WITH {CHUNKS}, c AS (SELECT id, content, CASE WHEN length(content) <= 2500 THEN 1 ELSE ceil((length(content) - 2500) / 2200)::INT + 1 END AS n FROM chunks), i AS (SELECT id, content, unnest(range(n)) AS k FROM c)
SELECT id, (k * 2200)::INT AS start, sha256(substring(content, (k * 2200 + 1)::INT, 2500)) AS piece_sha FROM i""")  # fmt: skip
def k1_text_windows(spark, sf_dir):
    cut = chunks(spark, sf_dir).select("id", F.explode(shape.windows(F.col("content"), 2500, 300)).alias("w"))
    return cut.select("id", "w.start", F.sha2("w.piece", 256).alias("piece_sha"))


@query(f"""WITH {CHUNKS}, l AS (SELECT id, string_split(content, chr(10)) AS ls FROM chunks)
SELECT id, sha256(array_to_string(ls[2:4], chr(10))) AS lines_sha, list_filter(ls, lambda x: trim(x) <> '')[1] AS preview FROM l""")  # fmt: skip
def k8_read_range(spark, sf_dir):
    lines = F.split("content", "\n")
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0))
    return chunks(spark, sf_dir).select("id", F.sha2(F.array_join(F.slice(lines, 2, 3), "\n"), 256).alias("lines_sha"), first.alias("preview"))
