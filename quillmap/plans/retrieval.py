"""Retrieval, fusion and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.functions import text
from quillmap.operators import search
from quillmap.plans.inputs import CHUNKS, VECTORS, chunks, lexical_scores, table, vectors
from quillmap.plans.registry import query

TERMS = ["the", "token"]
ANY = ["idiot", "token", "clown", "licensed"]


def r6(c):
    return F.round(c, 6)


def _bm25_sql(terms: list[str], need: int) -> str:
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0 ELSE 0.0 END) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    held = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(terms)))
    return f"""toks AS (SELECT *, list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) <= 255) AS toks FROM chunks),
counted AS (SELECT *, len(toks)::DOUBLE AS dl, {tf} FROM toks),
totals AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, {df} FROM counted),
lexical AS (SELECT id, owner, {score} AS score FROM counted, totals WHERE {held} >= {need})"""


DENSE = "dense AS (SELECT id, file, owner, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM vectors WHERE id = 0)) AS score FROM vectors)"


@query(f"WITH {VECTORS}, {DENSE} SELECT id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, id LIMIT 20")
def j1_dense(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.top(search.cosine(v, v.filter("id = 0")).select("id", "score"), 20).select("id", r6("score").alias("score"))


@query(f"WITH {VECTORS}, {DENSE} SELECT id, round(score, 6) AS score FROM dense WHERE dense.score >= 0.05")
def c12_minimum_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.cosine(v, v.filter("id = 0")).filter("score >= 0.05").select("id", r6("score").alias("score"))


@query(f"WITH {CHUNKS}, {_bm25_sql(TERMS, 2)} SELECT id, round(score, 6) AS score FROM lexical ORDER BY lexical.score DESC, id LIMIT 20")
def j2_lexical_all_terms(spark, sf_dir):
    return search.top(lexical_scores(spark, sf_dir, TERMS), 20).select("id", r6("score").alias("score"))


@query(f"WITH {CHUNKS}, {_bm25_sql(ANY, 1)} SELECT id, round(score, 6) AS score FROM lexical ORDER BY lexical.score DESC, id LIMIT 20")
def j2_lexical_any_terms(spark, sf_dir):
    return search.top(lexical_scores(spark, sf_dir, ANY, "any_terms"), 20).select("id", r6("score").alias("score"))


def _arms(spark, sf_dir, k=80):
    v = vectors(spark, sf_dir)
    dense = search.top(search.cosine(v, v.filter("id = 0")).select("id", "owner", "score"), k)
    lexical = search.top(lexical_scores(spark, sf_dir, ANY, "any_terms"), k).join(chunks(spark, sf_dir).select("id", "owner"), "id")
    return dense, lexical


_FUSED = f"""WITH {CHUNKS}, {VECTORS}, {DENSE}, {_bm25_sql(ANY, 1)},
arms AS (
  SELECT 1 AS arm, * FROM (SELECT id, owner, score FROM dense ORDER BY score DESC, id LIMIT 80)
  UNION ALL SELECT 2, * FROM (SELECT id, owner, score FROM lexical ORDER BY score DESC, id LIMIT 80)
), firsts AS (SELECT *, row_number() OVER (PARTITION BY arm, owner ORDER BY score DESC, id) AS rn FROM arms),
ranked AS (SELECT arm, id, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS rank FROM firsts WHERE rn = 1),
fused AS (SELECT id, sum(1.0::DOUBLE / (100 + rank)) AS score FROM ranked GROUP BY id)
"""


@query(_FUSED + "SELECT id, round(score, 9) AS score FROM fused")
def j5_rrf_owner_dedup(spark, sf_dir):
    return search.fuse(list(_arms(spark, sf_dir))).select("id", F.round("score", 9).alias("score"))


@query(_FUSED + "SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY fused.score DESC, id) AS rank FROM fused ORDER BY fused.score DESC, id LIMIT 10")
def j7_hybrid_search(spark, sf_dir):
    best = search.top(search.fuse(list(_arms(spark, sf_dir))), 10)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
    return ranked.select("id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {CHUNKS}, {_bm25_sql(ANY, 1)}, p1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lexical),
p2 AS (SELECT id, row_number() OVER (ORDER BY n_chars DESC, id) AS rank FROM chunks),
parts AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS pass FROM p1 WHERE rank <= 40 UNION ALL SELECT id, 2.0::DOUBLE / (60 + rank), 1 FROM p2 WHERE rank <= 40)
SELECT id, round(sum(part), 9) AS score, count(DISTINCT pass) AS passes FROM parts GROUP BY id""")  # fmt: skip
def j9_multi_pass_rrf(spark, sf_dir):
    c = chunks(spark, sf_dir)
    lexical = search.top(lexical_scores(spark, sf_dir, ANY, "any_terms"), 40)
    longest = search.top(c.select("id", F.col("n_chars").alias("score")), 40)
    passes = [(p.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), w) for p, w in ((lexical, 1.0), (longest, 2.0))]
    return search.fuse_passes(passes).select("id", F.round("score", 9).alias("score"), "passes")


@query("SELECT conv_id AS id, count(DISTINCT role) AS payloads FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) > 1")
def j6_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role")
    return search.conflicts(rows, ["role"])


@query(f"""WITH {CHUNKS}, found AS (
  SELECT id, path, string_split(content, chr(10)) AS ls FROM chunks
), placed AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)idiot|token')), true) AS line FROM found)
SELECT id, line::INT AS line, greatest(line - 2, 1)::INT AS start_line, least(line + 2, len(ls))::INT AS end_line,
  sha256(array_to_string(ls[greatest(line - 2, 1):least(line + 2, len(ls))], chr(10))) AS window_sha FROM placed WHERE line > 0""")  # fmt: skip
def j14_line_windows(spark, sf_dir):
    found = search.line_windows(chunks(spark, sf_dir).select("id", "content"), ["idiot", "token"])
    return found.select("id", "line", "start_line", "end_line", F.sha2("window", 256).alias("window_sha"))


@query(f"""WITH {CHUNKS}, l AS (SELECT id, path, contains(lower(content), 'licensed under') AS exact, string_split(content, chr(10)) AS ls FROM chunks),
s AS (SELECT *, list_transform(ls, lambda x: (CASE WHEN contains(lower(x), 'licensed under') THEN 10000 ELSE 0 END) + (CASE WHEN regexp_matches(x, '(?i)(^|[^a-z0-9])token([^a-z0-9]|$)') THEN 100 ELSE 0 END)
  + (CASE WHEN regexp_matches(x, '(?i)(^|[^a-z0-9])idiot([^a-z0-9]|$)') THEN 100 ELSE 0 END)) AS worth FROM l),
b AS (SELECT *, list_max(worth) AS evidence FROM s), p AS (SELECT *, list_position(worth, evidence)::INT AS line FROM b WHERE evidence > 0)
SELECT id, line, evidence::INT AS evidence, sha256(array_to_string(ls[greatest(line - 2, 1):least(line + 2, len(ls))], chr(10))) AS window_sha FROM p ORDER BY exact DESC, p.evidence DESC, p.line, path, id LIMIT 128""")  # fmt: skip
def j13_best_lines(spark, sf_dir):
    found = search.best_lines(chunks(spark, sf_dir).select("id", "path", "content"), ["token", "idiot"], phrase="licensed under")
    head = found.orderBy(*search.scan_order(), "id").limit(search.SCAN_FILES)
    return head.select("id", "line", F.col("evidence").cast("int").alias("evidence"), F.sha2("window", 256).alias("window_sha"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
m AS (SELECT label, qid, max(list_dot_product(q, embedding::DOUBLE[])) AS best FROM embeddings, q GROUP BY label, qid)
SELECT label, round(sum(best), 6) AS score FROM m GROUP BY label""")  # fmt: skip
def j18_max_sim(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id < 3").select("embedding")  # the vectors of one query's tokens
    return search.max_sim_groups(e, asked, "label").select("label", r6("score").alias("score"))


@query(f"""WITH {CHUNKS}, t AS (SELECT id, regexp_extract_all(path || ' ' || label, '[\\p{{L}}\\p{{N}}_$]+') AS toks FROM chunks),
c AS (SELECT id, list_transform(toks, lambda t: list_filter(regexp_split_to_array(regexp_replace(regexp_replace(t, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '[_$\\s]+'), lambda p: p <> '' AND p <> t)) AS parts FROM t),
o AS (SELECT id, flatten(parts) AS fl FROM c)
SELECT id, array_to_string(list_filter(fl, lambda p, i: list_position(fl, p) = i), ' ') AS terms FROM o""")  # fmt: skip
def h2_additive_terms(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("id", F.array_join(text.additive_terms(F.concat_ws(" ", "path", "label")), " ").alias("terms"))


@query(f"""WITH {CHUNKS} SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda p: p <> ''), ' ') AS identity,
  lower(regexp_replace(replace(path, '\\', '/'), '^/+', '')) AS search_path, regexp_extract(path, '([^.#:/]+)[.#:/]*$', 1) AS last,
  ceil((length(content) + len(regexp_extract_all(content, '[\\x{{10000}}-\\x{{10FFFF}}]'))) / 4)::BIGINT AS tokens, len(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS lines,
  'path_' || substr(sha256(path || content), 1, 16) AS chunk_key FROM chunks""")  # fmt: skip
def h8_identity_paths_lines(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select(
        "id", text.normalized_identity(F.col("path")).alias("identity"), text.search_path(F.col("path")).alias("search_path"), text.last_segment(F.col("path")).alias("last"),
        text.token_estimate(F.col("content")).alias("tokens"), text.line_count(F.col("content")).alias("lines"), F.concat(F.lit("path_"), F.substring(F.sha2(F.concat("path", "content"), 256), 1, 16)).alias("chunk_key"),
    )


@query(f"""WITH {CHUNKS} SELECT id, regexp_matches(content, '(?i)(^|[^a-z0-9])token([^a-z0-9]|$)') AS has_term,
  CASE WHEN regexp_matches(content, '(?i)\\bnew\\s+token\\b') OR regexp_matches(content, '(?i)\\btoken\\s*\\(') OR regexp_matches(content, '(?i)\\btoken\\b\\s*=') THEN 'executable'
       WHEN regexp_matches(content, '(?i)\\bimport\\s+.*\\btoken\\b') OR regexp_matches(content, '(?i)\\bfrom\\s+.+\\s+import\\s+.*\\btoken\\b') THEN 'import' END AS usage,
  regexp_matches(label, '(?i)\\b(class|def|function|type|interface|enum|struct)\\s+f7\\b') AS declares FROM chunks""")  # fmt: skip
def h4_lexical_evidence(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("id", text.has_term(F.col("content"), "token").alias("has_term"), text.usage_kind(F.col("content"), "token").alias("usage"), text.declares(F.col("label"), "f7").alias("declares"))


_WORD = "regexp_matches({0}, '(^|[^a-z0-9]){1}([^a-z0-9]|$)')"


def _evidence_sql(term: str) -> str:
    words = " OR ".join([_WORD.format("l", term), _WORD.format("c", term), f"len(list_filter(s, lambda f: {_WORD.format('f', term)})) > 0"])
    used = f"(regexp_matches(c, '\\bnew\\s+{term}\\b') OR regexp_matches(c, '\\b{term}\\s*\\(') OR regexp_matches(c, '\\b{term}\\b\\s*=') OR regexp_matches(c, '\\bimport\\s+.*\\b{term}\\b')) AND NOT regexp_matches(c, '\\b(class|def|function|type|interface|enum|struct)\\s+{term}\\b')"
    return f"(({words}) OR contains(l, '{term}') OR contains(p, '{term}') OR contains(c, '{term}')) AS some_{term}, (({words})) AS word_{term}, ({used}) AS used_{term}"


@query(f"""WITH {CHUNKS}, x AS (SELECT id, lower(label) AS l, lower(path) AS p, lower(content) AS c, list_filter(string_split(lower(path), '/'), lambda f: f <> '') AS s FROM chunks),
e AS (SELECT id, contains(l, 'licensed under') OR len(list_filter(s, lambda f: contains(f, 'licensed under'))) > 0 OR contains(c, 'licensed under') AS phrase, {_evidence_sql("token")}, {_evidence_sql("src1")}, {_evidence_sql("core")} FROM x)
SELECT id, phrase OR some_token OR some_src1 OR some_core AS has, phrase OR word_token OR word_src1 AS exact, concat_ws(',', CASE WHEN word_token THEN 'token' END, CASE WHEN word_src1 THEN 'src1' END) AS whole,
 concat_ws(',', CASE WHEN word_token AND NOT used_token THEN 'token' END, CASE WHEN word_src1 AND NOT used_src1 THEN 'src1' END) AS whole_asked, phrase AS exact_asked FROM e""")  # fmt: skip
def h5_lexical_evidence(spark, sf_dir):
    terms = [("token", "whole"), ("src1", "whole"), ("core", "fragment")]
    fields = [F.col("label"), F.col("path"), F.col("content")]
    plain, asked = (text.lexical_evidence(*fields, terms, ["licensed under"], reference=r) for r in (False, True))
    rows = chunks(spark, sf_dir).select("id", plain.alias("e"), asked.alias("a"))
    return rows.select("id", "e.has", "e.exact", F.array_join("e.whole", ",").alias("whole"), F.array_join("a.whole", ",").alias("whole_asked"), F.col("a.exact").alias("exact_asked"))


@query("""WITH l AS (SELECT p_partkey AS id, ([ 'async method ', 'function ', 'class ', 'type ', 'enum ', 'nothing ', 'macro ', 'async  function  '])[p_partkey % 8 + 1] || replace(p_name, ' ', '_') || (['(a, b)', '<T>', ' extends X', ''])[p_partkey % 4 + 1] AS label FROM part),
c AS (SELECT id, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label FROM l),
k AS (SELECT id, label, coalesce(regexp_extract(label, '^(?:async )?(method|function) .+$', 1), '') AS k1, coalesce(regexp_extract(label, '^(class|interface|type|enum|trait|module|namespace|macro) .+$', 1), '') AS k2, regexp_extract(label, '^(?:async )?[a-z]+ (.+)$', 1) AS rest FROM c),
j AS (SELECT id, rest, CASE WHEN k1 <> '' THEN k1 ELSE k2 END AS kind FROM k)
SELECT id, CASE WHEN kind <> '' THEN kind END AS kind,
  CASE WHEN kind IN ('class', 'interface', 'type') THEN trim(split_part(trim(regexp_extract(rest, '^[^<(]*')), ' ', 1)) WHEN kind <> '' THEN trim(split_part(rest, '(', 1)) END AS name FROM j""")  # fmt: skip
def h17_label_parser(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    heads = F.array(*map(F.lit, ["async method ", "function ", "class ", "type ", "enum ", "nothing ", "macro ", "async  function  "]))
    tails = F.array(*map(F.lit, ["(a, b)", "<T>", " extends X", ""]))
    label = F.concat(F.element_at(heads, (F.col("p_partkey") % 8 + 1).cast("int")), F.regexp_replace("p_name", " ", "_"), F.element_at(tails, (F.col("p_partkey") % 4 + 1).cast("int")))
    return p.select(F.col("p_partkey").alias("id"), text.label_kind(label).alias("s")).select("id", "s.kind", "s.name")


@query("""SELECT event_id, CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 1440 THEN 'aging' ELSE 'stale' END AS bucket
FROM (SELECT event_id, greatest(0, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 60e6 AS age FROM events)""")
def h11_staleness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.staleness(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("bucket"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 0.95 WHEN 'A' THEN 0.65 ELSE 0.35 END::DOUBLE AS confidence FROM lineitem")
def h12_confidence(spark, sf_dir):
    level = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.confidence(level).alias("confidence"))


@query(f"""WITH {CHUNKS} SELECT id, CASE regexp_extract(lower(path), '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' ELSE 'text' END AS detected FROM chunks""")
def h16_language(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", text.language_of(F.col("path")).alias("detected"))


@query(f"""WITH {CHUNKS}, w AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(content, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda p: p <> ''))) AS term FROM chunks)
SELECT term, count(*) AS docs FROM w WHERE term IN ('the', 'and', 'written', 'build', 'token', 'of', 'created', 'emit') GROUP BY term""")  # fmt: skip
def h21_line_tokens(spark, sf_dir):
    words = chunks(spark, sf_dir).select("id", F.explode(F.array_distinct(text.line_tokens(F.col("content")))).alias("term"))
    return words.filter(F.col("term").isin("the", "and", "written", "build", "token", "of", "created", "emit")).groupBy("term").agg(F.count("*").alias("docs"))


@query(f"""WITH {CHUNKS} SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, array_to_string(list_slice(string_split(path, '/'), 1, -3), '/') || CASE WHEN len(string_split(path, '/')) > 2 THEN '/' ELSE '' END || 'util/x' AS module FROM chunks""")
def h18_module_path(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return c.select("id", "folder", text.module_path(F.col("folder"), F.lit("./.././util/x")).alias("module"))
