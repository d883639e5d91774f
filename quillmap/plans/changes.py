"""Scans, change sets, checkpoints and store operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.operators import changes
from quillmap.plans.inputs import CHUNKS, chunks, table
from quillmap.plans.registry import query
from quillmap.sources import scan, store

_OLD_NEW = """old AS (SELECT 's/' || doc_id AS path, sha256(text) AS hash, n_chars AS size, doc_id AS mtime FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT 's/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 1)"""


def _old_new(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("s/"), "doc_id"))
    old = d.filter("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 10 <> 1").select("path", text.alias("content"), F.length(text).cast("long").alias("size"), F.col("doc_id").alias("mtime"), F.sha2(text, 256).alias("hash"))
    return old, new


_DIFF = "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM old o FULL JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash"


@query(f"WITH {_OLD_NEW} {_DIFF}")
def g1_change_diff(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return changes.diff(old, new)


@query(f"WITH {_OLD_NEW.replace('new AS', 'fresh AS')}, new AS (SELECT path, hash FROM fresh UNION ALL SELECT path, hash FROM old WHERE (path = 's/1' OR path = 's/11' OR starts_with(path, 's/1/')) AND path NOT IN (SELECT path FROM fresh)) {_DIFF}")
def m8_partial_scan_guard(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return changes.diff(old, changes.guarded(new, old, ["s/1", "s/11"]))


@query(f"WITH {_OLD_NEW} SELECT n.path, CASE WHEN o.path IS NOT NULL AND doc_id % 7 <> 0 THEN o.hash ELSE n.hash END AS hash, NOT (o.path IS NOT NULL AND doc_id % 7 <> 0) AS rehashed FROM new n JOIN documents d ON n.path = 's/' || doc_id LEFT JOIN old o ON o.path = n.path")
def a2_reuse_hashes(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return changes.reuse_hashes(new.drop("hash"), old)


@query("""WITH f AS (SELECT 's/' || doc_id AS path, sha256(text) AS hash FROM documents), b AS (SELECT substr(sha256(path), 1, 3) AS bucket, sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path)) AS root FROM f GROUP BY 1)
SELECT sha256(string_agg(bucket || chr(0) || root || chr(10), '' ORDER BY bucket)) AS root FROM b""")  # fmt: skip
def e8_merkle_root(spark, sf_dir):
    return changes.bucketed_root(table(spark, sf_dir, "documents").select(F.concat(F.lit("s/"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash")))


@query(f"""WITH {CHUNKS}, p AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix FROM chunks WHERE id % 3 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) FROM chunks WHERE id % 32 = 0)
SELECT prefix FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.prefix, b.prefix || '/'))""")  # fmt: skip
def g5_prefix_compression(spark, sf_dir):
    c = chunks(spark, sf_dir)
    folders = c.filter("id % 3 = 0").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("prefix"))
    roots = c.filter("id % 32 = 0").select(F.split("path", "/")[0].alias("prefix"))
    return changes.compressed_prefixes(folders.union(roots).distinct())


@query("""WITH p AS (SELECT source AS path, n_chars % 9 AS start_line, n_chars % 9 + 5 AS end_line, lang AS language, (n_chars % 13)::DOUBLE AS score, (n_chars % 17)::DOUBLE AS backend_score, (['primary', 'expanded', 'overlay'])[doc_id % 3 + 1] AS pass FROM documents)
SELECT path, start_line, end_line, language, sum(score) AS score, max(backend_score) AS backend_score, array_to_string(list_sort(list(DISTINCT pass)), ',') AS passes FROM p GROUP BY ALL""")  # fmt: skip
def g2_merge_passes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.element_at(F.array(F.lit("primary"), F.lit("expanded"), F.lit("overlay")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = d.select(F.col("source").alias("path"), (F.col("n_chars") % 9).alias("start_line"), (F.col("n_chars") % 9 + 5).alias("end_line"), F.col("lang").alias("language"), (F.col("n_chars") % 13).cast("double").alias("score"), (F.col("n_chars") % 17).cast("double").alias("backend_score"), name.alias("pass"))
    return changes.merge_passes(rows)


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def g4_unique_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).dropDuplicates()


@query("SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def g6_fallback_edges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return l.select("src", "dst").distinct().join(l.filter("l_returnflag = 'R'").select("src", "dst"), ["src", "dst"], "left_anti")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 4 = 0")
def b1_upsert_and_delete(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    kept = store.deleted(d, d.filter("id % 9 = 0"))
    return store.upserted(kept, d.filter("id % 4 = 0").withColumn("source", F.lit("new")))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'only_left' WHEN doc_id % 10 = 0 THEN 'only_right' ELSE 'differs' END AS problem FROM documents WHERE doc_id % 10 IN (0, 1) OR doc_id % 7 = 0")
def b11_store_parity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    left = d.filter("id % 10 <> 0")
    right = d.filter("id % 10 <> 1").withColumn("text", F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return store.parity(left, right, "id", ["text", "lang"])


@query("SELECT count(*) AS n FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def b12_count_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter((F.col("lang") == "en") & F.col("source").isin("src1", "src2")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, source FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 25")
def a13_query_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("id"), "source").orderBy("id").limit(25)


@query(f"""WITH {CHUNKS} SELECT id, regexp_matches(lower(path), '\\.(py|ts|go|rs|js)$') AS by_extension, NOT contains(content, chr(0)) AND strlen(content) <= 1048576 AS as_text,
 regexp_matches(path, '^(.*/)?dist(/.*)?$') OR regexp_matches(path, '^(.*/)?[^/]*\\.min\\.js(/.*)?$') AS is_ignored FROM chunks""")  # fmt: skip
def a5_index_policy(spark, sf_dir):
    c = chunks(spark, sf_dir)
    policy = scan.Policy(extensions=("py", "ts", "go", "rs", "js"), ignore=("dist", "*.min.js"))
    return c.select("id", policy.by_extension(F.col("path")).alias("by_extension"), policy.is_text(F.col("content").cast("binary")).alias("as_text"), policy.is_ignored(F.col("path")).alias("is_ignored"))


@query("""WITH s AS (SELECT p_partkey AS n, (['M ', ' M', '??', '!!', 'A ', 'D '])[p_partkey % 6 + 1] || (CASE p_partkey % 5 WHEN 0 THEN ' "src/a \\"f' || p_partkey || '.py"' WHEN 1 THEN ' ../out' WHEN 2 THEN ' /src\\f' || p_partkey || '.py' ELSE ' src/f' || p_partkey || '.py' END) AS line FROM part
 UNION ALL SELECT s_suppkey + 1000000, 'R  old/' || s_suppkey || ' -> new/' || s_suppkey FROM supplier),
p AS (SELECT n, line, trim(CASE WHEN contains(line, ' -> ') THEN split_part(line, ' -> ', 2) ELSE substr(line, 4) END) AS raw FROM s WHERE NOT starts_with(line, '!!') AND NOT starts_with(line, '??')),
u AS (SELECT n, CASE WHEN starts_with(raw, '"') THEN replace(replace(raw[2:-2], '\\"', '"'), '\\\\', '\\') ELSE raw END AS raw FROM p),
c AS (SELECT n, regexp_replace(replace(raw, '\\', '/'), '^/+', '') AS path FROM u) SELECT n, path FROM c WHERE path <> '' AND path <> '..' AND NOT starts_with(path, '../')""")  # fmt: skip
def a14_git_status(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    marks = F.array(*map(F.lit, ["M ", " M", "??", "!!", "A ", "D "]))
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k, F.lit(".py"))
    body = F.when(k % 5 == 0, F.concat(F.lit(' "src/a \\"'), name, F.lit('"'))).when(k % 5 == 1, F.lit(" ../out")).when(k % 5 == 2, F.concat(F.lit(" /src\\"), name)).otherwise(F.concat(F.lit(" src/"), name))
    a = p.select(k.alias("n"), F.concat(F.element_at(marks, (k % 6 + 1).cast("int")), body).alias("line"))
    b = s.select((F.col("s_suppkey") + 1000000).alias("n"), F.concat(F.lit("R  old/"), "s_suppkey", F.lit(" -> new/"), "s_suppkey").alias("line"))
    return scan.git_status(a.unionByName(b))


@query(f"""WITH {CHUNKS} SELECT id, regexp_matches(lower(path), '\\.(ts|tsx|js|jsx|mjs|cjs|py|java|cpp|c|h|hpp|cs|go|rs|php|rb|swift|kt|scala|m|mm|md|markdown|mdx|rst|txt|adoc|ipynb)$') AS minimal,
 regexp_matches(lower(path), '\\.(ts|tsx|js|jsx|mjs|cjs|py|java|cpp|c|h|hpp|cs|go|rs|php|rb|swift|kt|scala|m|mm|md|markdown|mdx|rst|txt|adoc|ipynb|toml|yaml|yml|json|jsonc|ini|cfg|conf|properties|xml|sh|bash|zsh|fish|ps1|bat|cmd|sql|graphql|gql|tf|tfvars)$') AS standard,
 regexp_matches(path, '^(.*/)?(dist|build|out|target|coverage|logs|tmp|temp|node_modules)(/.*)?$') OR regexp_matches(path, '\\.(min\\.js|min\\.css|map|log|lock|pem|key|db)$') AS is_ignored FROM chunks""")  # fmt: skip
def a6_profiles_and_patterns(spark, sf_dir):
    minimal, standard = scan.Policy.of_profile("minimal"), scan.Policy()
    p = F.col("path")
    return chunks(spark, sf_dir).select("id", minimal.by_extension(p).alias("minimal"), standard.by_extension(p).alias("standard"), standard.is_ignored(p).alias("is_ignored"))


@query("SELECT sha256(string_agg('s/' || s_suppkey || chr(0) || sha256(s_name) || chr(10), '' ORDER BY 's/' || s_suppkey)) AS root FROM supplier")
def e8_checkpoint_root(spark, sf_dir):
    """The root of one small checkpoint, over the lines themselves."""
    s = table(spark, sf_dir, "supplier")
    return changes.merkle(s.select(F.concat(F.lit("s/"), "s_suppkey").alias("path"), F.sha2("s_name", 256).alias("hash")))
