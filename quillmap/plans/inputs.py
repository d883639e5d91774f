"""Stand-ins for the engine's frames over the driver's tables, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators import lexical
from quillmap.sources.store import Store, use_checkpoints

#: Folders and file names that give the stand-in paths some variety.
FOLDERS = ["src/core", "tests", "docs", "lib", "dist", "fixtures/a", "packages/x/src", "scripts", "examples", "tools", "reports", "landing", "app/src/core", "config", "Src/Main", "guide/deep"]
NAMES = ["main", "index", "parser_utils", "HttpServer", "readme", "a.test", "settings", "worker"]
ENDS = ["py", "ts", "md", "json", "go", "min.js", "yaml", "rs"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], divisor: int):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("doc_id") / divisor) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], divisor: int) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[(doc_id // {divisor}) % {len(values)} + 1]"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, language, label, content, source, owner."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("", _pick(FOLDERS, 1), F.lit("/"), F.col("source"), F.lit("/"), _pick(NAMES, 3), F.lit("."), _pick(ENDS, 5))
    return d.select(F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), F.concat(F.lit("function f"), "doc_id", F.lit("(x)")).alias("label"), F.col("text").alias("content"), "source", (F.col("doc_id") % 50).alias("owner"), "n_chars")


CHUNKS = f"""chunks AS (
  SELECT doc_id AS id, {_pick_sql(FOLDERS, 1)} || '/' || source || '/' || {_pick_sql(NAMES, 3)} || '.' || {_pick_sql(ENDS, 5)} AS path,
    lang AS language, 'function f' || doc_id || '(x)' AS label, text AS content, source, doc_id % 50 AS owner, n_chars
  FROM documents
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file, owner, embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("file"), (F.col("label") * 50 + F.col("vec_id") % 50).alias("owner"), "embedding")


VECTORS = "vectors AS (SELECT vec_id AS id, vec_id % 50 AS file, label * 50 + vec_id % 50 AS owner, embedding FROM embeddings)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, file, confidence: customer to order to part to supplier."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    level = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("CALLS").alias("type"), (F.col("o_custkey") % 100).alias("file"), F.lit("high").alias("confidence"))
    b = l.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("CALLS").alias("type"), (F.col("l_orderkey") % 100).alias("file"), level.alias("confidence"))
    c = l.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("IMPORTS").alias("type"), (F.col("l_partkey") % 100).alias("file"), level.alias("confidence"))
    return a.unionByName(b).unionByName(c)


EDGES = """edges AS (
  SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'CALLS' AS type, o_custkey % 100 AS file, 'high' AS confidence FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'CALLS', l_orderkey % 100, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'IMPORTS', l_partkey % 100, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END FROM lineitem
)"""


def lexical_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and totals of the chunks, built once a session on shared storage and again when the files change."""
    use_checkpoints(spark)
    shared = Store(spark, f"{spark.sparkContext.getCheckpointDir()}/lexical")
    name = hashlib.sha256(shared.fingerprint(f"{sf_dir}/documents.parquet").encode()).hexdigest()[:16]
    store = Store(spark, f"{shared.root}/{name}")
    if not (at := store.snapshot()):
        store.publish_all(lexical.stage(store, chunks(spark, sf_dir).select("id", "content")))
        at = store.snapshot()
    return store.read("postings", at["postings"]), store.read("totals", at["totals"])


def lexical_scores(spark: SparkSession, sf_dir: str, terms: list[str], mode: str = "all_terms") -> DataFrame:
    """(id, score) of the chunks by the index."""
    return lexical.bm25(*lexical_index(spark, sf_dir), terms, mode=mode)
