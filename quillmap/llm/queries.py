"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmap.llm import bpe, chat, common, inner, jaccard, mixing, postings, resharding, secrets, substrings, toxicity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.digest(toxicity.score(docs, model))


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return substrings.dedup(docs, outputs=("n_words", "n_removed", "kept_sha256"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.table(spark, sf_dir, "documents", "doc_id", "text"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(common.table(spark, sf_dir, "documents", "doc_id", "text"), outputs=("n_assign", "n_access", "n_hex", "n_random", "base", "spans")))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(common.table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    trial = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.digest(chat.render(chat.reconstruct(chat.events(rows.unionByName(trial)))))


ORACLE_SQL["op10_chat"] = chat.SQL


@query
def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    return resharding.digest(resharding.rewritten(common.table(spark, sf_dir, "documents", "doc_id", "text"), path))


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.clusters(common.table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op3_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op6_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner.top(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE_SQL["op6_inner"] = inner.SQL
ORACLE_SQL["op4_substrings"] = substrings.SQL
ORACLE_SQL["op9_jaccard"] = jaccard.SQL
