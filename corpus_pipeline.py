"""The corpus pipeline: toxic documents go, one of each group of near copies
stays, secrets are blotted out, sources are mixed to their targets, and what is
left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all
but the last return the columns of its documents, others than those of
``documents`` too, whatever their names.

Cases: a null text scores and encodes like an empty one, holds no secret, and
has no words for the mix, which leaves it out; null, empty and blank texts are
copies of one another; a null id, language or source is a value like any other
(null sources are one source, the last); rows that repeat in full are one
document from the second stage on; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmap.llm import bpe, common, jaccard, mixing, secrets, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more, the one of smallest id stays."""
    return jaccard.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes ``[SECRET]``; all documents stay."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    return mixing.apply(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids)."""
    return bpe.encode(docs, outputs=("n_tokens", "ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Networks, hashes and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.use_checkpoints(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, "stage")
    return docs
