import re
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmap.llm import bpe, common, mixing, secrets
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).checkpoint()
    assert clean.schema.names == docs.schema.names
    assert 0.7 * docs.count() < clean.count() <= docs.count()

    single = stages["near copies"](spark, clean, SF).checkpoint()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert single.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in brute(rows)})

    safe = stages["secrets"](spark, single, SF).checkpoint()
    before = {r.doc_id: r for r in single.collect()}
    encoder = secrets.vocabulary(common.tokenizer_path("byte_bpe_50k.tiktoken"), secrets._pattern())
    for r in safe.collect():
        spans = secrets.scan_text(before[r.doc_id].text, encoder)[1]
        assert r.text == secrets.redact_text(before[r.doc_id].text, spans) and r.n_chars == len(r.text)

    mixed = stages["mixing"](spark, safe, SF).checkpoint()
    assert mixed.schema.names == docs.schema.names
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = Counter()
    for r in mixed.collect():
        words[r.source] += count(r.text)
        assert r.n_chars == len(r.text)
    for r in mixing.taken(safe).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= 1

    library = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    got = Counter((r.doc_id, tuple(r.ids)) for r in stages["encoding"](spark, mixed, SF).collect())
    assert got == Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == got


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string"
    rows = [(1, "a b c d e f", "en", "s", 11, "x")] * 3 + [(2, None, None, None, None, None), (None, "z " * 400, "en", "s", 5, "x"), (None, "z " * 400, "en", "s", 5, "x"), (3, "", "en", None, 0, "x")]
    docs = spark.createDataFrame(rows, schema)
    for name in ("_turn", "score", "node", "row_key", "size", "bucket", "_WORDS"):
        docs = docs.withColumn(name, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
    encoding = dict(corpus_pipeline.STAGES)["encoding"]
    encoded = encoding(spark, docs, SF).collect()
    assert len(encoded) == len(rows) and encoding(spark, docs.limit(0), SF).collect() == []
    assert all((r.n_tokens == 0) == (r.doc_id in (2, 3)) and r.n_tokens == len(r.ids) for r in encoded)
    kept = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs, SF).collect()]
    assert len(kept) == 3 and (1, "a b c d e f") in kept
