import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmap.llm import common, mixing


def wanted(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def verify(got, texts):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    target = wanted(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in got) == sorted(map(count, texts))


def test_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text", "source")
    got = mixing.taken(docs).collect()
    verify(got, [r.text for r in docs.collect()])
    again = mixing.taken(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "x " * 5000, "s"), (3, None, "s"), (4, " \t ", "empty"), (5, "w " * 40, "t"), (6, "é x y", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    verify(mixing.taken(df).collect(), [r[1] for r in rows])
    assert mixing.taken(df.limit(0)).collect() == []


def test_stream_is_interleaved(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    lines, stream = mixing.mix(docs, mixing.Recipe(block_words=256))
    slots = sorted((r.slot, r.s) for r in stream.select("slot", "s").distinct().collect())
    for start in (0, len(slots) // 2):
        seen = {s for _, s in slots[start : start + 30]}
        assert seen == {1, 2, 3}


def test_level(spark):
    import random

    rng = random.Random(7)
    for k in range(6):
        rows = [(float(rng.choice([0, 1, 5, 10 ** rng.randint(0, 9)])) * 2, float(rng.choice([5, 2, 1]))) for _ in range(rng.randint(1, 300))]
        total = sum(c for c, _ in rows) * rng.choice([0.1, 0.5, 0.75, 0.99])
        level = mixing.water_level(spark.createDataFrame(rows, "cap double, w double"), total)
        assert sum(min(c, level * w) for c, w in rows) == pytest.approx(total)
    assert mixing.water_level(spark.createDataFrame([(4.0, 1.0)], "cap double, w double"), 5.0) == float("inf")


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    monkeypatch.setattr(mixing, "CELLS", 16)
    rows = [(i, "w " * (i % 90), f"host{i % 700}") for i in range(3000)]
    verify(mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), [r[1] for r in rows])


def test_heaps_of_repeated_rows(spark):
    rows = [(None, "one two three", "a", i % 2) for i in range(9000)] + [(i, "w " * (i % 30), "b", 0) for i in range(500)] + [(None, None, "c", 0)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    got = mixing.taken(df).collect()
    verify(got, [r[1] for r in rows])
    out = mixing.apply(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len((r.text or "").split())
    for r in got:
        assert abs(words[r.source] - r.target) <= 1
