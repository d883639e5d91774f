import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quillmap.llm import common, inner, postings, queries


def rows_of(kind, n=600, d=12):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, d))
    elif kind == "lengths":
        x = rng.normal(size=(n, d)) * rng.exponential(size=(n, 1)) * 3
    else:
        x = np.round(rng.normal(size=(n, d)), 0)
    rows = [(i, [float(np.float32(v)) for v in r], i) for i, r in enumerate(x)]
    rows += [(10_000 + i, rows[1][1], 0) for i in range(300)]
    rows += [(20_000, None, 0), (20_100, [0.0] * d, 0), (20_200, [None] + [1.0] * (d - 1), 0), (20_300, [math.nan] * d, 0), (20_400, [math.inf] * d, 0), (20_500, [1.0], 0), (None, [1.0] * d, 0), (20_600, [], 0)]
    return rows


def good(rows, zero, d=12):
    return [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("kind", ["clusters", "lengths", "ties"])
def test_inner_products(spark, kind, monkeypatch):
    rows = rows_of(kind)
    points = good(rows, True)
    want = []
    whole = [(i, np.floor(256 * v).astype(int)) for i, v in points]
    for q, a in whole:
        if q % 50 == 0:
            found = sorted((-int(a @ b), i) for i, b in whole if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    got = sorted(tuple(r) for r in inner.top(frame(spark, rows)).collect())
    assert got == sorted(want)
    for name, value in (("BLOCK", 100), ("QUERIES", 3), ("CHUNK", 16), ("LEADERS", 8), ("ROUNDS", (1, 64))):
        monkeypatch.setattr(inner, name, value)
    assert sorted(tuple(r) for r in inner.top(frame(spark, rows)).collect()) == sorted(want)


def test_bounds_are_handed_on(spark, monkeypatch):
    """With lengths far apart, short bands are not read at all once longer ones have set the bounds."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8)) * np.exp(rng.normal(size=(4000, 1)))
    df = frame(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])
    monkeypatch.setattr(inner, "LEADERS", 4)
    met = spark.sparkContext.accumulator(0)
    real = inner.scan

    def counted(vecs, queries, *rest):
        met.add(vecs.num_rows * queries.num_rows)
        return real(vecs, queries, *rest)

    monkeypatch.setattr(inner, "scan", counted)
    inner.top(df).collect()
    assert met.value < 0.5 * 4000 * 80


def test_inner_edges(spark):
    df = frame(spark, [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0)])
    assert [tuple(r) for r in inner.top(df).collect()] == [(0, 1, 3, 65536)]
    assert inner.top(df.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [4, 512])
def test_inner_hot_id(spark, monkeypatch, chunk):
    monkeypatch.setattr(inner, "CHUNK", chunk)
    # equal lengths lie in one block; one id more than fills its places, and the others still follow it
    rows = [(0, [25.0, 0.0], 0)] + [(7, [[25.0, 0.0], [24.0, 7.0]][i % 2], 0) for i in range(40)]
    rows += [(i, v, 0) for i, v in enumerate([[24.0, 7.0], [20.0, 15.0], [15.0, 20.0], [7.0, 24.0], [0.0, 25.0]], 1)]
    want = [(0, r, i, 65536 * 25 * s) for r, (i, s) in enumerate([(7, 25), (1, 24), (2, 20), (3, 15), (4, 7)], 1)]
    assert sorted(tuple(r) for r in inner.top(frame(spark, rows)).collect()) == want
    assert sorted(tuple(r) for r in inner.top(frame(spark, rows[:43])).collect()) == want[:3]


def exact(points, k=10):
    out = {}
    for q, a in points:
        if q % 100 == 0:
            out[q] = sorted((math.sqrt(((a - b) ** 2).sum()), i) for i, b in points if i != q)[:k]
    return out


@pytest.mark.parametrize("kind", ["clusters", "ties"])
def test_neighbours(spark, kind):
    rows = rows_of(kind)
    want = exact(good(rows, False))
    got = postings.search(frame(spark, rows), settings=postings.Settings(list_size=40, block=64)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    assert set(found) == set(want)
    true = dict(good(rows, False))
    hits = 0
    for q, pairs in found.items():
        assert pairs == sorted(pairs) and len(pairs) == 10
        for s, i in pairs:
            assert s == pytest.approx(math.sqrt(((true[q] - true[i]) ** 2).sum()), abs=1e-12)
        hits += len({i for _, i in pairs} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("kind", ["plain", "clusters"])
def test_recall_by_default_settings(spark, kind, monkeypatch):
    """50,000 vectors, with and without structure; lists are skipped, and with structure nearly all are."""
    rng = np.random.default_rng(9)
    n, d = 50_000, 32
    x = rng.normal(size=(n, d)) if kind == "plain" else 3 * rng.normal(size=(300, d))[rng.integers(0, 300, n)] + 0.4 * rng.normal(size=(n, d))
    x = np.float32(x).astype(float)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float64()))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": flat})).repartition(8)
    met = spark.sparkContext.accumulator(0)
    real = postings.nearest

    def counted(lists, queries, k):
        met.add(lists.num_rows * queries.num_rows)
        return real(lists, queries, k)

    monkeypatch.setattr(postings, "nearest", counted)
    found = {}
    for r in postings.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 100):
        near = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")
        hits += len(found[q] & set(near[near != q][:10].tolist()))
    assert hits >= 0.9 * 10 * len(found)
    assert met.value < (0.8 if kind == "plain" else 0.1) * n * len(found)


def test_neighbour_edges(spark):
    df = frame(spark, [(0, [1.0, 2.0], 0), (7, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (0, [1.0, 2.0], 0)])
    assert [tuple(r) for r in postings.search(df).collect()] == [(0, 1, 7, 2.0)]
    assert postings.search(df.limit(0)).collect() == []


def test_neighbour_hot_id(spark):
    # one id more than fills a block's places; the others still follow it, with their own distances
    rows = [(0, [1.0, 1.0], 0)] + [(7, [1.0, 1.0 + (1 + i % 3) / 8], 0) for i in range(60)] + [(i, [1.0, 1.0 + i / 4], 0) for i in (*range(1, 7), *range(8, 15))]
    got = sorted(tuple(r) for r in postings.search(frame(spark, rows)).collect())
    assert got == [(0, r, i, s) for r, (i, s) in enumerate([(7, 0.125), *((i, i / 4) for i in (1, 2, 3, 4, 5, 6, 8, 9, 10))], 1)]
    assert [r.vec_id for r in sorted(postings.search(frame(spark, rows[:63])).collect(), key=lambda r: r.rank)] == [7, 1, 2]


def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = common.table(spark, sf, "embeddings", "vec_id", "embedding").collect()
    points = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in rows]
    want = exact(points)
    got = queries.op3_postings(spark, sf).collect()
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert len(got) == sum(map(len, want.values())) and hits >= 0.9 * len(got)
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(c.sql(inner.SQL).fetchall()) == sorted(tuple(r) for r in queries.op6_inner(spark, sf).collect())
