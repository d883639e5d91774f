import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from quillmap.llm import common, components, jaccard


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= threshold * union - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.digest(jaccard.clusters(df)).collect()), key=str)


def near(rng, words, share):
    return [rng.choice(["aa", "bb", "cc"]) if rng.random() < share else w for w in words]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):
        base = rng.choices(vocab, k=rng.randint(30, 200))
        for share in [0, 0, 0.005, 0.01, 0.02, 0.03, 0.05][: rng.randint(1, 7)]:
            rows.append(" ".join(near(rng, base, share)))
    big = rng.choices(vocab, k=150)
    rows += [" ".join(near(rng, big, 0.012)) for _ in range(60)]
    rows = list(enumerate(rows, 1))
    rows += [(None, rows[0][1]), (1, rows[0][1]), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "one"), (None, "alone here"), (906, "long " * 20_000), (907, "long " * 20_001)]
    want = brute(rows)
    assert run(spark, rows) == want
    # with blocks so small that prefixes and clusters are split
    monkeypatch.setattr(jaccard, "PREFIX_BLOCK", 8)
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 16)
    assert run(spark, rows) == want


def test_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_prefix_and_estimate():
    assert 1 - (1 - 0.8 ** jaccard.prefix_length(0.8)) ** jaccard.TREES >= jaccard.RECALL
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    other = np.r_[base[:340], rng.integers(0, 1 << 63, 60).astype(np.uint64)]
    s = jaccard.signatures(np.r_[base, other], np.array([400, 400]))
    assert abs((s[0] == s[1]).mean() - 340 / 460) < 0.1


def subtree(labels, signatures, key=None):
    """A table as tasks get it, all in tree 0."""
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    n = len(order)
    return pa.table({"key": pa.array([0] * n), "tree": pa.array([0] * n, pa.int32()), "node": pa.array([bytes([i]) for i in order], pa.binary()), "block": pa.array([0] * n, pa.int32()), "x": pa.array([0] * n, pa.int32()), "y": pa.array([0] * n, pa.int32()), "signature": pa.array([signatures[i] for i in order], pa.binary())})


def signature_like(base, share, rng, label):
    """Differs from the base in a share of its bytes, or, if that is None, in the first byte of every other tree's label."""
    out = base.copy()
    if share is None:
        out[8::8] ^= np.uint8(1)
        out[:8] = label
        return out.tobytes()
    other = rng.choice(np.arange(8, len(base)), round(share * len(base)), replace=False)
    out[other] ^= np.uint8(1)
    out[:8] = label
    return out.tobytes()


def test_prefixes_are_shortened_as_far_as_pairs_need():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, jaccard.TREES * jaccard.DEPTH).astype(np.uint8)
    label = base[:8].copy()
    short, seven = label.copy(), label.copy()
    short[6], seven[7] = label[6] ^ 1, label[7] ^ 1
    least, thr = 0.66 * 256, 0.8

    def ended(*rows):
        labels = [bytes(x) for x, _ in rows]
        table = subtree(labels, [signature_like(base, s, rng, x) for x, s in rows])
        tied, roots, at = jaccard.compare(table, jaccard.prefix_length(thr), thr, least)
        return at.tolist(), len(tied)

    # near copies: the walk ends at the whole label, whatever lies farther up
    assert ended((label, 0.0), (label, 0.01)) == ([8], 1)
    assert ended((label, 0.0), (label, 0.01), (short, None)) == ([8], 1)
    # a pair near the threshold keeps it going, and so does a subtree without any
    assert ended((label, 0.0), (label, 0.19), (short, None)) == ([6], 2)
    assert ended((label, 0.0), (short, None)) == ([6], 1)
    assert ended((label, 0.0), (seven, None)) == ([7], 1)
    # no more than the shortest prefix is ever matched
    five = label.copy()
    five[5] ^= 1
    assert ended((label, 0.0), (five, 0.0)) == ([6], 0)


def test_bitmap_lets_all_wanted_rows_through(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    wanted = spark.range(0, 20_000, 97).withColumnRenamed("id", "w")
    got = {r.k for r in jaccard.maybe_in(rows, "k", wanted, "w").collect()}
    assert got >= set(range(0, 20_000, 97)) and len(got) < 300
    assert jaccard.maybe_in(rows, "k", wanted.limit(0), "w").collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    lonely = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {k: v for k, v in root.items() if k not in lonely}
