import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import common, queries, toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    bad = ["grimlot", "vashnek", "drubble"]
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        if i % 5 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", "a", "en"]))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, 5, toxicity.INPUTS))
    real = np.ones((6, 5), bool)
    y = np.array([0, 1, 0, 1, 1.0])

    def loss():
        states = np.concatenate([net.direction(x @ net.p["W" + s] + net.p["b" + s], s).astype(float) for s in "fb"], axis=2)
        p = toxicity.sigmoid(net.pooled(states, real)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradient(x, real, y, np.ones(5))
    for name in ("Wf", "Ub", "bf", "A", "v", "o"):
        at = tuple(rng.integers(0, d) for d in net.p[name].shape)
        before, eps = net.p[name][at], 1e-2
        net.p[name][at] = before + eps
        up = loss()
        net.p[name][at] = before - eps
        down = loss()
        net.p[name][at] = before
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4)


def plain_score(model, text):
    """The whole way from text to score once more, in plain Python."""
    mask = (1 << 64) - 1
    roll, spread = int(toxicity.ROLL), int(toxicity.SPREAD)

    def mix(h):
        h = h * spread & mask
        return h ^ h >> 29

    def code(chars, extra=0):
        return mix(sum(ord(c) * pow(roll, k + 1, 1 << 64) for k, c in enumerate(chars)) + extra & mask)

    tables = [dict(zip(t.keys.tolist(), t.values.tolist())) for t in (model.inputs.words, model.inputs.grams)]
    none = [0.0] * toxicity.VECTOR

    def vector(word):
        marked = f"^{word}$"
        grams = [tables[1].get(code(marked[i : i + n], n), none) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        most = [max(g[j] for g in grams) for j in range(toxicity.VECTOR)] if grams else none
        mean = [sum(g[j] for g in grams) / len(grams) for j in range(toxicity.VECTOR)] if grams else none
        return [*tables[0].get(code(marked), none), *most, *mean, 1.0]

    p, h = {k: v.astype(float).tolist() for k, v in model.net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    times = lambda x, w: [sum(a * row[j] for a, row in zip(x, w)) for j in range(len(w[0]))]

    def walk(xs, side):
        state, out = [0.0] * h, []
        for x in xs:
            a, b = [i + j for i, j in zip(times(x, p["W" + side]), p["b" + side])], times(state, p["U" + side])
            z, r = ([sig(a[k + o] + b[k + o]) for k in range(h)] for o in (0, h))
            new = [math.tanh(a[2 * h + k] + r[k] * b[2 * h + k]) for k in range(h)]
            state = [(1 - z[k]) * new[k] + z[k] * state[k] for k in range(h)]
            out.append(state)
        return out

    words, best = [vector(w) for w in toxicity.words_of(text)], -1e18
    for at in range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE):
        real = words[at : at + toxicity.WINDOW]
        xs = real + [[0.0] * toxicity.INPUTS] * (toxicity.WINDOW - len(real))
        states = [f + b for f, b in zip(walk(xs, "f"), reversed(walk(xs[::-1], "b")))]
        scores = [sum(math.tanh(k + c) * v for k, c, v in zip(times(s, p["A"]), p["c"], p["v"])) for s in states]
        scores = [e if i < len(real) else -1e9 for i, e in enumerate(scores)]
        weights = [math.exp(e - max(scores)) for e in scores]
        pool = [sum(w * s[k] for w, s in zip(weights, states)) / sum(weights) for k in range(2 * h)]
        best = max(best, sum(a * b for a, b in zip(pool, p["o"])) + p["q"][0])
    return sig(model.slope * best + model.shift)


def test_scores_agree_with_plain_python():
    model = toxicity.fit(*corpus(120), steps=60)
    held = [*corpus(12, seed=4)[0], "", "one", "漢字" * 40 + " grimlot " + "x" * 90, None]
    got = toxicity.Scorer(model).score(held)
    assert got == pytest.approx([plain_score(model, t) for t in held], abs=2e-5)


def test_vectors_are_learned_without_leanings():
    texts, labels = corpus(600)
    model = toxicity.fit(texts, labels, leanings=False)
    held, truth = corpus(200, seed=2)
    p = toxicity.Scorer(model).score(held)
    toxic = np.array(truth) == 1
    assert np.mean([(a > b) + 0.5 * (a == b) for a in p[toxic] for b in p[~toxic]]) > 0.95


def test_repeated_rows_of_a_label_are_one(spark):
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(a, "b")] * 50 + [(a, "a")] * 50 + [(a, None)] * 5 + [(b, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels) == [("", 0), ("b", 1)]


def test_learns_unseen_forms_and_windows():
    texts, labels = corpus(600)
    model = toxicity.fit(texts, labels)
    held, truth = corpus(200, seed=2)
    held[0] = " ".join(held[1:41]) + " vashnekol " + " ".join(held[41:60])
    truth[0] = 1
    p = toxicity.Scorer(model).score(held)
    toxic = np.array(truth) == 1
    assert (p[toxic] >= 0.7).mean() > 0.95
    assert (p[~toxic][1:] >= 0.7).mean() < 0.03


def test_windows_cover_everything():
    for n in (0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 1000):
        w = toxicity.windows(np.arange(1, n + 1))
        assert set(w.ravel()) - {0} == set(range(1, n + 1))
        assert w.shape[1] == toxicity.WINDOW


def test_term_behind_the_start_of_a_run():
    texts, labels = corpus(600)
    texts = [t if i % 2 else "".join(t.split()) for i, t in enumerate(texts)]
    model = toxicity.fit(texts, labels)
    held, truth = corpus(200, seed=5)
    clean = [r for r in ("".join(t.split()) for t, y in zip(held, truth) if not y) if len(r) > 120]
    planted = [r[: 60 + i % 50] + ["grimlot", "vashnek", "drubble"][i % 3] + r[60 + i % 50 :] for i, r in enumerate(clean)]
    score = toxicity.Scorer(model).score
    assert (score(planted) >= 0.7).mean() > 0.95
    assert (score(clean) >= 0.7).mean() < 0.03


def test_pieces_cover_long_runs():
    for n in (1, 39, 40, 41, 47, 48, 49, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        words = toxicity.words_of(f"Ab {run}, c")
        assert words[0] == "ab" and words[-1] == "c" and (n > toxicity.LETTERS or words[1:-1] == [run])
        # each n-gram of the run is whole in a piece
        assert all(any(run[i : i + 5] in w for w in words) for i in range(max(1, n - 4)))


def test_coded_in_parts(monkeypatch):
    model = toxicity.fit(*corpus(60))
    words = toxicity.words_of(" ".join(corpus(5, seed=3)[0]))
    whole = model.inputs.features(words)
    monkeypatch.setattr(toxicity, "CODED", 7)
    assert (model.inputs.features(words) == whole).all() and model.inputs.features([]).shape == (0, toxicity.INPUTS)


def test_cases(spark):
    texts, labels = corpus(120)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, None), (500, "", "x"), (501, None, "x"), (502, texts[0] * 500, "x"), (0, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    truth = spark.createDataFrame([(i, y, 1) for i, y in enumerate(labels)] + [(3, None, 0), (None, 1, 0), (0, 0, 0)], "doc_id long, toxic int, score int")
    model = toxicity.train(docs, truth)
    got = toxicity.digest(toxicity.score(docs, model)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r.score for r in got}
    assert by[500] == by[501] == by[None] < 0.7
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.train(docs, truth.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_table_held_out(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.01")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels", "doc_id", "toxic")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85
    assert got.agg(F.count("*")).first()[0] == 1000
