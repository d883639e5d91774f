import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmap.llm import common, substrings


def brute(rows, width=13):
    big = 1 << 62
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, big), big if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (big if i is None else i):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, g int")
    got = substrings.dedup(df, outputs=("n_words", "n_removed", "kept_sha256"), **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def passages(rng, n):
    vocab = [f"w{i}" for i in range(60)] + ["é", "漢字", "a", "the"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(5, 60))) for _ in range(12)]
    base += ["run " * 40, "a b " * 30, "x y z " * 20]
    out = []
    for i in range(n):
        parts = [rng.choice(base) if rng.random() < 0.6 else " ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        out.append((i, rng.choice([" ", "\n", " \t ", "\r\n"]).join(parts)))
    return out


def test_random_texts(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = passages(rng, 80)
        rows += [(None, rows[3][1]), (3, rows[5][1]), (3, rows[5][1]), (200, None), (201, ""), (202, "  \n"), (203, "one two"), (-5, rows[7][1])]
        assert run(spark, rows, group_bytes=2000) == brute(rows)


def test_long_and_periodic(spark):
    rng = random.Random(9)
    long = " ".join(f"t{rng.randint(0, 5000)}" for _ in range(30_000))
    rows = [(1, long), (0, " ".join(long.split()[1000:1100])), (2, "z " * 5000), (5, "z " * 20), (6, "y" * 200_000 + " " + "z " * 13)]
    assert run(spark, rows, group_bytes=50_000) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    rows = [(i, t) for i, t in enumerate([None, "", " ", "\n\t"])]
    assert run(spark, rows) == brute(rows)
    for texts in ([], [None], ["", None, " "]):
        words = substrings.Words(pa.array(texts, pa.string()))
        assert len(words.hash) == 0 and words.counts.tolist() == [0] * len(texts)


def state_of(texts, ids=None):
    """One group's state, all words numbered as if shared."""
    words = substrings.Words(pa.chunked_array([pa.array(texts)]))
    ids = np.arange(len(texts)) if ids is None else np.array(ids)
    return substrings.rows_of(substrings.STATE, [(0, ids.astype(np.int64).tobytes(), substrings.packed(words.counts), substrings.packed(words.index.astype(np.int64) + 1))])


def test_equal_windows_pick_alike():
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(8)]
    for _ in range(30):
        passage = rng.choices(vocab, k=30)
        texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 9)) + passage + rng.choices(vocab, k=rng.randint(0, 9))) for _ in range(6)]
        group = substrings.Group(state_of(texts), 13)
        best, seen = group.picks(), {}
        some = group.windows[[rng.random() < 0.5 for _ in group.windows]]
        assert (group.picks(some)[some] == best[some]).all()
        for at in group.windows:
            key = tuple(group.codes[at : at + 13].tolist())
            assert seen.setdefault(key, best[at]) == best[at]


def test_long_symbols_reach_the_passage():
    rng = random.Random(6)
    passage = [f"p{rng.randint(0, 900)}" for _ in range(2000)]
    texts = [" ".join([f"{i}x{k}" for k in range(20)] + passage + [f"{i}y{k}" for k in range(20)]) for i in range(2)]
    group = substrings.Group(state_of(texts), 13)
    symbols = substrings.long_symbols(group, group.windows)
    found = {}
    for n, a, b in zip(symbols.name.tolist(), symbols.start.tolist(), symbols.end.tolist()):
        found.setdefault(n, []).append((a, b))
    shared = [x for x in found.values() if len({group.doc[a] for a, _ in x}) == 2]
    # one symbol of both texts stands for most of the passage, and equal names stand for equal words
    assert max(b - a for x in shared for a, b in x) > 700
    assert all(len({tuple(group.codes[a:b].tolist()) for a, b in x}) == 1 for x in found.values())


def test_colliding_names_are_told_apart(spark, monkeypatch):
    """With names of a few bits nearly all collide; the words decide all the same."""
    real = substrings.mixed
    rows = passages(random.Random(2), 40)
    pa_rows = pa.table({"g": [0] * len(rows), "doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    halves = [pa_rows.slice(0, 20), pa_rows.slice(20).set_column(0, "g", pa.array([1] * 20))]
    monkeypatch.setattr(substrings, "mixed", lambda x: real(x) >> np.uint64(58) << np.uint64(57))
    got = local(halves)
    assert got == brute(rows)


def local(groups, width=13):
    """All rounds in this process."""

    def exchange(sent, answer):
        rows = pa.concat_tables(sent)
        out = [answer(rows.filter(pc.equal(rows["bucket"], b))) for b in sorted(set(rows["bucket"].to_pylist()))]
        return pa.concat_tables([substrings.REPLY.empty_table(), *out])

    mine = lambda told, g: told.filter(pc.equal(told["g"], g["g"][0].as_py()))
    told = exchange([substrings.send_words(g, 3) for g in groups], lambda t: substrings.number_words(t, 3))
    states = [substrings.numbered(g, mine(told, g), 3) for g in groups]
    told = exchange([substrings.send_names(s, width, 2) for s in states], substrings.shared_names)
    told = exchange([substrings.send_long(s, mine(told, s), width, (2, 2)) for s in states], substrings.settled_symbols)
    told = exchange([substrings.send_windows(s, mine(told, s), width, (2, 3)) for s in states], lambda t: substrings.smaller_ids(t, width))
    gone = [substrings.gone_words(s, mine(told, s), width, 3) for s in states]
    out = [substrings.finish(g, x, ("n_words", "n_removed", "kept_sha256")) for g, x in zip(groups, gone)]
    return sorted((tuple(r.values()) for t in out for r in t.to_pylist()), key=str)


def test_long_symbols_settle_most(monkeypatch):
    """Copies are removed by their long symbols; without these round, the windows alone give the same."""
    rng = random.Random(8)
    text = " ".join(f"t{rng.randint(0, 3000)}" for _ in range(4000))
    rows = [(i, text) for i in range(6)] + [(9, " ".join(text.split()[500:900]))]
    groups = [pa.table({"g": [k] * len(part), "doc_id": [i for i, _ in part], "text": [t for _, t in part]}) for k, part in enumerate((rows[:3], rows[3:]))]
    asked, real = [], substrings.smaller_ids
    monkeypatch.setattr(substrings, "smaller_ids", lambda t, w: asked.append(sum(np.frombuffer(x, np.uint16).sum() for x in t.filter(pc.greater_equal(t["bucket"], 0))["a"].to_pylist())) or real(t, w))
    assert local(groups) == brute(rows)
    # the owner's windows, and a few at the ends of passages
    assert sum(asked) < 4000 + 2400


def test_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows, group_bytes=100_000) == brute(rows)
