import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm import chat, queries

TRICKY = ["", None, "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST] <<s>", "a </s", "<s>[INST]user[/INST]x</s>", "é漢😀 [/INST]" * 3, "\n", "[INST", "x" * 100_000 + "</s>"]
ROLES = ["user", "assistant", "system", None, "</s>", "assistant"]


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(r)] for c, r in out.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    rendered = chat.render(chat.reconstruct(chat.events(df)))
    want = expected(rows)
    got = {r.conv_id: r for r in chat.digest(rendered).collect()}
    assert set(got) == set(want)
    texts = {r.conv_id: r.formatted for r in rendered.collect()}
    for conv, turns in want.items():
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        learned = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == len(texts[conv])
        assert texts[conv].count("</s>") == texts[conv].count("[/INST]") == len(turns)


def test_round_trip(spark):
    rows = [(c, t, ROLES[(c + t) % len(ROLES)], TRICKY[(c * 3 + t) % len(TRICKY)]) for c in range(12) for t in range(c % 7 + 1)]
    check(spark, [*rows, (None, None, "user", "x"), (None, 2, "assistant", "y"), (3, 0, "user", "again"), (3, 0, "user", "again")])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "a", "\n"]), max_size=12).map("".join), min_size=30, max_size=60))
def test_escaping(texts):
    from pyspark.sql import SparkSession

    check(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), [(i // 3, i % 3, "assistant", t) for i, t in enumerate(texts)])


def test_fold(spark):
    log = [
        (1, 1, 1, "delta", "user", "Hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 3, "delta", "user", "why"),
        (1, 5, 2, "regenerate", "assistant", None), (1, 6, 2, "delta", "assistant", "go"), (1, 7, 2, "delta", "assistant", "od"), (1, 8, 1, "edit", None, "Hi"), (1, 9, 1, "delta", None, "!"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    assert [tuple(r) for r in chat.reconstruct(df).orderBy("message").collect()] == [(1, 1, None, "Hi!"), (1, 2, "assistant", "good")]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.render(chat.reconstruct(chat.events(df)))).collect() == []


def test_oracle(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted(c.sql(chat.SQL).fetchall())
    df = queries.op10_chat(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in df.collect()) == want
