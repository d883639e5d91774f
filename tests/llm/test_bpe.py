import hashlib
import unicodedata
from functools import lru_cache
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmap.llm import bpe, common

PATH = common.tokenizer_path("word_bpe_49k.json")


@lru_cache
def any_library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return any_library()


def same(library, ours, texts):
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    decoded = library.decode_batch(wanted, skip_special_tokens=False)
    for t, (ids, text), want, plain in zip(texts, ours.encode_texts(texts), wanted, decoded, strict=True):
        assert ids == " ".join(map(str, want)), t
        assert text == plain
    flat, at = ours.encode_flat(texts)
    for want, start, end in zip(wanted, at, at[1:], strict=False):
        assert flat[start:end].tolist() == want


def test_special_cases(library):
    ours = bpe.WordBpe(PATH)
    same(library, ours, [None, "", " \t\n", "It's I'LL we've don't", "aaaa aaaaaaa !!!!!!! 12345", "ΣΑΣ ΟΔΟΣ İi ß ẞ é ͅ", "<|endoftext|>a<|startoftext|> <|endoftext|><|END", "x y z\x1c\x1f\x85w", "a" * 3000 + "bc" * 2000 + "!?" * 500, "mañana çéè 漢字かな 👩‍👩‍👧"])


def test_every_character(library):
    """All code points, assigned or not; only surrogates cannot stand in a text."""
    ours = bpe.WordBpe(PATH)
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(texts[i : i + 48]) for i in range(0, len(texts), 48)]
    same(library, ours, texts)


def test_known_characters_go_without_the_library(library):
    """Our own tables agree on every code point that they know."""
    ours = bpe.WordBpe(PATH)
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = ["".join(texts[i : i + 48]) for i in range(0, len(texts), 48)]
    assert not any(map(bpe.has_unknown, texts))
    same(library, ours, texts)


def test_new_compositions(library):
    """Characters that newer tables compose, order or lower otherwise, next to each other."""
    ours = bpe.WordBpe(PATH)
    fresh = [chr(c) for c in [0x105D2, 0x307, 0x11382, 0x113C9, 0x1611E, 0x16129, 0x16D67, 0x16D68, 0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, 0x10D50, 0x897, 0x10EC2, 0x3D097, 0x3F2DD, 0x3E9BE, 0x323AF, 0xE0FFF]]
    same(library, ours, ["".join(p) for n in (1, 2) for p in product(["e", "\u0301", "Σ", "İ", *fresh], repeat=n)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=60), max_size=5))
def test_any_text(texts):
    same(any_library(), bpe.vocabulary(PATH), texts)


def test_frame(spark, library):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    df = spark.createDataFrame([(None, "Ab c", 1), (2, None, 2), (2, None, 2)], "doc_id long, text string, ids int")
    got = bpe.encode(df)
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, 2]
    assert {r.decoded for r in bpe.decode(got).collect()} == {"ab</w> c</w>", ""}
    assert bpe.encode(df.limit(0)).collect() == []
