"""BPE encoding and decoding in batched numpy merge rounds.

The distinct pieces of a batch lie one behind the other in one flat symbol
array. A round looks every adjacent pair up by binary search over the sorted
pair keys, takes the lowest rank of each piece and merges all its occurrences,
left to right. A merge's result arises from one pair only (checked when the
file is read), so a pair made by a merge always ranks after it and merging all
occurrences at once equals merging one at a time.

Cases: a null text counts as empty (no tokens, decoded text empty); repeated
rows are encoded alike; every input row gives one output row; special tokens
written in a text become their own ids. A text with a code point that Python's
character tables do not know (unassigned, or newer than they are) is normalized
and cut into pieces by the tokenizers library's own tables, which may know it;
its pieces go through the same merge rounds.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmap.llm import common

#: Pieces whose encoding a worker keeps.
CACHE_PIECES = 120_000
NO_RANK = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


@lru_cache(maxsize=1)
def unknown_characters() -> np.ndarray:
    """For every code point whether Python's tables do not know it."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


def has_unknown(text: str) -> bool:
    return not text.isascii() and bool(unknown_characters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.token_of = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same symbol; merging all occurrences at once would not be exact")
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.library = Tokenizer.from_file(path)
        self.ids_text: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.number: dict[str, int] = {}
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        """The normalized pieces of a text; special tokens stay as they are, marked by a leading space."""
        if self.split_special is None or "<|" not in text:
            return self.plain_pieces(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(" " + part)
            elif part:
                out += self.plain_pieces(part)
        return out

    def plain_pieces(self, text: str) -> list[str]:
        if has_unknown(text):
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.piece.findall(normalized(text))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all pieces in one array, and where each piece ends in it."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            at = np.searchsorted(self.keys, key := symbols[:-1] << 32 | symbols[1:])
            at[at == len(self.keys)] = 0
            rank = np.full(len(symbols), NO_RANK)
            same = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][same] = self.ranks[at[same]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(symbols)])
            each = np.repeat(lowest, lengths)
            over = each == NO_RANK
            if over.any():
                done.append((owner[over], symbols[over]))
                if over.all():
                    break
            hit = (rank == each) & ~over
            # in a row of overlapping hits every second one counts
            places = np.flatnonzero(hit)
            new_run = np.r_[True, np.diff(places) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = ~over
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate([o for o, _ in done])
        order = np.argsort(owner, kind="stable")
        symbols = np.concatenate([s for _, s in done])[order]
        return symbols, np.cumsum(np.bincount(owner, minlength=len(raw)))

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the encodings of pieces not yet known into the worker's tables."""
        new = [p for p in pieces if p not in self.ids_text]
        for p in [p for p in new if p[0] == " "]:
            self.ids_text[p], self.decoded[p] = str(self.special[p[1:]]), p[1:]
        new = [p for p in new if p[0] != " "]
        if not new:
            return
        symbols, ends = self.encode_pieces(new)
        names = list(map(str, symbols.tolist()))
        tokens = list(map(self.token_of.__getitem__, symbols.tolist()))
        start = 0
        for p, end in zip(new, ends.tolist(), strict=True):
            self.ids_text[p], self.decoded[p] = " ".join(names[start:end]), " ".join(tokens[start:end])
            start = end

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its ids, written with single spaces, and its decoded text."""
        split = [self.pieces(t or "") for t in texts]
        if len(self.ids_text) > CACHE_PIECES:
            self.ids_text.clear()
            self.decoded.clear()
        self.learn(set().union(*split))
        for pieces in split:
            yield " ".join(map(self.ids_text.__getitem__, pieces)), " ".join(map(self.decoded.__getitem__, pieces))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (with the end of the last)."""
        split = [self.pieces(t or "") for t in texts]
        if len(self.number) > CACHE_PIECES:
            self.number.clear()
            self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)
        new = [p for p in set().union(*split) if p not in self.number]
        if new:
            plain = [p for p in new if p[0] != " "]
            symbols, ends = self.encode_pieces(plain) if plain else (np.empty(0, np.int64), np.zeros(0, np.int64))
            special = [p for p in new if p[0] == " "]
            ids = np.concatenate([symbols, np.array([self.special[p[1:]] for p in special], np.int64)]).astype(np.int32)
            ends = np.concatenate([ends, len(symbols) + 1 + np.arange(len(special))])
            self.number.update(zip(plain + special, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])
        sizes = np.array([len(p) for p in split], np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        lengths = self.begin[at + 1] - self.begin[at]
        upto = np.r_[0, np.cumsum(lengths)]
        places = np.arange(upto[-1]) + np.repeat(self.begin[at] - upto[:-1], lengths)
        return self.flat[places], upto[np.r_[0, np.cumsum(sizes)]]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is not told apart)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


#: What ``encode`` can return besides the id, with Spark types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), file: str | None = None) -> DataFrame:
    """One row per document: its id and the chosen OUTPUTS, made in one pass over the text."""
    path = file or common.tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        make = {
            "n_tokens": lambda ids, _: ids.count(" ") + 1 if ids else 0,
            "ids": lambda ids, _: np.array(ids.split(), dtype=np.int32),
            "decoded": lambda _, text: text,
            "ids_sha256": lambda ids, _: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": lambda _, text: hashlib.sha256(text.encode()).hexdigest(),
        }
        for batch in common.slices(batches):
            if set(outputs) <= {"ids", "n_tokens"}:
                flat, at = bpe.encode_flat(batch.column(1).to_pylist())
                columns = {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)), "n_tokens": pa.array(np.diff(at))}
                yield pa.RecordBatch.from_arrays([batch.column(0), *(columns[n] for n in outputs)], names=["doc_id", *outputs])
                continue
            found: list[list] = [[] for _ in outputs]
            for ids, decoded in bpe.encode_texts(batch.column(1).to_pylist()):
                for column, name in zip(found, outputs, strict=True):
                    column.append(make[name](ids, decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[OUTPUTS[n]]) for c, n in zip(found, outputs, strict=True))], names=["doc_id", *outputs])

    return rows.mapInArrow(work, ", ".join(["doc_id long", *(f"{n} {OUTPUTS[n]}" for n in outputs)]))


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", file: str | None = None) -> DataFrame:
    """(doc_id, decoded) from arrays of ids; a null array gives an empty text."""
    path = file or common.tokenizer_path("word_bpe_49k.json")
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.mapInArrow(work, "doc_id long, decoded string")
