"""Secret scans: patterns plus a token-efficiency test.

A vocabulary trained on ordinary text covers words with few tokens and random
strings with many. A run of key-like characters whose characters-per-token
ratio is low is therefore reported, unless it is a known digest or identifier.
A run that passes as a whole is tested again in parts, without the words and
numbers that separators join to it; what patterns leave over of a run is tested
like a run.

Cases: a null text counts as empty and has no spans; repeated rows are scanned
alike; every input row gives one output row; columns besides the id and the
text are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Spans of one start are listed in this order.
KINDS = ("assign", "access", "hex", "random")

#: Runs that the token test looks at.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Parts of a run that separators join; what has fewer characters is not tested.
PART, LEAST = re.compile(rf"{UUID.pattern}|[A-Za-z0-9]+"), 16
HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
PARTS = re.compile(r"[+/_=-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
WORDY = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]+|[a-z]{1,2}|[A-Z]{1,2})\Z")

#: Mixed runs at or under the first ratio, runs of letters only at or under the second, are random.
MIXED_RATIO, LETTER_RATIO = 1.95, 1.6


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str):
    """The encoder for a rank file, one per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Numbers, UUIDs, digests and names put together from words."""
    if run.isdigit() or UUID.fullmatch(run) or (HEX_ANY.fullmatch(run) and len(run) in DIGEST_LENGTHS):
        return True
    if not any(c.isalpha() for c in run):
        return True
    parts = [p for p in PARTS.split(run) if p]
    long_words = sum(len(p) for p in parts if len(p) >= 3 and p.isalpha())
    digits = sum(p.isdigit() for p in parts)
    return len(parts) > 1 and digits <= 2 and all(WORDY.match(p) for p in parts) and long_words >= 0.7 * sum(map(len, parts))


def is_random(run: str, encoder) -> bool:
    mixed = any(c.isdigit() for c in run)
    # a letters-only run in one case is a word unless the vocabulary falls apart on it
    ratio = len(run) / max(1, len(encoder.encode_ordinary(run)))
    return ratio <= (MIXED_RATIO if mixed else LETTER_RATIO) and not is_identifier(run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def is_plain(part: str, encoder) -> bool:
    """Numbers, UUIDs and digests, and words that the vocabulary covers."""
    if part.isdigit() or UUID.fullmatch(part) or (HEX_ANY.fullmatch(part) and len(part) in DIGEST_LENGTHS):
        return True
    words = all(len(p) >= 3 and p.isalpha() and WORDY.match(p) for p in PARTS.split(part) if p)
    return words and len(part) / len(encoder.encode_ordinary(part)) > LETTER_RATIO


def random_parts(run: str, encoder) -> list[tuple[int, int]]:
    """(start, end) of neighbouring parts that are no plain words and fail the token test together, or else of such parts alone."""
    groups: list[list[tuple[int, int]]] = [[]]
    for a, b in (m.span() for m in PART.finditer(run)):
        # parts of one or two characters belong to a group only between others
        if b - a <= 2:
            groups[-1] += [(a, b)] if groups[-1] else []
        elif is_plain(run[a:b], encoder):
            groups.append([])
        else:
            groups[-1].append((a, b))
    found = []
    for group in groups:
        while group and group[-1][1] - group[-1][0] <= 2:
            group.pop()
        tries = [[(group[0][0], group[-1][1])], group] if group else []
        for spans in tries:
            if bad := [(a, b) for a, b in spans if b - a >= LEAST and is_random(run[a:b], encoder)]:
                found += bad
                break
    return found


def random_spans(text: str, base: list[tuple[int, int, int]], encoder) -> list[tuple[int, int, int]]:
    """What fails the token test of runs, as far as no pattern match covers them; ``base`` lies in order of starts.

    Runs and what the matches cover, put together to stretches apart from one
    another, are gone through side by side.
    """
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    found, first = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        k = first
        while at < end:
            s, e = covered[k] if k < len(covered) and covered[k][0] < end else (end, end)
            if s - at >= LEAST:
                rest = text[at:s]
                found += [(at + a, 3, at + b) for a, b in ([(0, len(rest))] if is_random(rest, encoder) else random_parts(rest, encoder))]
            at, k = max(at, e), k + 1
    return found


def scan_text(text: str | None, encoder) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern spans and all spans of one text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, encoder))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, put as ``[SECRET]``."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


#: What ``scan`` can return besides the id, with Spark types.
OUTPUTS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_random": "long", "base": "string", "spans": "string", "redacted": "string"}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """One row per document: its id and the chosen OUTPUTS.

    ``spans`` lists kind:start:end (code points, end exclusive) of all findings;
    ``base`` those of the patterns alone; ``redacted`` is the text without them,
    null where nothing was found.
    """
    path, pattern = rank_file or common.tokenizer_path("byte_bpe_50k.tiktoken"), _pattern()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path, pattern)
        for batch in common.slices(batches):
            columns: dict[str, list] = {name: [] for name in outputs}
            for text in batch.column(1).to_pylist():
                base, spans = scan_text(text, encoder)
                made = {f"n_{kind}": (lambda k=k: sum(x[1] == k for x in spans)) for k, kind in enumerate(KINDS)}
                made |= {"base": lambda: written(base), "spans": lambda: written(spans), "redacted": lambda: redact_text(text, spans) if spans else None}
                for name, column in columns.items():
                    column.append(made[name]())
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[OUTPUTS[n]]) for n, c in columns.items())], names=["doc_id", *outputs])

    return rows.mapInArrow(work, ", ".join(["doc_id long", *(f"{n} {OUTPUTS[n]}" for n in outputs)]))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", rank_file: str | None = None) -> DataFrame:
    """All rows and columns, with every span in the text replaced and the length, where there is such a column, counted again."""
    path, pattern = rank_file or common.tokenizer_path("byte_bpe_50k.tiktoken"), _pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path, pattern)
        for batch in common.slices(batches, text_col):
            at = batch.schema.names.index(text_col)
            texts = [t if t is None or not (spans := scan_text(t, encoder)[1]) else redact_text(t, spans) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(work, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def digest(found: DataFrame) -> DataFrame:
    """The columns that op7 returns."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_random")
