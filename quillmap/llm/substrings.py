"""Substring dedup by recompression.

Spark rounds name what texts are made of. First every word gets a number that is
the same in all texts: tasks send their distinct words to buckets, which compare
the words themselves and number those that more than one document has; a word of
one document only is a barrier, since no window over it can repeat elsewhere.
The numbers are then compressed bottom-up: runs of one word become one symbol,
then, round by round, pairs. Which pairs join depends on the two symbols alone
(one half of the alphabet may only begin a pair, the other only end one), so
equal passages get equal interior symbols wherever they stand.

Every window of ``width`` words picks one symbol out of those that its own words
alone determine: the one that covers most words, of these the one of lowest
name. Equal windows pick the same name. The rounds after the first:

1. groups send the names that their windows pick; buckets answer which of them
   more than one document picks;
2. symbols of some windows' widths and more are built on, level by level up to the
   length of the passage, from what shares its picks. Buckets compare what a
   symbol is made of (two symbols; numbers of words where it is short) and
   answer whether a document of smaller id has it. All words of such a symbol go
   at once;
3. windows that no long symbol settles send the numbers of their words, those
   around one pick as one stretch. Buckets compare them number by number and
   answer whether a document of smaller id has the window;
4. words of windows that a document of smaller id has are removed.

Names are 64-bit hashes, which only bring together what may be equal. Whatever
leads to a removal has been compared by the numbers of its words, and these by
the words: names that collide cost time, not text.

Groups and buckets follow a hash and hold a bounded number of bytes whatever the
input. A group sends each word, name, symbol or window once however often it
repeats in it, as one row a bucket, so rows are never more than names.

Cases: a null text has no words; a null id counts as larger than every id;
rows of one id are documents that are not smaller than one another; texts
shorter than a window keep all words; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
NONE = U(0xFFFFFFFFFFFFFFFF)
#: Id of a row without one.
NO_ID = np.iinfo(np.int64).max
#: Text bytes of a group of documents.
GROUP_BYTES = 6 << 20
#: Text bytes that are cut into words at once.
CHUNK_BYTES = 1 << 20
#: Groups whose words, names and long symbols one bucket takes.
WORDS_SHARE, NAMES_SHARE, LONG_SHARE = 8, 2, 2
#: Pair rounds that make picks, and from which on symbols may be picked.
ROUNDS, FIRST_PICKED = 3, 2
#: Windows' widths from which on a symbol is long.
LONG = 3
#: Pair rounds in all at most; each leaves about two thirds of the symbols, so passages of any length end before.
LEVELS = 64
#: Windows in a stretch.
STRETCH = 50_000
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that each depends on all; no two values become one."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns sorted together."""
    if not len(sorted_columns[0]):
        return np.empty(0, int)
    new = np.zeros(len(sorted_columns[0]) - 1, bool)
    for c in sorted_columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new])


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary values one behind the other, and each value's number of them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins = offsets[:-1] - offsets[0]
    begins = begins[begins < len(data)]
    word = (data != 32) & ((data < 9) | (data > 13))
    starting, ending = word.copy(), word.copy()
    starting[1:] &= ~word[:-1]
    ending[:-1] &= ~word[1:]
    # a value's begin ends the word before it
    starting[begins] = word[begins]
    last = begins[begins > 0] - 1
    ending[last] = word[last]
    first, stop = np.flatnonzero(starting), np.flatnonzero(ending)
    ends = np.cumsum(stop - first + 1)
    places = np.searchsorted(first, offsets - offsets[0])
    body = pa.py_buffer(data[word].tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), body]), np.diff(places)


class Words:
    """The words of texts, one text behind the other: the distinct ones, which of them stands where, and a hash of each."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        chunks, counts, at = [pa.array([], pa.large_binary())], [np.zeros(0, np.int64)], 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            found, n = tokens(column.slice(at, end - at))
            chunks.append(found)
            counts.append(n)
            at = end
        # one empty chunk stands for texts without words
        coded = pa.concat_arrays(chunks).dictionary_encode()
        self.distinct = coded.dictionary
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        self.counts = np.concatenate(counts)
        self.starts = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(column), dtype=np.int32), self.counts)

    @cached_property
    def names(self) -> np.ndarray:
        """A hash of each distinct word."""
        n = len(self.distinct)
        if not n:
            return np.empty(0, U)
        offsets = np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset : self.distinct.offset + n + 1]
        data = np.frombuffer(self.distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        powers = np.cumprod(np.full(int(sizes.max()), ODD[0], U))
        h = np.add.reduceat((data.astype(U) + U(1)) * powers[place], offsets[:-1] - offsets[0])
        return mixed(h + sizes.astype(U))

    @cached_property
    def hash(self) -> np.ndarray:
        return self.names[self.index]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in three or four bytes where they fit, with a leading byte that tells."""
    top = int(x.max(initial=0)) if not len(x) or x.min() >= 0 else 1 << 62
    if top < 1 << 24:
        return b"3" + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return (b"4" + x.astype("<u4").tobytes()) if top < 1 << 32 else b"8" + x.astype("<i8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"3":
        out = np.zeros((len(raw) // 3, 4), np.uint8)
        out[:, :3] = np.frombuffer(raw[1:], np.uint8).reshape(-1, 3)
        return out.view("<u4").ravel().astype(np.int64)
    return np.frombuffer(raw[1:], "<u4" if raw[:1] == b"4" else "<i8").astype(np.int64)


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def in_order(group: pa.Table) -> pa.Table:
    """The rows in an order that does not hang on how they came."""
    return group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"))


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)


def by_bucket(bucket: np.ndarray):
    """(bucket, places of its entries) in an order that entries of a bucket keep."""
    order = np.argsort(bucket, kind="stable")
    cuts = firsts(bucket[order])
    for start, end in zip(cuts, [*cuts[1:], len(order)][: len(cuts)], strict=True):
        yield int(bucket[order[start]]), order[start:end]


#: The round of notes.
NOTE = -1
#: What a group sends to a bucket, and what comes back: one row a bucket and group.
SENT = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
REPLY = pa.schema([("g", pa.int64()), ("round", pa.int32()), ("bucket", pa.int64()), ("found", pa.binary())])
STATE = pa.schema([("g", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])
GONE = pa.schema([("g", pa.int64()), ("gone", pa.binary())])
SPARK = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK[f.type]}" for f in schema)


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def replies_of(replies: pa.Table, turn: int) -> dict[int, bytes]:
    """A round's answers to a group, by bucket."""
    return {b: f for r, b, f in zip(replies["round"].to_pylist(), replies["bucket"].to_pylist(), replies["found"].to_pylist(), strict=True) if r == turn}


# -- words ---------------------------------------------------------------------


def send_words(group: pa.Table, buckets: int) -> pa.Table:
    """Each distinct word of a group, with whether two of its documents have it."""
    words = Words(in_order(group)["text"])
    if not len(words.index):
        return SENT.empty_table()
    first, last = np.empty((2, len(words.distinct)), np.int32)
    last[words.index] = words.doc
    first[words.index[::-1]] = words.doc[::-1]
    g, out, two = group["g"][0].as_py(), [], first != last
    for b, at in by_bucket(bucket_of(words.names, buckets)):
        out.append((b, g, b" ".join(words.distinct.take(pa.array(at)).to_pylist()), bits(two[at]), None, None))
    return rows_of(SENT, out)


def number_words(sent: pa.Table, buckets: int) -> pa.Table:
    """For each group the numbers of the words that it sent, 0 for those of one document; numbers follow the spelling."""
    words = Words(sent["a"])
    n = len(words.distinct)
    shared = np.bincount(words.index, minlength=n) > 1
    twice = np.concatenate([flags(x, c) for x, c in zip(sent["b"].to_pylist(), words.counts.tolist(), strict=True)])
    shared[words.index[twice]] = True
    order = pc.sort_indices(words.distinct).to_numpy()
    number, bucket = np.zeros(n, np.int64), sent["bucket"][0].as_py()
    held = order[shared[order]]
    number[held] = np.arange(len(held)) * buckets + bucket + 1
    flat = number[words.index]
    ends = np.cumsum(words.counts)
    return rows_of(REPLY, [(g, 0, bucket, packed(flat[e - c : e])) for g, c, e in zip(sent["g"].to_pylist(), words.counts.tolist(), ends.tolist(), strict=True)])


def numbered(group: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """A group's documents as numbers of words."""
    if not group.num_rows:
        return STATE.empty_table()
    group = in_order(group)
    words, found = Words(group["text"]), replies_of(replies, 0)
    number = np.zeros(len(words.distinct), np.int64)
    if len(number):
        # documents are in one order, and so are their distinct words
        for b, at in by_bucket(bucket_of(words.names, buckets)):
            number[at] = unpacked(found[b])
    return rows_of(STATE, [(group["g"][0].as_py(), ids_of(group["doc_id"]).tobytes(), packed(words.counts), packed(number[words.index]))])


# -- symbols -------------------------------------------------------------------


@dataclass
class Symbols:
    """Symbols in text order: names, the words [start, end) that they stand for, and which stretch of shared words they are in."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    part: np.ndarray

    def __len__(self) -> int:
        return len(self.name)


class Group:
    """A group's numbers of words, and what follows from them alone."""

    def __init__(self, state: pa.Table, width: int):
        self.g, self.width = state["g"][0].as_py(), width
        self.ids = np.frombuffer(state["ids"][0].as_py(), np.int64)
        self.counts, self.codes = unpacked(state["counts"][0].as_py()), unpacked(state["codes"][0].as_py()).astype(U)
        n = len(self.codes)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.counts)
        barrier = self.codes == 0
        new = np.r_[True, (self.doc[1:] != self.doc[:-1]) | barrier[1:] | barrier[:-1]][:n]
        self.part = np.cumsum(new).astype(np.int32)
        ends = np.r_[np.flatnonzero(new)[1:], n]
        left = (ends[self.part - 1] if n else ends) - np.arange(n)
        self.windows = np.flatnonzero((left >= width) & ~barrier)
        self.names = mixed(self.codes)

    def covered(self, places: np.ndarray) -> np.ndarray:
        """Which words lie in the windows at these places."""
        marks = np.zeros(len(self.codes) + 1, np.int32)
        marks[places] += 1
        marks[np.minimum(places + self.width, len(self.codes))] -= 1
        return np.cumsum(marks[:-1]) > 0

    def cut_runs(self, places: np.ndarray) -> Symbols:
        """The runs that touch windows at these places; what no window covers parts them."""
        s, upto = self.runs, np.r_[0, np.cumsum(self.covered(places))]
        keep = upto[s.end] > upto[s.start]
        start, end, part = s.start[keep], s.end[keep], s.part[keep]
        return Symbols(s.name[keep], start, end, np.cumsum(apart(start, end, part)).astype(np.int32))

    def own(self, places: np.ndarray) -> np.ndarray:
        return self.ids[self.doc[places]]

    @cached_property
    def runs(self) -> Symbols:
        n = len(self.codes)
        begins = np.flatnonzero(np.r_[True, (self.codes[1:] != self.codes[:-1]) | (self.part[1:] != self.part[:-1])][:n])
        ends = np.r_[begins[1:], n][: len(begins)]
        size, name = ends - begins, self.names[begins]
        name = np.where(size > 1, mixed(name + size.astype(U) * ODD[1]), name)
        return Symbols(name, begins.astype(np.int32), ends.astype(np.int32), self.part[begins])

    def picks(self, places: np.ndarray | None = None) -> np.ndarray:
        """For each place the name that the window from there picks, NONE if no symbol is its own; of all windows or those named.

        A pick follows from the words of its window, so that looking at some windows only does not change theirs.
        """
        width = self.width
        best = np.full(len(self.codes), NONE, U)
        if not len(self.windows if places is None else places):
            return best
        s = self.runs if places is None else self.cut_runs(places)
        name, start, end, part = s.name, s.start, s.end, s.part
        # words that say that the symbol is here: those around a run must differ from it
        low, high = start - 1, end + 1
        for level in range(1, ROUNDS + 1):
            begins_pair, joined = joins(name, part, level)
            left = np.r_[joined, False]
            right = np.r_[False, joined]
            alone = ~(left | right)
            # what stands alone does so for its neighbour's sake; a stretch's end stands for a neighbour
            after_low, after_high = np.r_[low[1:], low[-1:]], np.r_[high[1:], high[-1:]]
            before_low, before_high = np.r_[low[:1], low[:-1]], np.r_[high[:1], high[:-1]]
            to_next = left | (alone & begins_pair)
            to_last = alone & ~begins_pair
            edge_next = np.r_[part[1:] != part[:-1], True] & to_next
            edge_last = np.r_[True, part[1:] != part[:-1]] & to_last
            new_low = np.where(to_next, np.minimum(low, after_low), np.where(to_last, np.minimum(low, before_low), low))
            new_high = np.where(to_next, np.maximum(high, after_high), np.where(to_last, np.maximum(high, before_high), high))
            new_low = np.where(edge_last, start - 1, np.where(edge_next, low, new_low))
            new_high = np.where(edge_next, end + 1, np.where(edge_last, high, new_high))
            keep = ~right
            pair = pair_names(name, np.r_[name[1:], name[-1:]], level)
            new_end = np.where(left, np.r_[end[1:], end[-1:]], end)
            name, start, end = np.where(left, pair, name)[keep], start[keep], new_end[keep]
            low, high, part = new_low[keep], new_high[keep], part[keep]
            if level < FIRST_PICKED:
                continue
            fits = np.flatnonzero(high - low <= width)
            key = (U(15) - np.minimum(end[fits] - start[fits], 15).astype(U)) << U(60) | name[fits] >> U(4)
            at, least, most = start[fits], (start - low)[fits], width - (high - start)[fits]
            for back in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
                here = (least <= back) & (back <= most)
                places = at[here] - back
                best[places] = np.minimum(best[places], key[here])
        return best

    def hashes(self, places: np.ndarray) -> np.ndarray:
        return window_hashes(self.names, places, self.width)


def joins(name: np.ndarray, part: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols may only begin a pair in this round, and which join the one behind them."""
    begins_pair = mixed(name + np.array([level], U) * ODD[2]) < U(1 << 63)
    return begins_pair, begins_pair[:-1] & ~begins_pair[1:] & (part[1:] == part[:-1])


def apart(start: np.ndarray, end: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which symbols do not follow on the one before them."""
    return np.r_[True, (part[1:] != part[:-1]) | (start[1:] != end[:-1])][: len(part)]


def pair_names(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    return mixed(left * ODD[0] + (right ^ U(level)) * ODD[1])


def window_hashes(names: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(places), U)
    for k in range(width):
        h = (h ^ names[places + k]) * ODD[0]
        h ^= h >> U(31)
    return mixed(h)


def same_words(codes: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for k in range(width):
        out &= codes[a + k] == codes[b + k]
    return out


# -- round 1: picks ------------------------------------------------------------


def picked_names(group: Group, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names that windows pick, and whether windows of two documents do."""
    at = group.windows[best[group.windows] != NONE]
    order = at[np.argsort(best[at], kind="stable")]
    names, docs = best[order], group.doc[order]
    begin = firsts(names)
    if not len(begin):
        return np.empty(0, U), np.empty(0, bool)
    # places of a name are in order of text, so its first and last text tell
    return names[begin], docs[begin] != docs[np.r_[begin[1:], len(docs)] - 1]


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(names) % U(buckets)).astype(np.int64)


def send_names(state: pa.Table, width: int, buckets: int) -> pa.Table:
    group = Group(state, width)
    names, twice = picked_names(group, group.picks())
    return rows_of(SENT, [(b, group.g, names[at].tobytes(), bits(twice[at]), None, None) for b, at in by_bucket(bucket_of(names, buckets))])


def shared_names(sent: pa.Table) -> pa.Table:
    """For each group which of its names stand in two groups or twice in one."""
    parts = [np.frombuffer(x, U) for x in sent["a"].to_pylist()]
    twice = np.concatenate([flags(x, len(p)) for x, p in zip(sent["b"].to_pylist(), parts, strict=True)])
    flat = np.concatenate(parts)
    order = np.argsort(flat, kind="stable")
    begin = firsts(flat[order])
    sizes = np.diff(np.r_[begin, len(flat)])
    shared = np.zeros(len(flat), bool)
    shared[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(twice[order], begin), sizes)
    return answers(sent, 1, shared, [len(p) for p in parts])


def answers(sent: pa.Table, turn: int, found: np.ndarray, sizes: list[int]) -> pa.Table:
    """Bits for each group that sent something, in the order in which it did."""
    ends = np.cumsum(sizes).tolist()
    return rows_of(REPLY, [(g, turn, b, bits(found[e - n : e])) for g, b, n, e in zip(sent["g"].to_pylist(), sent["bucket"].to_pylist(), sizes, ends, strict=True) if found[e - n : e].any()])


def heard(replies: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    """A round's bits, put back where what was sent stands."""
    out = np.zeros(len(bucket), bool)
    for b, at in by_bucket(bucket):
        if b in replies:
            out[at] = flags(replies[b], len(at))
    return out


def open_windows(group: Group, replies: pa.Table, buckets: int) -> np.ndarray:
    """The windows whose pick another document picks too, or that pick none."""
    best = group.picks()
    names, _ = picked_names(group, best)
    shared = names[heard(replies_of(replies, 1), bucket_of(names, buckets))]
    pick = best[group.windows]
    hit = pick == NONE
    if len(shared):
        where = np.minimum(np.searchsorted(shared, pick), len(shared) - 1)
        hit |= shared[where] == pick
    return group.windows[hit]


def noted(group: Group, *places: np.ndarray) -> tuple:
    """What a group tells itself for its next turn: some sets of places."""
    marks = np.zeros((len(places), len(group.codes)), bool)
    for row, at in zip(marks, places, strict=True):
        row[at] = True
    return (-1 - group.g, group.g, b"".join(map(bits, marks)), None, None, None)


def recalled(group: Group, replies: pa.Table, sets: int) -> list[np.ndarray]:
    raw = replies_of(replies, NOTE).get(-1 - group.g)
    if raw is None:
        return [np.empty(0, np.int64)] * sets
    size = len(raw) // sets
    return [np.flatnonzero(flags(raw[k * size : (k + 1) * size], len(group.codes))) for k in range(sets)]


def passed_on(sent: pa.Table) -> pa.Table:
    """Notes go back to where they came from."""
    return rows_of(REPLY, [(g, NOTE, b, a) for g, b, a in zip(sent["g"].to_pylist(), sent["bucket"].to_pylist(), sent["a"].to_pylist(), strict=True)])


# -- round 2: long symbols -----------------------------------------------------


@dataclass
class Long:
    """Symbols of LONG widths and more of a group, and the shorter ones that they are made of.

    A long one is known by two names (of a run: the word's and how often), a
    short one by its words.
    """

    name: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    end: np.ndarray
    long: np.ndarray


def long_symbols(group: Group, places: np.ndarray) -> Long:
    """All symbols of LONG widths or more, and their shorter halves, within what the windows at ``places`` cover."""
    n, width, least = len(group.codes), group.width, LONG * group.width
    marks = np.zeros(n + 1, np.int32)
    marks[places] = 1
    # a symbol of w words holds w - width + 1 windows; all must be among the places
    upto = np.r_[0, np.cumsum(marks)]
    s = group.cut_runs(places)
    name, start, end, part = s.name, s.start, s.end, s.part

    def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = b - a
        whole = size >= least
        return whole & (upto[np.where(whole, b - width + 1, 0)] - upto[np.where(whole, a, 0)] == size - width + 1)

    found: list[tuple[np.ndarray, ...]] = []
    runs = np.flatnonzero(inside(start, end))
    found.append((name[runs], group.names[start[runs]], (end - start)[runs].astype(U), start[runs], end[runs], np.ones(len(runs), bool)))
    for level in range(1, LEVELS + 1):
        if len(name) < 2:
            break
        joined = joins(name, part, level)[1]
        if level > ROUNDS and not joined.any():
            # symbols without a neighbour in their stretch are done
            if not (part[1:] == part[:-1]).any():
                break
            continue
        at = np.flatnonzero(joined)
        pair = pair_names(name[at], name[at + 1], level)
        good = inside(start[at], end[at + 1])
        a = at[good]
        found.append((pair[good], name[a], name[a + 1], start[a], end[a + 1], np.ones(len(a), bool)))
        for side in (a, a + 1):
            short = side[(end - start)[side] < width]
            found.append((name[short], name[short], name[short], start[short], end[short], np.zeros(len(short), bool)))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name[at], end[at] = pair, end[at + 1]
        name, start, end, part = name[keep], start[keep], end[keep], part[keep]
        if level >= ROUNDS:
            # nothing long will hold what is not covered
            live = (end - start < least) | inside(start, end)
            name, start, end, part = name[live], start[live], end[live], part[live]
            part = np.cumsum(apart(start, end, part)).astype(np.int32)
    return Long(*(np.concatenate(c) for c in zip(*found, strict=True)))


def distinct_symbols(group: Group, symbols: Long) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One symbol for each (name, made of) of the group, its smallest id, and for each symbol which of these it is.

    Short symbols of one name whose words differ stay apart.
    """
    own = group.own(symbols.start)
    size = (symbols.end - symbols.start).astype(np.int64)
    order = np.lexsort((own, size, symbols.right, symbols.left, symbols.name, symbols.long))
    keys = [c[order] for c in (symbols.long, symbols.name, symbols.left, symbols.right, size)]
    begin = firsts(*keys)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    head = order[begin]
    short = np.flatnonzero(~symbols.long)
    if len(short):
        # compare the words of a short one with those of its first
        a, b, most = symbols.start[short], symbols.start[head[number[short]]], int(size[short].max())
        differ = np.zeros(len(short), bool)
        for k in range(most):
            here = size[short] > k
            differ[here] |= group.codes[a[here] + k] != group.codes[b[here] + k]
        alone = short[differ]
        number[alone] = len(head) + np.arange(len(alone))
        head = np.concatenate([head, alone])
    return head, own[head], number


def send_long(state: pa.Table, replies: pa.Table, width: int, buckets: tuple[int, int]) -> pa.Table:
    if not state.num_rows:
        return SENT.empty_table()
    group = Group(state, width)
    places = open_windows(group, replies, buckets[0])
    if not len(places):
        return SENT.empty_table()
    symbols = long_symbols(group, places)
    head, ids, _ = distinct_symbols(group, symbols)
    out = [noted(group, places)]
    for b, at in by_bucket(bucket_of(symbols.name[head], buckets[1])):
        h = head[at]
        short = h[~symbols.long[h]]
        sizes = symbols.end[short] - symbols.start[short]
        places = np.repeat(symbols.start[short] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        # a long symbol's name follows from what it is made of, a short one's words are sent for it
        made = np.concatenate([symbols.name[h], symbols.left[h][symbols.long[h]], symbols.right[h][symbols.long[h]]])
        kind = np.where(symbols.long[h], 0, symbols.end[h] - symbols.start[h]).astype(np.uint16)
        out.append((b, group.g, made.tobytes(), kind.tobytes(), packed(group.codes[places]), packed(ids[at])))
    return rows_of(SENT, out)


def settled_symbols(sent: pa.Table) -> pa.Table:
    """For each group two bits a symbol: whether its name means one thing only, and whether a smaller id than the group's has it."""
    if sent["bucket"][0].as_py() < 0:
        return passed_on(sent)
    names, made, ids, sizes = [], [], [], []
    for a, b, c, d in zip(*(sent[x].to_pylist() for x in "abcd"), strict=True):
        kind, flat, codes = np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(a, U), unpacked(c)
        n, n_long = len(kind), int((kind == 0).sum())
        content = np.zeros((n, 3), U)
        content[kind == 0, 1], content[kind == 0, 2] = flat[n : n + n_long], flat[n + n_long :]
        names.append(flat[:n])
        made.append((kind, content, codes))
        ids.append(unpacked(d))
        sizes.append(n)
    flat_names, flat_ids = np.concatenate(names), np.concatenate(ids)
    kind = np.concatenate([m[0] for m in made])
    content = np.concatenate([m[1] for m in made])
    codes = np.concatenate([m[2] for m in made])
    begins = np.cumsum(kind) - kind
    order = np.lexsort((flat_ids, flat_names))
    begin = firsts(flat_names[order])
    runs = np.diff(np.r_[begin, len(order)])
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[begin], runs)
    alike = (kind == kind[head]) & (content == content[head]).all(1)
    for k in range(int(kind.max(initial=0))):
        here = np.flatnonzero(kind > k)
        both = here[kind[head[here]] > k]
        alike[both] &= codes[begins[both] + k] == codes[begins[head[both]] + k]
    one = np.empty(len(order), bool)
    one[order] = np.repeat(np.logical_and.reduceat(alike[order], begin), runs)
    less = flat_ids[head] < flat_ids
    both = np.stack([one, less], 1).ravel()
    return answers(sent, 2, both, [2 * n for n in sizes])


def settled(group: Group, symbols: Long, replies: pa.Table, buckets: int) -> np.ndarray:
    """Which windows lie in a long symbol that a smaller id has, whose every part means one thing."""
    head, ids, number = distinct_symbols(group, symbols)
    bucket = bucket_of(symbols.name[head], buckets)
    found = heard(replies_of(replies, 2), np.repeat(bucket, 2)).reshape(-1, 2) if len(head) else np.empty((0, 2), bool)
    sound, less = found[number, 0], found[number, 1] | (ids[number] < group.own(symbols.start))
    n = len(group.codes)
    # a part that is not sound spoils the symbols that hold it
    spoilt = np.cumsum(np.r_[0, np.bincount(symbols.start[~sound], minlength=n)])
    clean = spoilt[symbols.end] == spoilt[symbols.start]
    use = np.flatnonzero(symbols.long & clean & less)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, symbols.start[use], 1)
    np.add.at(marks, symbols.end[use] - group.width + 1, -1)
    return np.cumsum(marks[:-1]) > 0


# -- round 3: windows ----------------------------------------------------------


@dataclass
class Stretches:
    """What a group asks: windows once each (``heads``, in stretches, by bucket) and which of them each open window is."""

    open: np.ndarray
    head_of: np.ndarray
    heads: np.ndarray
    own: np.ndarray
    bucket: np.ndarray
    cuts: np.ndarray


def stretches(group: Group, places: np.ndarray, buckets: int) -> Stretches:
    best = group.picks(places)
    h, own = group.hashes(places), group.own(places)
    order = np.lexsort((places, own, h))
    begin = firsts(h[order])
    first = np.empty(len(places), np.int64)
    first[order] = np.repeat(order[begin], np.diff(np.r_[begin, len(order)]))
    # windows of one hash whose words differ stand for themselves
    first = np.where(same_words(group.codes, places, places[first], group.width), first, np.arange(len(places)))
    at = np.unique(first)
    bucket = bucket_of(np.where(best[places[at]] != NONE, best[places[at]], h[at]), buckets)
    order = np.lexsort((places[at], bucket))
    at, bucket = at[order], bucket[order]
    heads, ids = places[at], own[at]
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | (heads[1:] != heads[:-1] + 1) | (ids[1:] != ids[:-1])][: len(at)]
    # no stretch is longer than STRETCH
    run = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    number = np.empty(len(places), np.int64)
    number[at] = np.arange(len(at))
    return Stretches(places, number[first], heads, ids, bucket, np.flatnonzero(since % STRETCH == 0))


def send_windows(state: pa.Table, replies: pa.Table, width: int, buckets: tuple[int, int]) -> pa.Table:
    if not state.num_rows:
        return SENT.empty_table()
    group = Group(state, width)
    (places,) = recalled(group, replies, 1)
    if not len(places):
        return SENT.empty_table()
    done = settled(group, long_symbols(group, places), replies, buckets[0])
    places = places[~done[places]]
    s = stretches(group, places, buckets[1])
    sizes = np.diff(np.r_[s.cuts, len(s.heads)])
    out = [noted(group, places, np.flatnonzero(done))]
    for b, at in by_bucket(s.bucket[s.cuts]):
        n = sizes[at]
        span = n + width - 1
        places = np.repeat(s.heads[s.cuts[at]] - np.cumsum(span) + span, span) + np.arange(span.sum())
        out.append((b, group.g, n.astype(np.uint16).tobytes(), packed(s.own[s.cuts[at]]), packed(group.codes[places]), None))
    return rows_of(SENT, out)


def smaller_ids(sent: pa.Table, width: int) -> pa.Table:
    """For each group which of its windows a smaller id than its own has; windows are compared word by word."""
    if sent["bucket"][0].as_py() < 0:
        return passed_on(sent)
    sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in sent["a"].to_pylist()]
    n = np.concatenate(sizes)
    ids = np.repeat(np.concatenate([unpacked(x) for x in sent["b"].to_pylist()]), n)
    codes = np.concatenate([unpacked(x) for x in sent["c"].to_pylist()]).astype(U)
    span = n + width - 1
    places = np.repeat(np.cumsum(span) - span - np.cumsum(n) + n, n) + np.arange(n.sum())
    h = window_hashes(mixed(codes), places, width)
    order = np.lexsort((ids, h))
    begin = firsts(h[order])
    head = np.repeat(order[begin], np.diff(np.r_[begin, len(order)]))
    if not same_words(codes, places[order], places[head], width).all():
        # two windows of one hash: sort by the words themselves
        columns = [codes[places + k] for k in range(width)]
        order = np.lexsort((ids, *columns))
        begin = firsts(*(c[order] for c in columns))
        head = np.repeat(order[begin], np.diff(np.r_[begin, len(order)]))
    less = np.empty(len(ids), bool)
    less[order] = ids[head] < ids[order]
    return answers(sent, 3, less, [int(x.sum()) for x in sizes])


def gone_words(state: pa.Table, replies: pa.Table, width: int, buckets: int) -> pa.Table:
    """The words of a group that lie in a window which a document of smaller id has."""
    if not state.num_rows:
        return GONE.empty_table()
    group = Group(state, width)
    places, done = recalled(group, replies, 2)
    s = stretches(group, places, buckets)
    less = heard(replies_of(replies, 3), s.bucket)
    gone = np.concatenate([done, s.open[less[s.head_of] | (s.own[s.head_of] < group.own(s.open))]])
    if not len(gone):
        return GONE.empty_table()
    marks = np.zeros(len(group.codes) + 1, np.int64)
    np.add.at(marks, gone, 1)
    np.add.at(marks, gone + width, -1)
    return rows_of(GONE, [(group.g, bits(np.cumsum(marks[:-1]) > 0))])


#: What ``dedup`` can return besides the id.
OUTPUTS = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string()}


def finish(group: pa.Table, found: pa.Table, outputs: tuple[str, ...]) -> pa.Table:
    """What is left of each document, words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, OUTPUTS[n]) for n in outputs)])
    if not group.num_rows:
        return schema.empty_table()
    group = in_order(group)
    texts, out, at = group["text"].combine_chunks().cast(pa.binary()), {n: [] for n in outputs}, 0
    gone = np.unpackbits(np.frombuffer(found["gone"][0].as_py(), np.uint8)).astype(bool) if found.num_rows else None
    for i in range(group.num_rows):
        parts = (texts[i].as_py() or b"").split()
        count, n = len(parts), 0
        if gone is not None and (n := int((mine := gone[at : at + count]).sum())):
            parts = compress(parts, (~mine).tolist())
        at += count
        kept = b" ".join(parts)
        for name, value in (("n_words", count), ("n_removed", n), ("kept", kept), ("kept_sha256", kept)):
            if name in out:
                out[name].append(hashlib.sha256(value).hexdigest() if name == "kept_sha256" else value.decode() if name == "kept" else value)
    return pa.Table.from_arrays([group["doc_id"].combine_chunks(), *(pa.array(out[n], OUTPUTS[n]) for n in outputs)], schema=schema)


def dedup(docs: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_words", "n_removed", "kept"), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: its id and the chosen OUTPUTS."""
    text = F.col(text_col).cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    words, names, long = (-(-groups // share) for share in (WORDS_SHARE, NAMES_SHARE, LONG_SHARE))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # rows that repeat in full are one group a partition; the number of a row would not survive a lost task
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).cast("long"))
    by_group = rows.groupBy("g")
    told = by_group.applyInArrow(lambda t: send_words(t, words), ddl(SENT)).groupBy("bucket").applyInArrow(lambda t: number_words(t, words), ddl(REPLY))
    state = by_group.cogroup(told.groupBy("g")).applyInArrow(lambda t, a: numbered(t, a, words), ddl(STATE)).groupBy("g")
    told = state.applyInArrow(lambda t: send_names(t, width, names), ddl(SENT)).groupBy("bucket").applyInArrow(shared_names, ddl(REPLY))
    told = state.cogroup(told.groupBy("g")).applyInArrow(lambda t, a: send_long(t, a, width, (names, long)), ddl(SENT)).groupBy("bucket").applyInArrow(settled_symbols, ddl(REPLY))
    told = state.cogroup(told.groupBy("g")).applyInArrow(lambda t, a: send_windows(t, a, width, (long, groups)), ddl(SENT)).groupBy("bucket").applyInArrow(lambda t: smaller_ids(t, width), ddl(REPLY))
    gone = state.cogroup(told.groupBy("g")).applyInArrow(lambda t, a: gone_words(t, a, width, groups), ddl(GONE))
    schema = ", ".join(["doc_id long", *(f"{n} {SPARK[OUTPUTS[n]]}" for n in outputs)])
    return by_group.cogroup(gone.groupBy("g")).applyInArrow(lambda t, a: finish(t, a, outputs), schema)


#: The columns of op4, at its width.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE len(words) >= 13)
), least AS (
  SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS place FROM windows JOIN least USING (k) WHERE first_id < doc_id
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts WHERE len(words) > 0
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY place) AS rest, count(*) AS n FROM placed WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = placed.r AND gone.place = placed.place) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)
"""
