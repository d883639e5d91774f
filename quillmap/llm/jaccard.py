"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its shingles of ``width`` words. Documents of one set
are one node. A node's signature holds ``TREES`` labels of ``DEPTH`` MinHash
bytes; sorted, the labels of one tree are a prefix trie. Its subtrees are dealt
to tasks, and each is walked from whole labels up: nodes that share ``length``
bytes, and no more, are compared by their whole signatures, then the prefix is
shortened by a byte. A subtree ends where pairs as far apart as the farthest
similar one found in it meet in some tree with the target recall; one in which
none was found counts as if it had one at the threshold. So subtrees of near
copies end at long prefixes, and none is cut shorter than a pair at the
threshold needs.

Pairs far under the threshold are left there, the others tie nodes to clusters,
and within a cluster every pair is verified on the shingles themselves.

Nothing is emitted per pair: blocks of bounded size count the links of their
nodes and keep a forest of them, and large prefixes and clusters are split into
pairs of blocks. Copies are folded before anything is compared.

Cases: a text of fewer than ``width`` words is one shingle; null, empty and blank
texts are copies of one another; null ids never name a class unless no member
has an id; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.llm import common
from quillmap.llm.components import components
from quillmap.llm.substrings import ODD, U, Words, mixed

TREES, DEPTH = 32, 8
#: Share of the pairs at the threshold that must meet.
RECALL = 0.9999
#: So many standard errors under the threshold may a signature's estimate be.
ERRORS = 5.5
#: Nodes in a block of a prefix; documents and shingles in a block of a cluster.
PREFIX_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 512, 384, 400_000
#: Places of the bitmap (2 MB) by which rows are chosen before their texts move.
FILTER_BITS = 1 << 24
_RNG = np.random.default_rng(20240607)
FACTORS = _RNG.integers(0, 1 << 31, TREES * DEPTH).astype(np.uint32) * np.uint32(2) + np.uint32(1)
MASKS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def prefix_length(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix by which pairs at the threshold are met with the target recall."""
    for length in range(DEPTH, 0, -1):
        if 1 - (1 - threshold**length) ** TREES >= recall:
            return length
    raise ValueError("too few trees for this threshold")


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in one array, and each text's number of them."""
    n = len(words.hash)
    left = np.repeat(words.starts + words.counts, words.counts) - np.arange(n)
    whole = np.zeros(n, bool)
    whole[words.starts[words.counts > 0]] = True
    at = np.flatnonzero((left >= width) | (whole & (left < width)))
    h = np.zeros(len(at), U)
    for k in range(width):
        inside = left[at] > k
        w = np.where(inside, words.hash[np.minimum(at + k, n - 1)], U(0)) if n else h
        h = (h ^ w) * ODD[0]
        h ^= h >> U(29)
    h = mixed(h)
    sizes = np.bincount(words.doc[at], minlength=len(words.counts))
    ends = np.cumsum(sizes)
    parts = [np.unique(h[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return np.concatenate([np.empty(0, U), *parts]), np.array([len(p) for p in parts], np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, TREES * DEPTH) bytes; sets without shingles have zeros."""
    out = np.zeros((len(sizes), len(FACTORS)), np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x = (flat >> U(32)).astype(np.uint32)
    starts = (np.cumsum(sizes) - sizes)[full]
    # some documents at a time, so that their hashes stay in the cache
    cuts = np.searchsorted(starts, np.arange(0, len(x), 1 << 16))
    cuts = np.unique(np.r_[cuts, len(full)])
    for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
        if a == b:
            continue
        begin, end = starts[a], starts[b] if b < len(full) else len(x)
        part, local = x[begin:end], starts[a:b] - begin
        for i in range(len(FACTORS)):
            least = np.minimum.reduceat((part ^ MASKS[i]) * FACTORS[i], local)
            out[full[a:b], i] = (least ^ (least >> np.uint32(11))) & np.uint32(255)
    return out


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, node, size, signature): one row a document. ``node`` is a 128-bit name of its shingle set."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_key"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            flat, sizes = shingle_sets(Words(pa.chunked_array([batch.column(1)])), width)
            nodes = node_names(flat, sizes)
            marks = signatures(flat, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes), pa.array([m.tobytes() for m in marks], pa.binary())],
                names=["doc_id", "row_key", "node", "size", "signature"],
            )

    return rows.mapInArrow(work, "doc_id long, row_key long, node binary, size long, signature binary")


def node_names(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Sums of two hashes over each set, with its size mixed in."""
    sums = []
    for odd in ODD[:2]:
        total = np.cumsum(np.r_[U(0), mixed(flat ^ odd)], dtype=U)
        ends = np.cumsum(sizes)
        sums.append(mixed(total[ends] - total[ends - sizes] + sizes.astype(U) * odd))
    return [a.tobytes() + b.tobytes() for a, b in zip(*sums, strict=True)]


class Forest:
    """Union of places, keeping for each the smallest place it is tied to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Runs of whole groups of rows sorted by ``keys``, of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            held.append(part)
            n += part.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = numbered(table, keys)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), len(group) - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, in order."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table[k].combine_chunks()
        values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def recall_at(similarity: np.ndarray, length: int) -> np.ndarray:
    """How likely pairs share a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** TREES


def compare(table: pa.Table, shortest: int, threshold: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ties between nodes of subtrees whose signatures agree in enough places, and the prefix length at which each subtree ended.

    Rows lie in the order of their labels within a subtree (or a pair of its
    blocks), so that what a row shares with those behind it only gets shorter.
    """
    group = numbered(table, ["key", "x", "y"])
    n = len(group)
    marks = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(n, TREES, DEPTH)
    tree = table["tree"].to_numpy()
    label = np.ascontiguousarray(marks[np.arange(n), tree]).view(">u8").ravel().astype(np.uint64)
    whole = marks.reshape(n, TREES * DEPTH).view(np.uint64)
    flat = marks.reshape(n, TREES * DEPTH)
    cross = table["x"].to_numpy() != table["y"].to_numpy()
    side = table["block"].to_numpy()
    forest = Forest(n)
    bits = TREES * DEPTH
    farthest = np.full(group[-1] + 1, np.inf)
    ended = np.zeros(group[-1] + 1, int)
    for length in range(DEPTH, shortest - 1, -1):
        here = np.flatnonzero(ended[group] == 0)
        for d in range(1, n):
            here = here[here + d < n]
            here = here[group[here] == group[here + d]]
            # the bytes from the first that differs on are the lowest ones
            apart = label[here] ^ label[here + d]
            near = apart >> U(8 * (DEPTH - length)) == 0 if length else np.ones(len(here), bool)
            here, apart = here[near], apart[near]
            if not len(here):
                break
            new = here if length == DEPTH else here[apart >> U(8 * (DEPTH - length - 1)) > 0]
            new = new[~(cross[new] & (side[new] == side[new + d]))]
            for start in range(0, len(new), 4096):
                i = new[start : start + 4096]
                i = i[forest.root[i] != forest.root[i + d]]
                # whole labels that are equal were met in the first such tree
                same = whole[i] == whole[i + d]
                i = i[~same.any(1) | (np.argmax(same, axis=1) == tree[i])]
                agree = (flat[i] == flat[i + d]).sum(1)
                forest.tie(i[agree >= least], i[agree >= least] + d)
                similar = agree >= threshold * bits
                np.minimum.at(farthest, group[i[similar]], agree[similar] / bits)
        likely = recall_at(np.where(np.isinf(farthest), threshold, farthest), length) >= RECALL
        ended[(ended == 0) & (likely | (length == shortest))] = length
    tied = np.flatnonzero(forest.root != np.arange(n))
    return tied, forest.root[tied], ended


def candidate_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest over the nodes whose signatures say that they may be similar."""
    shortest = prefix_length(threshold)
    bits = TREES * DEPTH
    least = bits * (threshold - ERRORS * (threshold * (1 - threshold) / bits) ** 0.5)
    rows = nodes.filter("size > 0")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    keyed = rows.select("node", "signature", tree.alias("tree")).select("node", "tree", F.xxhash64("tree", F.expr(f"substring(signature, tree * {DEPTH} + 1, {shortest})")).alias("key"))
    # subtrees of two nodes and more; their sizes are summed before anything moves
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes.hint("merge"), "key")
    blocks = F.ceil(F.col("n") / PREFIX_BLOCK).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("key", "tree", "node", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    signed = tasks.join(rows.select("node", "signature").hint("merge"), "node")
    signed = signed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", F.expr(f"substring(signature, tree * {DEPTH} + 1, {DEPTH})"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["key", "x", "y"]):
            a, b, _ = compare(table, shortest, threshold, least)
            names = table["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], names=["a", "b"])

    return signed.select("key", "tree", "node", "block", "x", "y", "signature").mapInArrow(work, "a binary, b binary")


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key may be a wanted one, by a bitmap of hashed keys: FILTER_BITS bits whatever the tables."""
    per = 32_768
    place = lambda k: F.pmod(F.xxhash64(F.lit(29), F.col(k)), F.lit(FILTER_BITS))
    at, part, held = common.spare(rows, "_place", "_part", "_bitmap")
    # a row holds the bits of 32768 places in 4096 bytes
    maps = wanted.select(place(wanted_key).alias(at)).groupBy(F.floor(F.col(at) / per).cast("int").alias(part)).agg(F.bitmap_construct_agg(F.col(at) % per).alias(held))
    found = rows.withColumn(at, place(key)).withColumn(part, F.floor(F.col(at) / per).cast("int")).join(F.broadcast(maps), part)
    byte = f"cast(conv(hex(substring({held}, cast({at} % {per} div 8 as int) + 1, 1)), 16, 10) as int)"
    return found.filter(F.expr(f"({byte} & shiftleft(1, cast({at} % 8 as int))) > 0")).drop(at, part, held)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    number = np.cumsum(new) - 1
    held = np.bincount(number)
    # those of one set only are in no intersection
    many = held > 1
    rank = np.cumsum(many) - 1
    keep = many[number]
    column, owner = rank[number[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)
    step = max(256, (4 << 20) // max(1, n))
    for start in range(0, int(many.sum()), step):
        a, b = np.searchsorted(column, [start, start + step])
        m = np.zeros((n, step), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        out += m @ m.T
    return out.astype(np.int64)


def verify(table: pa.Table, threshold: float) -> pa.Table:
    """(a, b, links) for the nodes of two blocks of a cluster: its links there, and a node it is tied to (itself if none)."""
    nodes = table["node"].to_pylist()
    first = sorted({n: i for i, n in reversed(list(enumerate(nodes)))}.values())
    nodes = [nodes[i] for i in first]
    block = table["block"].to_numpy()[first]
    copies = table["copies"].to_numpy()[first]
    sets = [np.frombuffer(table["shingles"][i].as_buffer(), U) for i in first]
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    similar = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(similar, False)
    if table["x"][0].as_py() != table["y"][0].as_py():
        similar &= block[:, None] != block[None, :]
    links = similar @ copies
    forest = Forest(len(nodes))
    a, b = np.nonzero(np.triu(similar))
    forest.tie(a, b)
    return pa.table({"a": pa.array(nodes, pa.binary()), "b": pa.array([nodes[r] for r in forest.root], pa.binary()), "links": pa.array(links.astype(np.int64))})


def clusters(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, class_id, keeper, n_links, n_copies), one row a document.

    ``class_id`` is the smallest id of the documents that links connect,
    ``keeper`` the row key of the row that stands for the class, ``n_links`` the
    number of other documents whose similarity is at least the threshold, and
    ``n_copies`` how many of these have the very same shingles.
    """
    common.use_checkpoints(docs.sparkSession)
    marked = sketch(docs, width, id_col, text_col).checkpoint()
    # the smallest id first, rows without one last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    nodes = marked.groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")).checkpoint()
    ties = components(candidate_edges(nodes, threshold))
    members = ties.select("node", F.col("root").alias("cluster")).join(nodes.select("node", "first", "copies", "size"), "node")
    sums = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / CLUSTER_BLOCK), F.ceil(F.col("total") / CLUSTER_SHINGLES)).cast("int")
    members = members.join(sums.select("cluster", blocks.alias("blocks")), "cluster").checkpoint()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("text"))
    wanted = members.select("node", "cluster", "copies", "blocks", F.col("first.doc_id").alias("doc_id_"), F.col("first.row_key").alias("row_key_"))
    texts = maybe_in(texts, "row_key", members.select(F.col("first.row_key").alias("row_key")), "row_key")
    found = texts.join(wanted.hint("merge"), (F.col("row_key") == F.col("row_key_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            flat, sizes = shingle_sets(Words(pa.chunked_array([batch.column(batch.schema.names.index("text"))])), width)
            ends = np.cumsum(sizes)
            sets = pa.array([flat[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ("node", "cluster", "copies", "blocks")), sets], names=["node", "cluster", "copies", "blocks", "shingles"])

    sets = found.select("node", "cluster", "copies", "blocks", "text").mapInArrow(shingles, "node binary, cluster binary, copies long, blocks int, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = sets.select("cluster", "node", "copies", "shingles", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    checked = tasks.groupBy("cluster", "x", "y").applyInArrow(lambda t: verify(t, threshold), "a binary, b binary, links long").checkpoint()
    links = checked.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(checked.select("a", "b"))
    merged = nodes.select("node", "first", "copies").join(roots.hint("merge"), "node", "left").withColumn("class", F.coalesce("root", "node"))
    heads = merged.groupBy("class").agg(F.min("first").alias("head"))
    per_node = merged.join(heads.hint("merge"), "class").join(links.withColumnRenamed("a", "node").hint("merge"), "node", "left")
    per_node = per_node.select("node", F.col("head.doc_id").alias("class_id"), F.col("head.row_key").alias("keeper"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return marked.select("doc_id", "row_key", "node").join(per_node.hint("merge"), "node").drop("node")


def keep_one(docs: DataFrame, *, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their class: one of each."""
    key, turn, keep_id, keep_key = common.spare(docs, "_key", "_turn", "_keep_id", "_keep_key")
    found = clusters(docs, threshold=threshold, width=width, id_col=id_col, text_col=text_col)
    keepers = found.filter((F.col("row_key") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(keep_id), F.col("row_key").alias(keep_key))
    rows = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    rows = rows.join(keepers.hint("merge"), (F.col(key) == F.col(keep_key)) & F.col(id_col).eqNullSafe(F.col(keep_id)), "left_semi")
    # of rows of one id and text the one of smallest hash stays; equal hashes are rows that repeat in full
    rows = rows.withColumn(turn, F.row_number().over(Window.partitionBy(key, id_col).orderBy(F.xxhash64(*docs.columns)))).filter(F.col(turn) == 1)
    return rows.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """One row per document with its class and its number of links."""
    return found.select("doc_id", "class_id", "n_links", "n_copies")


#: The columns of op9, at its width and threshold, by all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), sets AS (
  SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS node, count(*) AS size FROM shingles GROUP BY r
), docs AS (
  SELECT doc_id, coalesce(node, '') AS node, size FROM texts LEFT JOIN sets USING (r)
), nodes AS (
  SELECT node, min(doc_id) AS first_id, count(*) AS copies, any_value(size) AS size FROM docs GROUP BY node
), firsts AS (
  SELECT node, min(r) AS r FROM sets GROUP BY node
), held AS (
  SELECT node, s FROM shingles JOIN firsts USING (r)
), pairs AS (
  SELECT a.node AS x, b.node AS y, count(*) AS n FROM held a JOIN held b ON a.s = b.s AND a.node < b.node GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN nodes p ON x = p.node JOIN nodes q ON y = q.node WHERE n >= 0.8 * (p.size + q.size - n) - 1e-9
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT node, node FROM nodes UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), classes AS (
  SELECT x AS node, min(first_id) AS class_id FROM reach JOIN nodes ON y = node GROUP BY x
), degrees AS (
  SELECT x AS node, sum(copies)::BIGINT AS others FROM edges JOIN nodes ON y = node GROUP BY x
)
SELECT doc_id, class_id, coalesce(others, 0) + copies - 1 AS n_links, copies - 1 AS n_copies FROM docs JOIN nodes USING (node) JOIN classes USING (node) LEFT JOIN degrees USING (node)
"""
