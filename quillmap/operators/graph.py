"""Edges, bounded traversal, closures and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.functions import paths
from quillmap.sources.store import use_checkpoints

EDGE = ["src", "dst", "type", "file"]


def incident(edges: DataFrame, symbol: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    hit = {"out": F.col("src") == symbol, "in": F.col("dst") == symbol, "both": (F.col("src") == symbol) | (F.col("dst") == symbol)}[direction]
    rows = edges.filter(hit)
    return rows.filter(F.col("type").isin(*types)) if types else rows


def neighbours(
    edges: DataFrame, start: DataFrame, *, depth: int, confidences: tuple[str, ...] = ("high",), types: list[str] | None = None, reverse: bool = False, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth) reached in up to three steps, and the edges that were left out for their confidence.

    A level joins the last frontier to the edges; nodes seen before are taken
    out by an anti join. Each frontier is kept on shared storage, so that a level
    reads the edges once. Edges left out do not carry the walk on. With a limit
    the walk ends when so many nodes are reached; of the level that is too much
    the first by name stay.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    use_checkpoints(edges.sparkSession)
    e = edges.filter(F.col("type").isin(*types)) if types else edges
    if reverse:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "file", "confidence")
    trusted, other = e.filter(F.col("confidence").isin(*confidences)), e.filter(~F.col("confidence").isin(*confidences))
    frontier = start.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen = frontier
    for level in range(1, depth + 1):
        near = frontier.filter(F.col("depth") == level - 1).select(F.col("node").alias("src"))
        step = trusted.join(near, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        if limit is not None:
            frontier = frontier.orderBy("node").limit(max(0, limit - seen.count()))
        frontier = frontier.checkpoint()
        seen = seen.unionByName(frontier)
    at = seen.filter(F.col("depth") < depth).select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    left_out = other.join(at, "src").select(*EDGE, "confidence", "depth")
    return seen, left_out


#: Bits of a sieve: for each node, and at most (16 MB).
SIEVE_EACH, SIEVE_MOST = 8, 1 << 27


def _bits(node: Column, size: int) -> tuple[Column, Column]:
    """Word and bit of a node in a sieve of so many bits."""
    at = F.pmod(F.xxhash64(node), F.lit(size))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def sieve(nodes: DataFrame, size: int) -> DataFrame:
    """One row and column: the words of a set of bits that holds every node, and others by chance."""
    words, block = nodes.sparkSession.range(size // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")), 1024
    word, bit = _bits(F.col("node"), size)
    held = nodes.filter("node IS NOT NULL").select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    every = words.unionByName(held).groupBy("w").agg(F.bit_or("b").alias("b"))
    blocks = every.groupBy(F.floor(F.col("w") / block).alias("k")).agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"].alias("v"))
    return blocks.agg(F.flatten(F.sort_array(F.collect_list(F.struct("k", "v")))["v"]).alias("words"))


def with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are known.

    Both ends pass a sieve of the nodes before edges move, so that mostly those
    that stay are dealt out, by either end; the joins decide.
    """
    size = 1 << 12
    most = min(SIEVE_EACH * nodes.count(), SIEVE_MOST)
    while size < most:
        size *= 2
    words = sieve(nodes, size).scalar()

    def passes(node: Column) -> Column:
        word, bit = _bits(node, size)
        return F.call_function("shiftright", F.get(words, word.cast("int")), bit).bitwiseAND(F.lit(1)) == 1

    near = edges.filter(passes(F.col("src")) & passes(F.col("dst")))
    return near.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def tests_of(calls: DataFrame) -> DataFrame:
    """Calls from a test path to one that is none, as TESTS edges."""
    return calls.filter(paths.graph_test_path(F.col("src_path")) & ~paths.graph_test_path(F.col("dst_path"))).withColumn("type", F.lit("TESTS"))


def closure(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """(a, b): every b that a reaches; paths double in each round."""
    use_checkpoints(pairs.sparkSession)
    now = pairs.select("a", "b").distinct()
    size = now.count()
    for _ in range(rounds):
        step = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        now = now.unionByName(step).distinct().checkpoint()
        last, size = size, now.count()
        if size == last:
            return now
    raise RuntimeError("the closure did not settle")


def delta_merge(old: DataFrame, rebuilt: DataFrame, affected: DataFrame, key: list[str]) -> DataFrame:
    """What unaffected files had, with the rebuilt edges put over it."""
    kept = old.join(affected, "file", "left_anti").withColumn("turn_", F.lit(0))
    both = kept.unionByName(rebuilt.withColumn("turn_", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("turn_"))
    return both.withColumn("n_", F.row_number().over(last)).filter("n_ = 1").drop("n_", "turn_")


def affected_files(edges: DataFrame, changed: DataFrame, *, calls: DataFrame | None = None, names: DataFrame | None = None, imports: tuple[DataFrame, DataFrame] | None = None, claims: DataFrame | None = None) -> DataFrame:
    """The files whose edges a change may touch: (file).

    Changed files and those of edges into them (edges: file, dst_file); files that
    call a changed name (calls: file, name; names: name); files whose imports
    resolve otherwise than before (two frames of file, import, path); and files of
    claims that rest on a changed one (claims: file, depends_on).
    """
    out = changed.select("file").unionByName(edges.join(changed.select(F.col("file").alias("dst_file")), "dst_file", "left_semi").select("file"))
    if calls is not None and names is not None:
        out = out.unionByName(calls.join(names.select("name"), "name", "left_semi").select("file"))
    if imports is not None:
        before, after = (i.select("file", "import", "path") for i in imports)
        out = out.unionByName(before.exceptAll(after).unionByName(after.exceptAll(before)).select("file"))
    if claims is not None:
        out = out.unionByName(claims.join(changed.select(F.col("file").alias("depends_on")), "depends_on", "left_semi").select("file"))
    return out.distinct()


def prioritised_notes(notes: DataFrame, *, tests: int = 3) -> DataFrame:
    """Production notes, the first few test notes in all, and one row that counts the test notes left out."""
    test = paths.graph_test_path(F.col("path"))
    ranked = notes.withColumn("test", test).withColumn("n_", F.lit(0))
    # the few test notes that stay are taken by a limit, so that no task sorts all
    first = ranked.filter("test").orderBy("path", "line", "kind").limit(tests)
    kept = ranked.filter(~F.col("test")).unionByName(first).select("kind", "path", "line", F.lit(1).cast("long").alias("count"))
    rest = ranked.filter("test").agg((F.count("*") - tests).alias("count")).filter("count > 0")
    return kept.unionByName(rest.select(F.lit("summary").alias("kind"), F.lit("(more tests)").alias("path"), F.lit(None).cast("long").alias("line"), "count"))
