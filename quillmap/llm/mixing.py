"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot ``i`` of the schedule gets the point ``frac((i + 1) * golden ratio)`` and
with it the source whose stretch of the cumulative slot weights holds the point.
Slots are ranked within their source, and rank ``r`` takes block ``r`` of that
source: its documents, shuffled by a seeded hash, lie one behind the other on
one line of words that is cut into blocks of equal length. Ranks past the last
block begin the line again, so no word is taken more often than the cap of the
source's target says. The last slot of a source takes only what its target
still lacks, so every source meets its target to the word.

Only DataFrame operations are used. Positions on a line and ranks of slots come
from sums over buckets and then over the rows of a bucket, so that a source with
a third of all rows is spread like any other.

Cases: a null or blank text has size 0 and is never taken; null sources form one
source, the last; a null id is an id like any other; repeated rows are separate
rows, each with its own place; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.llm import common
from quillmap.operators import shape

#: 2**31 divided by the golden ratio, odd: the step of the points, in units of 2**-31.
STEP, UNIT = 1327217885, 1 << 31
#: Slots are made, and ranked, in chunks of so many.
CHUNK = 4096
#: Cells of the unit interval by which slots find their source.
CELLS = 4096
#: More sources than this are joined by a shuffle and not broadcast.
BROADCAST_SOURCES = 10_000
#: Sums that are read at once while the level is sought.
STRETCHES = 256


@dataclass(frozen=True)
class Recipe:
    """Weights repeat over the sources in order; the mix holds ``share`` of all words; a source gives at most ``most`` times its words."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block_words: int = 1024
    buckets: int = 2048
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def sized(docs: DataFrame, recipe: Recipe, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, copies, words, h, bucket), one row for all that agree in id, source and size.

    Such rows differ in nothing that the mix looks at, so they lie one behind the
    other on their line and are told apart again at the end. Kept on shared
    storage, so that the texts are read once.
    """
    common.use_checkpoints(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    h = F.xxhash64(F.lit(recipe.seed), F.col("doc_id"), F.col("size"))
    return rows.withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(recipe.buckets)).cast("int")).checkpoint()


def water_level(sources: DataFrame, total: float) -> float:
    """The level L at which the sum of ``min(cap, L * w)`` over the sources is the total; infinite if the caps are not more.

    Sums by stretches of cap / w tell in which stretch the level lies; that one
    is cut again until its ratios are equal. At most STRETCHES sums are read in a
    round, whatever the number of sources.
    """
    rows = sources.select("cap", "w", (F.col("cap") / F.col("w")).alias("r"))
    caps, open_weight = rows.agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    if caps <= total:
        return float("inf")
    # sources that the level fills, and the weight of the others
    full = 0.0
    while True:
        least, most = rows.agg(F.min("r"), F.max("r")).first()
        if least == most:
            return (total - full) / open_weight
        cell = F.floor((F.col("r") - least) / (most - least) * (STRETCHES - 1))
        sums = rows.groupBy(cell.alias("cell")).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max("r").alias("r"))
        for part in sorted(sums.collect(), key=lambda x: x.cell):
            if full + part.cap + part.r * (open_weight - part.w) > total:
                rows = rows.filter(cell == part.cell)
                break
            full, open_weight = full + part.cap, open_weight - part.w


def targets(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """(s, source, source_size, target, quota, blocks, slots), one row a source; s counts from 1.

    The reshared excess ends at ``target = min(cap, level * weight)``.
    """
    sums = rows.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = shape.ranked(sums, [F.col("source").asc_nulls_last()], "s")
    weights = F.array(*map(F.lit, recipe.weights))
    ranked = ranked.withColumn("w", F.element_at(weights, ((F.col("s") - 1) % len(recipe.weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(recipe.most))
    words = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    target = F.least(F.col("cap"), F.lit(water_level(ranked, words * recipe.share)) * F.col("w"))
    b = F.lit(recipe.block_words)
    quota, blocks = F.round(F.col("target")).cast("long"), F.ceil(F.col("source_size") / b).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    slots = full * F.col("blocks") + F.ceil((F.col("quota") - full * F.col("source_size")) / b).cast("long")
    return ranked.withColumn("target", target).withColumn("quota", quota).withColumn("blocks", blocks).select("s", "source", "source_size", "target", "quota", "blocks", slots.alias("slots"))


def summed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The rows, which are numbered by ``s``, with the sum of a value up to and with each; sums of buckets come first."""
    bucket = F.floor(F.col("s") / CHUNK)
    sums = rows.groupBy(bucket.alias("bucket_")).agg(F.sum(value).alias("in_"))
    before = sums.withColumn("before_", F.sum("in_").over(Window.orderBy("bucket_")) - F.col("in_")).drop("in_")
    within = Window.partitionBy("bucket_").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("bucket_", bucket).withColumn("upto_", F.sum(value).over(within)).join(before.hint("merge"), "bucket_")
    return placed.withColumn(name, F.col("before_") + F.col("upto_")).drop("bucket_", "upto_", "before_")


def bounded(sources: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources.hint("merge")


def on_lines(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """The documents with their source's columns and ``start``, their place on its line of words."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"))
    offsets = sums.withColumn("offset", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "offset")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("words").over(within))
    placed = placed.join(offsets.hint("merge"), F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    placed = placed.select("doc_id", "source", "size", "copies", (F.col("offset") + F.col("upto") - F.col("words")).alias("start"))
    # copies one by one, a bounded number of them at once
    heaps = placed.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    each = heaps.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("copies")) - 1)))
    each = each.select("doc_id", "source", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start"), "copy")
    return each.join(bounded(sources.withColumnRenamed("source", "source_"), n_sources), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def schedule(sources: DataFrame, n_sources: int, recipe: Recipe) -> DataFrame:
    """(slot, s, rank, block, words): which block each slot takes, and how many of its words.

    The planner takes the slots, which come from one row, for few: hints keep it
    from broadcasting them.
    """
    open_ = sources.filter("slots > 0")
    n = open_.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    weighted = summed(open_, "slots", "upto").withColumn("n", F.lit(n).cast("long"))
    weighted = weighted.withColumn("low", (F.col("upto") - F.col("slots")).cast("double") / F.col("n")).withColumn("high", F.col("upto").cast("double") / F.col("n")).drop("upto")
    # about one source a cell, however many there are
    n_cells = max(CELLS, n_sources)
    chunks = sources.sparkSession.range(-(-n // CHUNK)).select(F.lit(n).cast("long").alias("n"), F.col("id").alias("chunk"))
    slots = chunks.repartition("chunk").select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)).alias("slot"))
    slots = slots.withColumn("u", ((F.col("slot") + 1) % UNIT * STEP % UNIT) / F.lit(float(UNIT))).withColumn("cell", F.floor(F.col("u") * n_cells))
    cells = weighted.select("s", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * n_cells), F.least(F.floor(F.col("high") * n_cells), F.lit(n_cells - 1)))).alias("cell"))
    hits = slots.join(bounded(cells, n_sources), "cell").filter("low <= u AND u < high").select("s", "slot", "chunk")
    per_chunk = hits.groupBy("s", "chunk").agg(F.count("*").alias("hits"))
    offsets = per_chunk.withColumn("offset", F.sum("hits").over(Window.partitionBy("s").orderBy("chunk")) - F.col("hits")).select("s", "chunk", "offset")
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot"))).join(offsets.hint("merge"), ["s", "chunk"]).select("s", "slot", (F.col("offset") + F.col("r") - 1).alias("rank"))
    # a source that the points reached a few times too seldom gets its last slots after all others
    reached = per_chunk.groupBy("s").agg(F.sum("hits").alias("hits"))
    late = weighted.join(bounded(reached, n_sources), "s", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))).filter("hits < slots")
    late = late.select("s", F.explode(F.sequence(F.col("hits"), F.col("slots") - 1)).alias("rank"), "n").select("s", (F.col("n") + F.col("rank")).alias("slot"), "rank")
    size, b = F.col("source_size"), F.lit(recipe.block_words)
    taken = ranked.unionByName(late).join(bounded(sources.select("s", "source_size", "quota", "blocks", "slots"), n_sources), "s").filter("rank < slots")
    turn, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    length = F.least(b, size - block * b)
    return taken.select("slot", "s", "rank", block.alias("block"), F.least(length, F.col("quota") - turn * size - block * b).cast("long").alias("words")).filter("words > 0")


def pieces(lines: DataFrame, recipe: Recipe) -> DataFrame:
    """(s, block, start, doc_id, at, words): the part of each document that lies in a block, ``at`` counted from the block's begin."""
    b = recipe.block_words
    last = F.floor((F.col("start") + F.col("size") - 1) / b)
    cut = lines.filter("size > 0").select("s", "start", "size", "doc_id", F.explode(F.sequence(F.floor(F.col("start") / b), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * b)
    return cut.select("s", "block", "start", "doc_id", (begin - F.col("block") * b).alias("at"), (begin - F.col("start")).alias("from_word"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - begin).alias("words"))


def mix(docs: DataFrame, recipe: Recipe = Recipe(), **cols: str) -> tuple[DataFrame, DataFrame]:
    """The documents on their lines, and the mix: one row for each piece of a document that a slot takes.

    The mix has slot, s, start, doc_id, from_word and n_words; in slot order it
    is the training stream. ``s`` and ``start`` name the document's row.
    """
    rows = sized(docs, recipe, **cols)
    sources = targets(rows, recipe).checkpoint()
    n_sources = sources.count()
    lines = on_lines(rows, sources, n_sources)
    parts = pieces(lines, recipe)
    slots = schedule(sources, n_sources, recipe).select("slot", "s", "block", F.col("words").alias("slot_words"))
    stream = parts.join(slots.hint("merge"), ["s", "block"]).withColumn("n_words", F.least(F.col("words"), F.col("slot_words") - F.col("at"))).filter("n_words > 0")
    return lines, stream.select("slot", "s", "start", "doc_id", "from_word", "n_words")


def apply(docs: DataFrame, recipe: Recipe = Recipe(), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows of the table, all columns kept: a document stands as often as it is taken whole.

    Blocks are taken in the order of a source's line, so only the one document
    of a source at which its target is reached is taken in part; of it the first
    words stand, joined by one space. Documents that are not taken go.
    """
    key, taken_key, turn, words, times = common.spare(docs, "_key", "_taken_key", "_turn", "_words", "_times")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col).cast("string"), F.col(source_col)))
    counts = taken(keyed, recipe, id_col=key, text_col=text_col, source_col=source_col).filter("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    # rows of one key are counted by what is taken of them, never gathered
    alike = counts.groupBy(F.col("doc_id").alias(taken_key), whole.alias("whole"), rest.alias("rest")).agg(F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit(-1).cast("long").alias("words"), (F.col("whole") * F.col("n")).alias("times")), F.struct(F.col("rest").alias("words"), F.when(F.col("rest") > 0, F.col("n")).otherwise(0).alias("times")))
    parts = alike.select(taken_key, F.explode(kinds).alias("k")).filter("k.times > 0").select(taken_key, F.col("k.words").alias(words), F.col("k.times").alias(times))
    # of rows of one key that of smallest hash stands for them; equal hashes are rows that repeat in full
    once = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))).filter(F.col(turn) == 1)
    rows = once.join(parts.hint("merge"), F.col(key) == F.col(taken_key))
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long"))))
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col(turn)))))
    first_words = F.array_join(F.slice(F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest(F.col(words), F.lit(1)).cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(F.col(words) < 0, F.col(text_col)).otherwise(first_words))
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return rows.select(*docs.columns)


def taken(docs: DataFrame, recipe: Recipe = Recipe(), **cols: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row a document."""
    lines, stream = mix(docs, recipe, **cols)
    sums = stream.groupBy("s", "start").agg(F.sum("n_words").alias("n"))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    found = lines.filter("size > 0").join(sums.hint("merge"), ["s", "start"], "left").select(*columns, F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
    # documents without words have no place of their own on a line
    return found.unionByName(lines.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
