"""Joins of spans, names and modules, each with its rule for more than one match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Lines of a bin by which spans meet the lines that they may hold.
BIN = 64
#: Bins that a span is listed in one by one; longer ones are listed by larger bins.
SPREAD = 8


def innermost(inner: DataFrame, outer: DataFrame, *, keys: list[str], file: str = "file") -> DataFrame:
    """Each inner span with the smallest outer span of its file that contains it; of equal ones the first by kind and key. Null if none does.

    inner: keys, file, start_line, end_line; outer: file, s, e, kind_rank, symbol_key.
    A span is listed in bins of its own scale, at most SPREAD + 1 of them, and an
    inner one looks into the bin of its first line at every scale: a long file
    costs its spans times the depth of their nesting, not their square.
    """
    scales = [BIN * SPREAD**i for i in range(5)]
    length, scale = F.col("e") - F.col("s") + 1, F.lit(len(scales) - 1)
    for i, size in reversed(list(enumerate(scales))):
        scale = F.when(length <= size * SPREAD, F.lit(i)).otherwise(scale)
    width = F.element_at(F.array(*map(F.lit, scales)), F.col("scale_") + 1)
    listed = outer.select(F.col(file).alias("file_"), "s", "e", "kind_rank", "symbol_key", scale.alias("scale_"))
    listed = listed.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    looks = F.array(*(F.struct(F.lit(i).alias("scale_"), F.floor(F.col("start_line") / size).alias("bin_")) for i, size in enumerate(scales)))
    asked = inner.withColumn("look_", F.explode(looks)).select(*inner.columns, "look_.scale_", "look_.bin_")
    pairs = asked.join(listed, (F.col(file) == F.col("file_")) & (asked["scale_"] == listed["scale_"]) & (asked["bin_"] == listed["bin_"]) & (F.col("s") <= F.col("start_line")) & (F.col("end_line") <= F.col("e")))
    order = F.struct((F.col("e") - F.col("s")).alias("size"), "kind_rank", "symbol_key")
    best = pairs.groupBy(*keys).agg(F.min_by("symbol_key", order).alias("owner"), F.count("*").alias("containing"))
    return inner.select(*keys).distinct().join(best, keys, "left").withColumn("containing", F.coalesce("containing", F.lit(0).cast("long")))


def unique_parent(rows: DataFrame, parents: DataFrame, *, keys: list[str], on: list[str]) -> DataFrame:
    """The innermost parent by (on, containment), null where the smallest size is shared by several.

    Rows may repeat. One pass over the pairs keeps the first and the last parent
    of the smallest size, which are the same if it is the only one.
    """
    p = parents.select(*[F.col(c).alias(f"{c}_") for c in on], "s", "e", "symbol_key")
    hit = (F.col("s") <= F.col("start_line")) & (F.col("end_line") <= F.col("e"))
    for c in on:
        hit = hit & (F.col(c) == F.col(f"{c}_"))
    size = F.col("e") - F.col("s")
    # a null key is no parent, but its size counts: it comes last in either order
    first, last = F.min(F.struct(size, F.col("symbol_key").isNull(), F.col("symbol_key").alias("key"))), F.max(F.struct(-size, F.col("symbol_key").alias("key")))
    least = rows.join(p, hit).groupBy(*keys).agg(first.alias("a"), last.alias("z"))
    return least.select(*keys, F.when(F.col("a.key") == F.col("z.key"), F.col("a.key")).alias("parent"))


def resolve_unambiguous(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(call, target): the only target of the name in the call's file, else the only one anywhere, else null.

    Counts are taken per name on the targets, so that a common name costs one
    row and not one for each pair.
    """
    local = targets.groupBy("name", "file").agg(F.count("*").alias("n_here"), F.min("key").alias("here"))
    world = targets.groupBy("name").agg(F.count("*").alias("n_all"), F.min("key").alias("anywhere"))
    found = calls.join(local, ["name", "file"], "left").join(world, "name", "left")
    return found.select("call", F.when(F.col("n_here") == 1, F.col("here")).when(F.col("n_here").isNull() & (F.col("n_all") == 1), F.col("anywhere")).alias("target"))


def first_module(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import, path): the first of an import's candidate paths that is a file."""
    tries = imports.select("import", F.posexplode("candidates").alias("turn", "path"))
    return tries.join(files.select("path"), "path").groupBy("import").agg(F.min_by("path", "turn").alias("path"))


def unique_suffix(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): the only file whose path ends in the dotted name, null if several do."""
    parts = F.split("path", "/")
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    only = suffixes.groupBy("name").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return names.join(only.select("name", "path"), "name", "left")


def nearest_line(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(call, target, same_file): of the targets of the call's name those of its file, else all; of these the one that starts nearest.

    Equally near ones are decided by file, line and key. Calls and targets of a
    name are swept together in order of lines, so that a call meets the target
    before and the one behind it, and not all of its name. Calls without a target
    give no row.
    """
    t = targets.select(F.lower("name").alias("name"), "file", "line", "key")
    c = calls.select("call", F.lower("name").alias("name"), "file", "line")
    here = _swept(c, t.groupBy("name", "file", "line").agg(F.min(F.struct("file", "line", "key")).alias("t")), ["name", "file"])
    there = _swept(c, t.groupBy("name", "line").agg(F.min(F.struct("file", "line", "key")).alias("t")), ["name"])
    same = here.select("call", "key", F.lit(True).alias("same_file"))
    other = there.join(here, "call", "left_anti").select("call", "key", F.lit(False).alias("same_file"))
    return same.unionByName(other).withColumnRenamed("key", "target")


def _swept(calls: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """(call, key): the nearest target by line among those that agree in ``on``; targets: on, line and the struct t (file, line, key)."""
    kind = targets.schema["t"].dataType.simpleString()
    both = calls.select(*on, "line", "call", F.lit(None).cast(kind).alias("t")).unionByName(targets.select(*on, "line", F.lit(None).cast(calls.schema["call"].dataType).alias("call"), "t"))
    order = Window.partitionBy(*on).orderBy("line", F.col("call").isNotNull())
    back = Window.partitionBy(*on).orderBy(F.desc("line"), F.col("call").isNotNull())
    seen = both.withColumn("before", F.last("t", True).over(order)).withColumn("behind", F.last("t", True).over(back)).filter("call IS NOT NULL")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("line") - F.col(c)["line"]).alias("far"), F.col(c).alias("t")))
    best = F.least(near("before"), near("behind"))
    return seen.select("call", best["t"]["key"].alias("key")).filter("key IS NOT NULL")


def capped(rows: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n_") <= cap).drop("n_")


def exact_lookup(symbols: DataFrame, asked: DataFrame, tiers: list[tuple[str, Column]]) -> DataFrame:
    """(query, tier, status, key): the first tier with a match decides; several matches there are ambiguous.

    symbols: key and what the tier columns need; asked: query, term, one row a query.
    """
    levels = [symbols.select("key", F.lit(i).alias("tier"), c.alias("value")) for i, (_, c) in enumerate(tiers)]
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    # a value is one row a tier, however many symbols have it
    known = every.filter("value IS NOT NULL").groupBy("tier", "value").agg(F.countDistinct("key").alias("n"), F.min("key").alias("key"))
    hits = asked.select("query", "term").join(known, F.col("term") == F.col("value"))
    first = hits.groupBy("query").agg(F.min_by(F.struct("tier", "n", "key"), "tier").alias("m"))
    found = asked.select("query").join(first, "query", "left")
    return found.select("query", F.col("m.tier").alias("tier"), F.when(F.col("m.n").isNull(), "missing").when(F.col("m.n") == 1, "hit").otherwise("ambiguous").alias("status"), F.when(F.col("m.n") == 1, F.col("m.key")).alias("key"))
