"""Ordering, grouping, caps, paging and rerank bookkeeping of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.sources.store import use_checkpoints

#: Lines of a proximity bucket; results at most; shares from which symbols count as rich and mixed.
PROXIMITY_LINES, MAX_RESULTS = 25, 200
RICH, MIXED = 0.60, 0.20
#: Candidates of a pass and rows of a rerank at most.
MOST_CANDIDATES, MOST_RERANKED = 80, 50
#: Rows that an answer may hold before the driver-bounded greedy steps.
GREEDY_ROWS = 200


def native_order() -> list[Column]:
    """Must matches, exact matches, then fusion score; the rest breaks ties."""
    return [F.desc("must"), F.desc("exact"), F.desc("score"), F.asc("path"), F.asc_nulls_last("start_line"), F.asc("label"), F.asc("id")]


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The rows with their place, from 1, in the order.

    The rows are sorted by ranges and kept on shared storage; a row's place is
    its number in its range behind those of the ranges before, so that no task
    holds more than a range.
    """
    use_checkpoints(rows.sparkSession)
    placed = rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at_", 33)
    sizes = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # one row a range
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part_ long, before_ long"))
    place = (F.col("before_") + F.col("at_") - F.shiftleft(part, 33) + 1).cast("long")
    return placed.join(table, part == F.col("part_")).withColumn(name, place).drop("part_", "before_", "at_")


def authoritative_rank(rows: DataFrame) -> DataFrame:
    return ranked(rows, native_order())


def group_key(path: Column, symbol_key: Column, instance: Column, start_line: Column, by: str = "symbol") -> Column:
    """Owner symbol, file, or a bucket of neighbouring lines."""
    owner = F.concat_ws(":", F.lit("owner"), path, symbol_key, instance)
    near = F.concat_ws(":", F.lit("fallback"), path, F.floor((start_line - 1) / PROXIMITY_LINES).cast("string"))
    return F.concat(F.lit("file:"), path) if by == "file" else F.when(symbol_key.isNotNull(), owner).otherwise(near)


def fallback_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("grp_"), F.substring(F.sha1(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))), 1, 16))


def reduce_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: its best chunk by pin and rank, the span it covers, the latest time and the number of chunks."""
    best = F.struct((~F.col("pinned")).alias("p"), F.col("rank").alias("r"))
    return rows.groupBy(*keys).agg(F.min_by("id", best).alias("representative"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("indexed_at").alias("indexed_at"), F.count("*").alias("chunks"), F.min("rank").alias("best_rank"))


def collapse_declarations(rows: DataFrame) -> DataFrame:
    """Of groups with the same file, label and owner the best ranked, with the ids of all."""
    return rows.groupBy("file", "label", "owner").agg(F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def diversity(rows: DataFrame, *, limit: int, per_file: int = 2, per_symbol: int = 1, relaxed: int = 3) -> DataFrame:
    """(id, kept, reason): greedy caps in rank order, with a second pass of a wider file cap if too few are left.

    Rows are an answer's ranked groups (id, file, symbol, rank); only the first
    GREEDY_ROWS are looked at, as an answer holds no more.
    """
    head = rows.select("id", "file", "symbol", "rank").orderBy("rank", "id").limit(GREEDY_ROWS)

    def greedy(pdf):
        pdf = pdf.sort_values(["rank", "id"])
        files, symbols, kept = {}, {}, []
        reasons = {}

        def take(r, cap):
            if symbols.get(r.symbol, 0) >= per_symbol:
                return "symbol_cap"
            if files.get(r.file, 0) >= cap:
                return "file_cap"
            if len(kept) >= limit:
                return "limit"
            files[r.file] = files.get(r.file, 0) + 1
            symbols[r.symbol] = symbols.get(r.symbol, 0) + 1
            kept.append(r.id)
            return None

        for r in pdf.itertuples():
            reasons[r.id] = take(r, per_file)
        if len(kept) < limit:
            for r in pdf.itertuples():
                if reasons[r.id] == "file_cap":
                    reasons[r.id] = take(r, relaxed)
        return pdf.assign(kept=[reasons[i] is None for i in pdf.id], reason=[reasons[i] for i in pdf.id])[["id", "rank", "kept", "reason"]]

    return head.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: greedy(pdf), f"id {rows.schema['id'].dataType.simpleString()}, rank int, kept boolean, reason string")


def byte_budget(rows: DataFrame, size: Column, budget: int, order: list) -> DataFrame:
    """The longest beginning of the rows whose sizes stay within the budget; nothing after the first overflow.

    Sums of the ranges before tell which ranges begin within the budget; only
    those are summed row by row, each in its own task.
    """
    use_checkpoints(rows.sparkSession)
    placed = rows.withColumn("size_", size).orderBy(*order).withColumn("at_", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at_", 33)
    sums = {r.part: r.total for r in placed.groupBy(part.alias("part")).agg(F.sum("size_").alias("total")).collect()}  # one row a range
    before, offsets = 0, []
    for p in sorted(sums):
        if before > budget:
            break
        offsets.append((p, before))
        before += sums[p]
    if not offsets:
        return placed.withColumn("total_bytes", F.lit(0).cast("long")).drop("size_", "at_").limit(0)
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part_ long, before_ long"))
    upto = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(table, part == F.col("part_"))
    return near.withColumn("total_bytes", F.col("before_") + F.sum("size_").over(upto)).filter(F.col("total_bytes") <= budget).drop("part_", "before_", "at_", "size_")


def family_pool(rows: DataFrame, limit: int, supplements: int = 2) -> DataFrame:
    """The first of each family in order, then up to so many more of each in turn."""
    turn = F.row_number().over(Window.partitionBy("family").orderBy("rank", "id"))
    order = [(F.col("turn") > 1).cast("int"), "turn", "rank", "id"]
    # at most ``limit`` rows are left before they are numbered
    head = rows.withColumn("turn", turn).filter(F.col("turn") <= 1 + supplements).orderBy(*order).limit(limit)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def apply_rerank(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows, in order of their new score, in the places that they held before; all others stay.

    rows: (id, rank); chosen: (id, rerank_score), as many as a reranker takes.
    """
    held = rows.join(chosen, "id")
    slots = held.select("rank", F.row_number().over(Window.orderBy("rank")).alias("n"))
    order = held.select("id", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rank")).alias("n"))
    moved = slots.join(order, "n").select("id", F.col("rank").alias("new_rank"))
    return rows.join(moved, "id", "left").select("id", F.coalesce("new_rank", "rank").alias("rank"))


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def after_key(rows: DataFrame, key: str, last: str, limit: int) -> DataFrame:
    return rows.filter(F.col(key) > last).orderBy(key).limit(limit)


def fingerprint(rows: DataFrame, key: str) -> str:
    """A mark of a set of keys; pages of one set carry the same."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}"


def keyset_page(rows: DataFrame, key: str, limit: int, cursor: tuple[str, str] | None = None) -> tuple[DataFrame, tuple[str, str] | None]:
    """A page of rows by key and the cursor (last key, fingerprint) of the next one, none after the last; a cursor of another set is refused."""
    mark = fingerprint(rows, key)
    if cursor is not None and cursor[1] != mark:
        raise ValueError("the rows have changed since the cursor was made")
    page = after_key(rows, key, cursor[0], limit + 1) if cursor is not None else rows.orderBy(key).limit(limit + 1)
    keys = [r[key] for r in page.select(key).orderBy(key).collect()]  # no more than a page
    more = len(keys) > limit
    return page.orderBy(key).limit(limit), (keys[limit - 1], mark) if more else None


def quality(ratio: Column, eligible: Column) -> Column:
    return F.when(eligible <= 0, "unknown").when(ratio >= RICH, "symbol_rich").when(ratio >= MIXED, "mixed").otherwise("symbol_sparse")


def result_counts(requested: int, available: int, most: int = MAX_RESULTS) -> dict[str, int]:
    """How many results are shown and how many there are that an answer could show."""
    shown = max(0, min(requested, available, most))
    return {"requested": requested, "available": available, "shown": shown, "left": max(0, min(available, most) - shown)}


def disclosed(sizes: list[int], requested: int, budget: int, envelope: int = 0) -> int:
    """How many of the results, in order, fit an answer of so many bytes with its envelope."""
    used, n = envelope, 0
    for size in sizes[: min(requested, MAX_RESULTS)]:
        used += size
        if used > budget:
            break
        n += 1
    return n


def candidate_limit(limit: int) -> int:
    return max(1, min(MOST_CANDIDATES, max(8 * limit, 32)))


def rerank_budget(limit: int, ambiguous: bool) -> int:
    return min(MOST_RERANKED, max(12, 4 * limit) if ambiguous else 2 * limit)


def uncovered(spans: DataFrame, keys: list[str], whole: tuple[str, str]) -> DataFrame:
    """The gaps (gap_start, gap_end) that the spans [start, end) of a key leave in its whole [begin, finish)."""
    begin, finish = whole
    order = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("reach", F.coalesce(F.max("end").over(order), F.col(begin)))
    inner = covered.filter(F.col("start") > F.col("reach")).select(*keys, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))
    tail = spans.groupBy(*keys).agg(F.max("end").alias("gap_start"), F.max(finish).alias("gap_end")).filter("gap_start < gap_end")
    return inner.unionByName(tail)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Structs (start, piece) of overlapping windows; the last ends with the text."""
    step = size - overlap
    count = F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - size) / F.lit(step)) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), text.substr(i * step + 1, F.lit(size)).alias("piece")))
