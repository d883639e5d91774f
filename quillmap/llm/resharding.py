"""Minimum-cost-flow resharding.

Rows of an old layout lie in blocks: a block is a slice of the text-hash range
of one old shard, so copies of a text share a block unless they outgrow it. From
the old shard sizes and the new capacities a minimum-cost flow (a byte that
stays costs nothing, a byte that moves costs one) says how many bytes each old
shard gives to each new one; whole blocks then fill that flow. Only files of
shards whose content changes are written.

The planner sees block sizes only. Their number is bounded by a parameter
whatever the rows: heavy slices are cut again by id, and rows only meet the plan
in a join by block.

Cases: a null text counts as empty (no bytes) and every row adds one byte; a
null id is hashed like a value; repeated rows are rows of their own and are cut
apart like others; columns of any name are written as they are; an empty table
gives an empty layout.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.llm import common

#: Slices of the hash range in all; with the cuts of heavy slices there are at most twice as many blocks.
SLICES = 16_384
#: Text bytes of a file of a shard.
FILE_BYTES = 32 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """The cheapest way to send every unit of supply to the demands, whose sum must not be smaller.

    Successive shortest paths with potentials on the bipartite graph of the
    shards; each round saturates a supply, a demand or an edge that is undone.
    """
    if sum(supply) > sum(demand):
        raise ValueError("the capacities are smaller than the data")
    n, m = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(demand)
    price = [0] * (n + m)
    while any(left):
        dist = [0 if i < n and left[i] else None for i in range(n + m)]
        back: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        final = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in final:
                continue
            final.add(u)
            if u < n:
                edges = ((n + j, cost(u, j)) for j in range(m))
            else:
                edges = ((i, -cost(i, u - n)) for i in range(n) if flow[i, u - n] > 0)
            for v, c in edges:
                if v not in final and (dist[v] is None or d + c + price[u] - price[v] < dist[v]):
                    dist[v] = d + c + price[u] - price[v]
                    back[v] = u
                    heapq.heappush(heap, (dist[v], v))
        end = min((n + j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda v: dist[v] + price[v])
        for v in range(n + m):
            if dist[v] is not None:
                price[v] += min(dist[v], dist[end])
            else:
                price[v] += dist[end]
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:], strict=False):
            if u >= n:
                amount = min(amount, flow[v, u - n])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def assign_blocks(blocks: list[tuple[int, int]], capacities: list[int]) -> list[int]:
    """The new shard of each block, given as (old shard, bytes): blocks follow the flow, large ones first.

    What the flow leaves open because blocks are whole goes to the shard with
    the most room, so shards end within a block of their capacity; a last pass
    moves or swaps small blocks while that brings two shards nearer to theirs.
    """
    n_old = max((s for s, _ in blocks), default=-1) + 1
    supply = [0] * n_old
    for s, size in blocks:
        supply[s] += size
    flow = min_cost_flow(supply, capacities, lambda i, j: 0 if i == j else 1)
    room = {k: v for k, v in flow.items()}
    free = list(capacities)
    out = [-1] * len(blocks)
    targets = defaultdict(list)
    for i, j in flow:
        targets[i].append(j)
    late = []
    for b in sorted(range(len(blocks)), key=lambda b: (-blocks[b][1], b)):
        old, size = blocks[b]
        # a block stays if it can; else it goes where the flow has most left
        js = [j for j in targets[old] if room[old, j] >= size]
        if js:
            j = old if old in js else max(js, key=lambda j: (room[old, j], -j))
            out[b] = j
            room[old, j] -= size
            free[j] -= size
        else:
            late.append(b)
    for b in late:
        old, size = blocks[b]
        j = max(range(len(capacities)), key=lambda j: (free[j], j == old, -j))
        out[b] = j
        free[j] -= size
    _level(blocks, out, free)
    return out


def _level(blocks: list[tuple[int, int]], out: list[int], free: list[int]) -> None:
    """Move blocks from the fullest shard to the emptiest while their difference shrinks."""
    held = defaultdict(list)
    for b, j in enumerate(out):
        held[j].append(b)
    for _ in range(2000):
        low = min(range(len(free)), key=lambda j: (free[j], j))
        high = max(range(len(free)), key=lambda j: (free[j], -j))
        gap = free[high] - free[low]
        if gap <= 1:
            return
        fits = [b for b in held[low] if 0 < blocks[b][1] < gap]
        if not fits:
            return
        b = min(fits, key=lambda b: (abs(2 * blocks[b][1] - gap), b))
        held[low].remove(b)
        held[high].append(b)
        out[b] = high
        free[low] += blocks[b][1]
        free[high] -= blocks[b][1]


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slice_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SLICES)).cast("int")


def old_layout(docs: DataFrame, n_old: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows as a layout by text hash would hold them: (doc_id, size, text_crc32, old_shard, slice, fine, row).

    ``row`` holds all columns. ``fine`` cuts heavy slices; it differs for rows
    that repeat in full, and holds for this frame's kept rows only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fine = F.pmod(F.xxhash64(F.col(id_col), F.lit(5), F.monotonically_increasing_id()), F.lit(SLICES)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_bytes(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slice_of(text).alias("slice"), fine.alias("fine"), F.struct(*docs.columns).alias("row"))
    return rows.withColumn("old_shard", F.col("slice") % n_old)


def plan(layout: DataFrame, n_old: int, capacities_of) -> tuple[DataFrame, DataFrame]:
    """The rows with their block, and (slice, part, old_shard, new_shard, offset): where each block goes.

    ``capacities_of`` gives the new shards' capacities from the total of bytes.
    """
    rows = common.written(layout, "layout")
    sums = rows.groupBy("slice").agg(F.sum("size").alias("bytes")).collect()  # at most SLICES rows
    total = sum(r.bytes for r in sums)
    capacities = capacities_of(total)
    # a slice is cut so that no part holds much more than the mean of all slices
    mean = max(1, total // SLICES)
    cuts = {r.slice: min(-(-r.bytes // (2 * mean)), SLICES) for r in sums if r.bytes > 2 * mean}
    spark = layout.sparkSession
    cut_rows = spark.createDataFrame([(k, int(v)) for k, v in cuts.items()], "slice int, cuts int")
    rows = rows.join(F.broadcast(cut_rows), "slice", "left").withColumn("part", F.coalesce(F.col("fine") % F.col("cuts"), F.lit(0)).cast("int")).drop("cuts", "fine")
    blocks = rows.groupBy("slice", "part", "old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most 2 * SLICES rows
    blocks.sort(key=lambda r: (r.slice, r.part))
    new = assign_blocks([(r.old_shard, r.bytes) for r in blocks], capacities)
    filled = [0] * len(capacities)
    placed = []
    for r, j in zip(blocks, new, strict=True):
        placed.append((r.slice, r.part, r.old_shard, j, filled[j], r.bytes))
        filled[j] += r.n
    return rows, spark.createDataFrame(placed, "slice int, part int, old_shard int, shard int, offset long, bytes long")


def reshard(docs: DataFrame, *, n_old: int = 12, n_new: int = 16, **cols: str) -> tuple[DataFrame, DataFrame]:
    """All rows in ``n_new`` shards of equal bytes, and the plan of block transfers behind it.

    Rows: doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in each
    shard), file (in its shard) and row. They are kept on shared storage with
    their columns, so that what is planned is what is written.
    """
    common.use_checkpoints(docs.sparkSession)
    rows, moves = plan(old_layout(docs, n_old, **cols), n_old, lambda total: [total // n_new + (j < total % n_new) for j in range(n_new)])
    total = moves.agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-total // (n_new * FILE_BYTES)))
    placed = rows.join(F.broadcast(moves.select("slice", "part", "shard", "offset")), ["slice", "part"]).withColumn("file", (F.col("slice") % files).cast("int"))
    # blocks lie together by file, so that numbering and writing need one exchange
    within = Window.partitionBy("shard", "file", "slice", "part").orderBy("text_crc32", "doc_id", "size", F.xxhash64("row"))
    placed = placed.repartition("shard", "file").withColumn("r", F.row_number().over(within))
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("offset") + F.col("r") - 1).alias("slot"), "file", "row"), moves


def transfers(moves: DataFrame) -> DataFrame:
    """(old_shard, shard, blocks, bytes) of what changes its shard."""
    return moves.filter("old_shard <> shard").groupBy("old_shard", "shard").agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"))


def moved_bytes(moves: DataFrame) -> tuple[int, int]:
    """How many bytes change their shard, and how many must, whatever the plan: what exceeds a shard's new size."""
    sums = moves.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()  # a row a shard
    new = {r.shard: r.b for r in moves.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    moved = moves.filter("old_shard <> shard").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return int(moved), sum(max(0, r.b - new.get(r.old_shard, 0)) for r in sums)


def affected(moves: DataFrame) -> list[int]:
    """The shards that give or get blocks."""
    changed = moves.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    return sorted(r.shard for r in changed.collect())  # at most as many as there are shards


def rewrite(placed: DataFrame, moves: DataFrame, path: str) -> tuple[list[int], str, str]:
    """Write the files of the affected shards, a folder a shard, rows in order of their slots.

    Returns the shards' numbers and the names of the columns that hold shard and
    slot, which begin with underscores where the rows have such columns.
    """
    numbers = affected(moves)
    held = placed.select("row.*")
    shard, slot = common.spare(held, "shard", "slot")
    rows = placed.filter(F.col("shard").isin(numbers)).select(F.col("shard").alias(shard), F.col("file").alias("file"), F.col("slot").alias(slot), F.col("row"))
    rows = rows.sortWithinPartitions(shard, "file", slot).select("row.*", slot, shard)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(shard).parquet(path)
    return numbers, shard, slot


def rewritten(docs: DataFrame, path: str, *, n_old: int = 12, n_new: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reshard, write the affected files under ``path``, and read the new layout back: (doc_id, size, text_crc32, old_shard, shard, slot).

    Rows of shards that keep their files are taken as they are placed.
    """
    placed, moves = reshard(docs, n_old=n_old, n_new=n_new, id_col=id_col, text_col=text_col)
    numbers, shard, slot = rewrite(placed, moves, path)
    kept = placed.filter(~F.col("shard").isin(numbers)).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")
    if not numbers:
        return kept
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.sparkSession.read.parquet(path)
    read = rows.select(F.col(id_col).cast("long").alias("doc_id"), row_bytes(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), (slice_of(text) % n_old).alias("old_shard"), F.col(shard).cast("int").alias("shard"), F.col(slot).alias("slot"))
    return read.unionByName(kept)


def digest(placed: DataFrame) -> DataFrame:
    """The columns that op2 returns."""
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
