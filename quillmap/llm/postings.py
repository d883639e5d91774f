"""Approximate nearest neighbours in balanced posting lists.

Centroids are the leaves of a tree that halves a bounded sample until a leaf is
small. A vector goes to the list of its nearest centroid and, if it lies near
a boundary, to those of further centroids within a ratio of that distance.
Centroids are found by a beam search over a neighbour graph kept in memory. A
query reads the lists whose centroid is within a ratio of its nearest one. That
ratio is measured: it is the one at which the nearest vectors of sampled queries
lie in lists that are read, with the wanted share. Vectors in clusters need few
lists so; vectors without structure need many, whatever the index. All vectors of
those lists are compared in double precision, the nearest lists first: from the
others only what is nearer than a query's k-th so far is handed on.

Lists grow with the root of the table up to ``lists``, which bounds the graph and
what the driver fits. Lists longer than a block are split, and a query meets each
block of its lists.

Cases: rows with a null id, or a vector that is null, zero, of unusual length or
not finite, take no part; repeated ids count once in a result and never answer
their own query; an empty table gives an empty result; with fewer than ``k``
candidates a query gets all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm import common, vectors


@dataclass(frozen=True)
class Settings:
    """``lists`` and ``per_list`` bound what the driver fits: at most their product of vectors, ``sample`` at least."""

    sample: int = 20_000
    per_list: int = 16
    lists: int = 8192
    list_size: int = 128
    growth: float = 4.0
    replicas: int = 2
    replica_ratio: float = 1.08
    #: Share of the nearest that sampled queries must find, and how many queries tell.
    wanted: float = 0.93
    trials: int = 400
    #: Lists that a query reads whatever their ratio, and before all others.
    least_lists: int = 8
    degree: int = 20
    beam: int = 12
    block: int = 2048

    def lists_of(self, n: int) -> int:
        return max(1, min(self.lists, -(-n // self.list_size), math.ceil(self.growth * math.sqrt(n))))

    def sample_of(self, n: int) -> int:
        return max(self.sample, self.per_list * self.lists_of(n))


def leaves(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of the parts of ``x`` after halving it until parts have at most ``size`` rows."""
    if len(x) <= size:
        return [x.mean(0)]
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = x @ (a - b)
        order = np.argsort(side, kind="stable")
        half = len(x) // 2
        b, a = x[order[:half]].mean(0), x[order[half:]].mean(0)
    return leaves(x[order[:half]], size, rng) + leaves(x[order[half:]], size, rng)


@dataclass
class Index:
    """Centroids and, for each, its nearest others and a few far ones."""

    centroids: np.ndarray
    graph: np.ndarray
    start: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n: int, s: Settings) -> Index:
        rng = np.random.default_rng(5)
        wanted = s.lists_of(n)
        c = np.unique(np.stack(leaves(x, max(1, -(-len(x) // wanted)), rng)), axis=0)
        k = len(c)
        degree, near = min(s.degree, max(1, k - 1)), []
        for start in range(0, k, 512):
            d = distances(c[start : start + 512], c)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            near.append(np.argsort(d, axis=1)[:, :degree])
        far = rng.integers(0, k, (k, 4))
        return cls(c, np.concatenate([np.concatenate(near), far], axis=1), np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int)))

    def measured(self, x: np.ndarray, k: int, s: Settings) -> tuple[float, int]:
        """The ratio by which sampled queries find their nearest of the sample, and how many lists that is at most."""
        rng = np.random.default_rng(6)
        q = x[rng.choice(len(x), min(s.trials, len(x)), replace=False)]
        needed, within = [], []
        for start in range(0, len(q), 64):
            part = q[start : start + 64]
            d, to = distances(part, x), distances(part, self.centroids)
            least = np.maximum(to.min(1), 1e-12)
            # its own row, and what equals it, is no neighbour
            d[d <= 1e-9] = np.inf
            for i in range(len(part)):
                near = np.argsort(d[i])[:k]
                near = near[np.isfinite(d[i][near])]
                rows, lists, _ = self.lists_of(x[near], s.replicas, s.replica_ratio, s.beam)
                best = np.full(len(near), np.inf)
                np.minimum.at(best, rows, to[i][lists] / least[i])
                needed.append(best)
            within.append(to / least[:, None])
        needed = np.concatenate([np.ones(1), *needed])
        ratio = float(np.quantile(needed[np.isfinite(needed)], s.wanted)) + 1e-9
        counts = (np.concatenate(within) <= ratio).sum(1)
        return ratio, int(min(len(self.centroids), max(8, math.ceil(1.25 * counts.max()))))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each query that the walk meets, nearest first, and their distances."""
        n, k = len(q), len(self.centroids)
        width, q = min(beam, k), q.astype(np.float32)
        centroids, steps = self.centroids.astype(np.float32), min(max(4, width // 16), width)
        c_sq, q_sq = (centroids**2).sum(1), (q**2).sum(1)[:, None]
        seen = np.zeros((n, k), bool)
        ids = np.full((n, width), -1)
        dist = np.full((n, width), np.inf)
        open_ = np.zeros((n, width), bool)
        new = np.broadcast_to(self.start, (n, len(self.start)))
        row = np.arange(n)[:, None]
        while True:
            fresh = ~seen[row, new]
            # a node named twice in a row counts once
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~again
            seen[np.broadcast_to(row, new.shape)[fresh], new[fresh]] = True
            d = np.where(fresh, np.sqrt(np.maximum(0, q_sq + c_sq[new] - 2 * np.einsum("nd,nkd->nk", q, centroids[new]))), np.inf)
            all_d, all_i, all_o = np.concatenate([dist, d], 1), np.concatenate([ids, new], 1), np.concatenate([open_, fresh], 1)
            pick = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist, ids, open_ = (np.take_along_axis(a, pick, 1) for a in (all_d, all_i, all_o))
            open_ &= np.isfinite(dist)
            todo = open_.any(1)
            if not todo.any():
                return ids, dist
            # the nearest nodes not looked at; rows with none left look at known ones again, which changes nothing
            at = np.argsort(~open_, axis=1, kind="stable")[:, :steps]
            np.put_along_axis(open_, at, False, 1)
            new = self.graph[np.maximum(np.take_along_axis(ids, at, 1), 0)].reshape(n, -1)

    def lists_of(self, q: np.ndarray, most: int, ratio: float, beam: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, place) of a row's nearest centroids within ``ratio`` of the nearest; the nearest has place 0."""
        rows, lists, places = [], [], []
        for start in range(0, len(q), 512):
            ids, dist = self.search(q[start : start + 512], beam)
            near = dist[:, :most] <= ratio * dist[:, :1] + 1e-12
            near[:, :least] = True
            near &= np.isfinite(dist[:, :most])
            r, c = np.nonzero(near)
            rows.append(r + start)
            lists.append(ids[r, c])
            places.append(c)
        return tuple(np.concatenate([np.empty(0, int), *x]) for x in (rows, lists, places))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def nearest(lists: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of a block to each query of it that are within the query's bound; an id is as near as its nearest row."""
    ids, v = lists["vec_id"].to_numpy(), vectors.matrix(lists["v"])
    q_ids, q = queries["vec_id"].to_numpy(), vectors.matrix(queries["v"])
    out: list[list[np.ndarray]] = [[], [], []]
    bound = queries["bound"].to_numpy() if len(q_ids) else np.empty(0)
    if len(ids) and len(q_ids):
        part = hash((lists["list"][0].as_py(), lists["sub"][0].as_py())) % vectors.PARTS
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        last = min(k, len(first)) - 1
        for start in range(0, len(q), 256):
            d = distances(q[start : start + 256], v)
            d[q_ids[start : start + 256, None] == ids[None, :]] = np.inf
            by_id = d if len(first) == len(ids) else np.minimum.reduceat(d, first, axis=1)
            least = np.partition(by_id, last, axis=1)[:, last]
            for i, cut in enumerate(np.minimum(least, bound[start : start + 256])):
                # rounding may part equal distances: what is about as near as the last is measured exactly
                near = np.flatnonzero((d[i] <= cut + 1e-6 * (1 + cut if np.isfinite(cut) else 0)) & np.isfinite(d[i]))
                if not len(near):
                    continue
                exact = np.sqrt(((v[near] - q[start + i]) ** 2).sum(1))
                near, exact = near[exact <= bound[start + i]], exact[exact <= bound[start + i]]
                order = np.lexsort((ids[near], exact))
                order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]
                out[0].append(np.full(len(order), q_ids[start + i]))
                out[1].append(ids[near][order])
                out[2].append(exact[order])
    else:
        part = 0
    flat = [np.concatenate([np.empty(0, t), *o]) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
    return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2], "part": np.full(len(flat[0]), part, np.int64)})


def search(rows: DataFrame, *, every: int = 100, k: int = 10, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to each row whose id is divisible by ``every``."""
    s, spark = settings, rows.sparkSession
    common.use_checkpoints(spark)
    points = vectors.clean(rows, id_col=id_col, vector_col=vector_col, zero=False)
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.sample(points, s.sample_of(n))
    index = Index.fit(sample, n, s)
    ratio, probes = index.measured(sample, k, s)
    shared = spark.sparkContext.broadcast(index)  # at most ``lists`` centroids

    def dealt(most: int, ratio: float, beam: int, least: int = 1):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r, lists, places = shared.value.lists_of(vectors.matrix(batch.column(1)), most, ratio, beam, least)
                columns = [batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(lists.astype(np.int32)), pa.array(places.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "list", "place"])

        return work

    schema = "vec_id long, v array<double>, list int, place int"
    listed = points.mapInArrow(dealt(s.replicas, s.replica_ratio, s.beam), schema).drop("place")
    asked = points.filter(F.col("vec_id") % every == 0).mapInArrow(dealt(probes, ratio, probes + 16, s.least_lists), schema)
    subs = {r.list: -(-r["count"] // s.block) for r in listed.groupBy("list").count().collect()}  # at most ``lists`` rows
    sizes = F.broadcast(spark.createDataFrame(list(subs.items()), "list int, subs int"))
    listed = listed.join(sizes, "list").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).drop("subs")

    def met(queries: DataFrame) -> DataFrame:
        each = queries.join(sizes, "list").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
        return listed.groupBy("list", "sub").cogroup(each.groupBy("list", "sub")).applyInArrow(lambda a, b: nearest(a, b, k), "query_id long, vec_id long, score double, part long")

    # the nearest lists give each query a bound, under which the others have little to add
    nowhere = F.lit(float("inf"))
    asked = asked.checkpoint()
    first = vectors.best(met(asked.filter(F.col("place") < s.least_lists).withColumn("bound", nowhere)), k, largest=False).checkpoint()
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    later = asked.filter(F.col("place") >= s.least_lists).join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", nowhere))
    both = met(later).unionByName(first.drop("rank").withColumn("part", F.lit(0).cast("long")))
    best = vectors.best(both, k, largest=False).checkpoint()
    # queries whose lists hold too few read all of them
    full = best.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = points.filter(F.col("vec_id") % every == 0).select("vec_id", "v").join(full, "vec_id", "left_anti").checkpoint()
    if short.isEmpty():
        return best
    rest = vectors.best(met(short.withColumn("bound", nowhere).withColumn("list", F.explode(F.array(*map(F.lit, sorted(subs)))))), k, largest=False)
    return best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
