"""Exact top-k inner products of integer vectors, longest vectors first.

Components become ``floor(scale * x)``. Vectors lie in bands of descending
length, and bands in blocks. The longest vectors give each query a score that
its k-th best cannot be under; a band whose length times the query's cannot
reach it is not read. Bands are worked off in rounds, the longest first, and each
round hands the k-th best scores that it found on to the next, where fewer
queries and shorter vectors are left to meet. Within a block, the first coordinates after an SVD
rotation give a partial sum, and Cauchy-Schwarz on the rest an upper bound;
only vectors whose bound reaches the query's k-th best so far are scored, and
that exactly, in integers.

The rotation is fitted on a bounded sample; a poor one costs time, not results.

Cases: rows with a null id, or a vector that is null, of unusual length or not
finite, take no part; zero vectors do; repeated ids count once in a result and
never answer their own query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm import common, vectors

SAMPLE, LEADERS, BANDS = 20_000, 2048, 64
#: Bands that are done after each round.
ROUNDS = (4, 20, BANDS)
#: Vectors and queries that meet in one task; vectors that are bounded at once.
BLOCK, QUERIES, CHUNK = 4096, 4096, 512
#: Shares of the coordinates after which the bound is tried.
STAGES = (0.25, 0.5)


def rotation(x: np.ndarray) -> np.ndarray:
    """Orthogonal, the directions of most weight first."""
    return np.linalg.svd(x.T @ x)[0]


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if (np.abs(q).max(initial=0) * np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 2.0**52:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def kth(found: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or a value under all if there are fewer."""
    if found.shape[1] < k:
        return np.full(len(found), -(2.0**62))
    return np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k].astype(np.float64)


def scan(vecs: pa.Table, queries: pa.Table, turn: np.ndarray, k: int, part: int) -> pa.Table:
    """The k best ids of a block for each query, as far as they may be among its k best at all."""
    out: list[list[np.ndarray]] = [[], [], []]
    ids, q_ids = vecs["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    if len(ids) and len(q_ids):
        v, q = vectors.matrix(vecs["v"]), vectors.matrix(queries["v"])
        order = np.argsort(-np.einsum("ij,ij->i", v, v), kind="stable")
        ids, v = ids[order], v[order]
        rv, rq = v @ turn, q @ turn
        least = queries["least"].to_numpy().astype(np.float64)
        # rounding of the bounds stays far under this
        slack = 1e-9 * (1 + np.sqrt((q * q).sum(1).max()) * np.sqrt((v * v).sum(1).max()))
        cuts = [max(1, int(s * v.shape[1])) for s in STAGES]
        rest_v = [np.sqrt((rv[:, c:] ** 2).sum(1)) for c in [0, *cuts]]
        rest_q = [np.sqrt((rq[:, c:] ** 2).sum(1)) for c in [0, *cuts]]
        vi, qi = v.astype(np.int64), q.astype(np.int64)
        kept_q, kept_v, kept_s = np.empty(0, int), np.empty(0, int), np.empty(0, np.int64)
        repeated = len(np.unique(ids)) < len(ids)
        for start in range(0, len(v), CHUNK):
            stop = min(start + CHUNK, len(v))
            live = np.flatnonzero(rest_q[0] * rest_v[0][start] + slack >= least)
            if not len(live):
                continue
            may = np.ones((len(live), stop - start), bool)
            for c, a, b in zip(cuts, rest_q[1:], rest_v[1:], strict=True):
                bound = rq[live, :c] @ rv[start:stop, :c].T + a[live, None] * b[None, start:stop]
                may &= bound + slack >= least[live, None]
                if not may.any():
                    break
            may &= q_ids[live, None] != ids[None, start:stop]
            i, j = np.nonzero(may)
            if not len(i):
                continue
            if len(i) * 8 > may.size:
                s = scores(qi[live], vi[start:stop])[i, j]
            else:
                s = np.einsum("ij,ij->i", qi[live[i]], vi[start + j])
            kept_q, kept_v, kept_s = np.r_[kept_q, live[i]], np.r_[kept_v, start + j], np.r_[kept_s, s]
            if repeated:
                # an id has one place, that of its best row
                order = np.lexsort((-kept_s, ids[kept_v], kept_q))
                kept_q, kept_v, kept_s = kept_q[order], kept_v[order], kept_s[order]
                once = np.r_[True, (kept_q[1:] != kept_q[:-1]) | (ids[kept_v[1:]] != ids[kept_v[:-1]])]
                kept_q, kept_v, kept_s = kept_q[once], kept_v[once], kept_s[once]
            order = np.lexsort((ids[kept_v], -kept_s, kept_q))
            kept_q, kept_v, kept_s = kept_q[order], kept_v[order], kept_s[order]
            first = np.flatnonzero(np.r_[True, kept_q[1:] != kept_q[:-1]])
            rank = np.arange(len(kept_q)) - np.repeat(first, np.diff(np.r_[first, len(kept_q)]))
            kept = rank < k
            kept_q, kept_v, kept_s, rank = kept_q[kept], kept_v[kept], kept_s[kept], rank[kept]
            last = rank == k - 1
            least[kept_q[last]] = np.maximum(least[kept_q[last]], kept_s[last])
        out = [[q_ids[kept_q]], [ids[kept_v]], [kept_s]]
    flat = [np.concatenate([np.empty(0, np.int64), *o]).astype(np.int64) for o in out]
    return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2], "part": np.full(len(flat[0]), part, np.int64)})


def top(rows: DataFrame, *, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    common.use_checkpoints(spark)
    points = vectors.clean(rows, id_col=id_col, vector_col=vector_col).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    points = points.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    n, n_queries = points.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(vectors.sample(points, SAMPLE))
    lead = points.orderBy(F.desc("length"), "vec_id").limit(LEADERS).select("vec_id", "v").toArrow()
    leaders = spark.sparkContext.broadcast((lead["vec_id"].to_numpy(), vectors.matrix(lead["v"]).astype(np.int64)))  # at most LEADERS vectors

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = leaders.value
        distinct = np.unique(ids, return_index=True)[1]
        ids, v = ids[distinct], v[distinct]
        for batch in batches:
            q_ids = batch.column(0).to_numpy()
            s = scores(vectors.matrix(batch.column(1)).astype(np.int64), v).astype(np.float64)
            s[q_ids[:, None] == ids[None, :]] = -(2.0**62)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kth(s, k))], names=[*batch.schema.names, "least"])

    asked = points.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "length").mapInArrow(first_bound, "vec_id long, v array<double>, length double, least double")
    edges = sorted(set(points.approxQuantile("length", [i / BANDS for i in range(1, BANDS)], 0.002)), reverse=True)
    band = sum((F.when(F.col("length") < e, 1).otherwise(0) for e in edges), F.lit(0))
    banded = points.withColumn("band", band.cast("int"))
    stats = {r.band: (r.n, r.longest) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}  # at most BANDS rows
    table = F.broadcast(spark.createDataFrame([(b, -(-c // BLOCK), m) for b, (c, m) in stats.items()], "band int, subs int, longest double"))
    asked = asked.checkpoint()
    # queries that need bands of about the same length lie in one set, so that a band meets few sets
    reach = F.col("least") / F.greatest(F.col("length"), F.lit(1e-9))
    sets = max(1, -(-n_queries // QUERIES))
    steps = sorted(set(asked.withColumn("reach", reach).approxQuantile("reach", [i / sets for i in range(1, sets)], 0.01))) if sets > 1 else []
    asked = asked.withColumn("set", F.lit(0) + sum((F.when(reach > e, 1).otherwise(0) for e in steps), F.lit(0)))
    vecs = banded.join(table.select("band", "subs"), "band").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).drop("subs", "length")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        part = (a["band"][0].as_py() * 31 + a["sub"][0].as_py()) % vectors.PARTS if a.num_rows else 0
        return scan(a, b, turn, k, part)

    best, done = None, 0
    for upto in ROUNDS:
        bands = [b for b in stats if done <= b < upto]
        done = upto
        if not bands:
            continue
        now = asked
        if best is not None:
            reached = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
            now = asked.join(reached, "vec_id", "left").withColumn("least", F.greatest("least", F.coalesce("kth", "least"))).drop("kth")
        # a band is read only if its longest vector can reach the query's bound
        near = table.filter(F.col("band").isin(bands))
        now = now.join(F.broadcast(near), F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("least"))
        now = now.select("band", "subs", "set", "vec_id", "v", "least")
        # a band's vectors go to the sets that have a query for them
        live = now.select(F.col("band").alias("band_"), F.col("set").alias("set_")).distinct()
        left = vecs.filter(F.col("band").isin(bands)).join(live, F.col("band") == F.col("band_")).select("band", "sub", F.col("set_").alias("set"), "vec_id", "v")
        right = now.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
        found = left.groupBy("band", "sub", "set").cogroup(right.groupBy("band", "sub", "set")).applyInArrow(work, "query_id long, vec_id long, score long, part long")
        if best is not None:
            found = found.unionByName(best.drop("rank").withColumn("part", F.lit(0).cast("long")))
        best = vectors.best(found, k, largest=True)
        if done < ROUNDS[-1]:
            best = best.checkpoint()
    return best


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
