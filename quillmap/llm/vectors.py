"""What the vector searches share: clean rows, arrays, and the merge of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Partial results of a query are merged in so many parts first.
PARTS = 32


def clean(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a finite vector of the table's usual length; all-zero ones only if ``zero``."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    picked = picked.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if not zero:
        picked = picked.filter(F.exists("v", lambda x: x != 0))
    usual = picked.filter(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return picked.filter(F.size("v") == (usual.d if usual else -1))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def sample(rows: DataFrame, limit: int) -> np.ndarray:
    """At most ``limit`` vectors, those of the smallest hashed ids."""
    found = rows.withColumn("at", F.xxhash64(F.lit(3), "vec_id")).orderBy("at", "vec_id").limit(limit).select("v").toArrow()
    return matrix(found["v"])


def best(found: DataFrame, k: int, *, largest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query_id, vec_id, score, part): equal ids of a query count once."""
    score = F.col("score").desc() if largest else F.col("score")
    # top_k is no sum: parts of a query are cut first, so that none has more than a part's share of rows
    for keys in (["query_id", "part"], ["query_id"]):
        once = found.groupBy(*keys, "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
        found = once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score, "vec_id"))).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
