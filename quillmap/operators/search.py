"""Retrieval arms, their fusion, and the filters around them.

Rows are chunks: id, path, language, label, content, owner. An arm is a frame of
(id, owner, score).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.functions import text

#: The fusion constants within a pass and across passes.
ARM_K, PASS_K = 100, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(rows: DataFrame, query: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """The rows with their cosine to the one vector of ``query``, which is broadcast: it is a single row."""
    one = query.select(F.col(vector).alias("query_vector")).limit(1)
    scored = rows.crossJoin(F.broadcast(one))
    norm = lambda v: F.sqrt(dot(v, v))
    return scored.withColumn("score", dot(F.col(vector), F.col("query_vector")) / (norm(F.col(vector)) * norm(F.col("query_vector")))).drop("query_vector")


def top(rows: DataFrame, k: int) -> DataFrame:
    """Highest scores, ties to the smaller id."""
    return rows.orderBy(F.desc("score"), "id").limit(k)


def ranked_arm(arm: DataFrame) -> DataFrame:
    """The arm's best chunk of each owner, ranked without gaps."""
    first = Window.partitionBy("owner").orderBy(F.desc("score"), "id")
    best = arm.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "owner", "rank")


def fuse(arms: list[DataFrame], k: int = ARM_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of arms, each already cut to its top."""
    out = None
    for arm in arms:
        part = ranked_arm(arm)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def fuse_passes(passes: list[tuple[DataFrame, float]], k: int = PASS_K) -> DataFrame:
    """(id, score, passes): weighted fusion of passes of (id, rank)."""
    out = None
    for i, (rows, weight) in enumerate(passes):
        part = rows.select("id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"), F.lit(i).alias("pass"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("score"), F.countDistinct("pass").alias("passes"))


def conflicts(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Ids that carry more than one payload, and empty ids."""
    return rows.groupBy("id").agg(F.countDistinct(F.struct(*payload)).alias("payloads")).filter((F.col("payloads") > 1) | (F.col("id").cast("string") == ""))


def must(fields: list[str], tokens: list[str]) -> Column:
    """Every token stands, case and all, in one of the fields."""
    out = F.lit(True)
    for t in tokens:
        held = F.lit(False)
        for f in fields:
            held = held | F.coalesce(F.col(f).contains(t), F.lit(False))
        out = out & held
    return out


def exclude(fields: list[str], tokens: list[str]) -> Column:
    out = F.lit(True)
    for t in tokens:
        out = out & ~must(fields, [t])
    return out


def compile_filter(node: dict, *, depth: int = 0, budget: list[int] | None = None) -> Column:
    """A filter tree of ``eq``, ``ne``, ``in`` and ``and`` nodes as a column; at most 16 deep and 256 nodes."""
    budget = budget if budget is not None else [256]
    budget[0] -= 1
    if depth >= 16 or budget[0] < 0:
        raise ValueError("the filter is too deep or too large")
    kind = node.get("type")
    if kind == "and":
        if not node.get("filters"):
            raise ValueError("an empty filter")
        out = F.lit(True)
        for child in node["filters"]:
            out = out & compile_filter(child, depth=depth + 1, budget=budget)
        return out
    if node.get("field") not in ("id", "path", "extension"):
        raise ValueError(f"no filter on {node.get('field')}")
    column = F.col(node["field"])
    if kind == "in":
        if not node.get("values"):
            raise ValueError("an empty filter")
        return column.isin(*node["values"])
    if kind == "comparison" and node.get("op") in ("eq", "ne"):
        return column == node["value"] if node["op"] == "eq" else column != node["value"]
    raise ValueError(f"unknown filter {kind}")


def first_removal(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that a row fails, null if it passes all."""
    out = F.lit(None).cast("string")
    for name, passed in reversed(checks):
        out = F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)).otherwise(out)
    return out


#: Files of a lexical scan at most, and what a phrase and a term in a line are worth.
SCAN_FILES, PHRASE_WORTH, TERM_WORTH = 128, 10_000, 100


def line_windows(rows: DataFrame, terms: list[str], *, around: int = 2) -> DataFrame:
    """The first line of each row that holds a term, with the lines around it."""
    lines = F.split(F.col("content"), "\n")
    pattern = "|".join(re.escape(t) for t in terms)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(f"(?i){pattern}")), F.lit(True))
    return _window(rows.withColumn("lines_", lines).withColumn("line", at.cast("int")).filter("line > 0"), around)


def _window(found: DataFrame, around: int) -> DataFrame:
    begin = F.greatest(F.col("line") - around, F.lit(1))
    end = F.least(F.col("line") + around, F.size("lines_"))
    return found.withColumn("start_line", begin).withColumn("end_line", end).withColumn("window", F.array_join(F.slice("lines_", begin, end - begin + 1), "\n")).drop("lines_")


def best_lines(rows: DataFrame, terms: list[str], *, phrase: str | None = None, around: int = 2) -> DataFrame:
    """The line of each row with the most evidence, the first of equal ones: (line, evidence, exact, window and its ends).

    Rows without evidence are left out. ``scan_order`` orders the rest.
    """

    def worth(line: Column) -> Column:
        out = F.when(F.instr(F.lower(line), phrase) > 0, PHRASE_WORTH).otherwise(0) if phrase else F.lit(0)
        for t in terms:
            out = out + F.when(text.has_term(line, t), TERM_WORTH).otherwise(0)
        return out

    lines = rows.withColumn("lines_", F.split(F.col("content"), "\n"))
    scored = lines.withColumn("worth_", F.transform("lines_", worth)).withColumn("evidence", F.array_max("worth_"))
    found = scored.filter("evidence > 0").withColumn("line", F.array_position("worth_", F.col("evidence")).cast("int")).drop("worth_")
    exact = F.instr(F.lower("content"), phrase) > 0 if phrase else F.lit(False)
    return _window(found.withColumn("exact", exact), around)


def scan_order() -> list[Column]:
    return [F.desc("exact"), F.desc("evidence"), F.asc("line"), F.asc("path")]


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Sum over the query's vectors of the largest inner product with the document's."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)


def max_sim_groups(rows: DataFrame, tokens: DataFrame, group: str, *, vector: str = "embedding") -> DataFrame:
    """(group, score) where a document is the group of its vectors, one a row.

    ``tokens`` holds the vectors of one query's tokens; they go to all tasks as
    one row. Each row gives its products, of which the largest by token and group
    are summed, so that no group is ever one array.
    """
    query = tokens.agg(F.collect_list(vector).alias("query_"))
    each = rows.crossJoin(F.broadcast(query)).select(group, F.posexplode(F.transform("query_", lambda q: dot(q, F.col(vector)))).alias("token_", "product_"))
    best = each.groupBy(group, "token_").agg(F.max("product_").alias("best_"))
    return best.groupBy(group).agg(F.sum("best_").alias("score"))
