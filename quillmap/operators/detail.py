"""Guards, projections, owner repair, capability evidence and rerank documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.functions import paths, source, text
from quillmap.sources.store import use_checkpoints

#: Confidence of a call to the nearest target in its own file and elsewhere.
SAME_FILE, OTHER_FILE = 0.92, 0.78
#: Bytes of a rerank document; callers, callees and tests in it at most.
RERANK_BYTES, CONTEXT_CAPS = 4000, {"direct_callers": 3, "direct_callees": 3, "supporting_tests": 2}
#: Fixed value: chunks of changed files in an answer at most.
OVERLAY_RESULTS = 16
#: Evidence labels of results, the strongest first.
EVIDENCE = ("high_owner_confidence", "medium_owner_confidence", "high_semantic_confidence", "medium_semantic_confidence", "ranked_candidate")
#: What became of the lane of ``must:`` terms.
MUST_STATUS = {
    "unsupported": "lane_unavailable",
    "failed": "lane_failed",
    "budget": "partial_candidate_budget",
    "completed": "lane_completed_within_backend_results",
}
#: Names that too many things have for an import to say which is meant.
GENERIC_NAMES = (
    "push pop shift unshift get set has add delete clear map filter find findindex foreach reduce sort includes "
    "indexof slice splice concat join split keys values entries next then catch finally apply call bind tostring valueof "
    "size length update create remove insert write read close open start stop run init load save parse format error"
).split()
#: Breadcrumbs of a result at most.
BREADCRUMBS = 2


def sound(rows: DataFrame, *, score: str = "score", key: str = "id") -> DataFrame:
    """The rows, or an error at the first whose score is not finite or whose id is empty."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")) | F.col(key).isNull() | (F.col(key).cast("string") == "")
    return rows.filter(F.when(bad, F.raise_error(F.lit("a candidate without a finite score or an id"))).otherwise(F.lit(True)))


def valid_spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose span is one, and the ids of the others."""
    ok = F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False))
    return rows.filter(ok), rows.filter(~ok).select("id")


def symbol_filter(*, lang: list[str] = (), must: list[str] = (), exclude: list[str] = ()) -> Column:
    """Operators over symbols: label, path, name, qualified name and parents."""
    out = F.lit(True)
    if lang:
        out = out & F.lower("language").isin(*lang)

    def held(token: str) -> Column:
        hit = F.exists("parents", lambda p: p.contains(token))
        for f in ("label", "path", "name", "qualified_name"):
            hit = hit | F.coalesce(F.col(f).contains(token), F.lit(False))
        return F.coalesce(hit, F.lit(False))

    for t in must:
        out = out & held(t)
    for t in exclude:
        out = out & ~held(t)
    return out


def result_row(rows: DataFrame, now: Column) -> DataFrame:
    """Candidates as results: trimmed breadcrumbs, the first two of them, a staleness bucket and a preview."""
    crumbs = F.slice(F.filter(F.transform("breadcrumbs", lambda b: F.trim(b)), lambda b: b != ""), 1, BREADCRUMBS)
    return rows.select("id", "path", "start_line", "end_line", "language", "score", crumbs.alias("breadcrumbs"), text.staleness(F.col("indexed_at"), now).alias("staleness"), utf8_cut(F.col("content"), 200).alias("preview"))


def utf8_cut(value: Column, size: int) -> Column:
    """The longest beginning of at most ``size`` bytes that ends with a whole character."""
    raw = value.cast("binary")
    out = F.lit("")
    for cut in range(4, -1, -1):
        head = F.substring(raw, 1, size - cut).cast("string")
        out = F.when(F.is_valid_utf8(head), head).otherwise(out)
    return F.when(F.octet_length(value) <= size, value).otherwise(out)


def repaired_owner(hits: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(id, owner, source): the stored owner where its span holds the hit, else the overlapping symbol whose name has most of the terms."""
    s = symbols.select(F.col("file").alias("file_"), "s", "e", "name", "symbol_key")
    kept = hits.join(s, (F.col("owner") == F.col("symbol_key")) & (F.col("file") == F.col("file_")) & (F.col("s") <= F.col("start_line")) & (F.col("end_line") <= F.col("e")), "left_semi")
    lost = hits.join(kept.select("id"), "id", "left_anti")
    score = F.lit(0)
    for t in terms:
        score = score + F.lower("name").contains(t).cast("int")
    pairs = lost.join(s, (F.col("file") == F.col("file_")) & (F.col("s") <= F.col("end_line")) & (F.col("e") >= F.col("start_line")))
    order = F.struct((-score).alias("a"), (F.col("e") - F.col("s")).alias("b"), F.col("symbol_key").alias("c"))
    best = pairs.groupBy("id").agg(F.min_by("symbol_key", order).alias("owner"))
    repaired = lost.select("id").join(best, "id", "left").select("id", "owner", F.when(F.col("owner").isNull(), "none").otherwise("registry_repair").alias("source"))
    return kept.select("id", "owner", F.lit("stored").alias("source")).unionByName(repaired)


def reexports(imports: DataFrame, exports: DataFrame, rounds: int = 60) -> DataFrame:
    """(file, target): what a file imports, straight or through files that export it again, however many.

    Each round follows one more export from what the last round found; what is
    known is kept on shared storage, so that a round costs its new rows only.
    """
    use_checkpoints(imports.sparkSession)
    steps = exports.select(F.col("file").alias("target"), F.col("target").alias("next")).distinct()
    reached = frontier = imports.select("file", "target").distinct().checkpoint()
    for _ in range(rounds):
        found = frontier.join(steps, "target").select("file", F.col("next").alias("target")).distinct()
        frontier = found.join(reached, ["file", "target"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier).checkpoint()
    raise RuntimeError("the exports did not settle")


def upgraded_calls(calls: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """Calls (src, dst, file, name, confidence) whose low confidence is raised to medium where the caller's file has the target.

    It has it if its imports (``reached``: file, target) name the target's file
    and the name is the only one of its kind there and not a generic one.
    symbols: symbol_key, name, file, kind.
    """
    named = symbols.filter("kind <> 'file'")
    only = named.groupBy("file", F.lower("name").alias("low_")).agg(F.count("*").alias("n_")).filter("n_ = 1").select(F.col("file").alias("dst_file_"), "low_")
    where = symbols.select(F.col("symbol_key").alias("dst"), F.col("file").alias("dst_file_"))
    support = reached.select("file", F.col("target").alias("dst_file_"), F.lit(True).alias("has_")).distinct()
    rows = calls.join(where, "dst", "left").withColumn("low_", F.lower("name"))
    rows = rows.join(only.withColumn("one_", F.lit(True)), ["dst_file_", "low_"], "left").join(support, ["file", "dst_file_"], "left")
    raised = (F.col("confidence") == "low") & F.col("has_") & F.col("one_") & ~F.col("low_").isin(*GENERIC_NAMES)
    return rows.withColumn("confidence", F.when(raised, "medium").otherwise(F.col("confidence"))).select(*calls.columns)


def capability(files: DataFrame, *, search_only: list[str]) -> DataFrame:
    """Per language: files indexed, with definitions, without, and unavailable; languages that are only searched have no eligible ones."""
    sums = files.groupBy("language").agg(F.count("*").alias("indexed"), F.sum((F.col("status") == "bearing").cast("long")).alias("bearing"), F.sum((F.col("status") == "free").cast("long")).alias("free"), F.sum((F.col("status") == "unavailable").cast("long")).alias("unavailable"))
    only = F.col("language").isin(*search_only)
    zero = lambda c: F.when(only, F.lit(0)).otherwise(F.col(c)).cast("long")
    return sums.select("language", "indexed", zero("bearing").alias("bearing"), zero("free").alias("free"), zero("unavailable").alias("unavailable"), (zero("bearing") + zero("unavailable")).alias("eligible"))


def tier_counts(declarations: DataFrame) -> DataFrame:
    """One row of counts over language declarations (extensions, filenames, parser, claim, calls)."""
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    routed = (F.coalesce(F.size("extensions"), F.lit(0)) > 0) | (F.coalesce(F.size("filenames"), F.lit(0)) > 0)
    return declarations.agg(
        F.count("*").alias("total_declarations"),
        number(routed).alias("recognized_routed"),
        number(F.col("parser") != "none").alias("parser_covered"),
        number(F.col("claim") == "symbol_only").alias("symbol_only"),
        number(F.col("calls") == "production_ready").alias("call_graph"),
    )


def merged_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("parts"))


def legacy_calls(calls: DataFrame, targets: DataFrame, nearest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their confidence, and calls without a target as notes."""
    edges = nearest.select("call", "target", F.when(F.col("same_file"), F.lit(SAME_FILE)).otherwise(F.lit(OTHER_FILE)).alias("confidence"))
    return edges, calls.join(nearest.select("call"), "call", "left_anti").select("call", F.concat(F.lit("unresolved:"), "name").alias("note"))


def evidence(rows: DataFrame) -> DataFrame:
    """Ranked results with the strongest evidence that each has, by the confidence in its owner and then in its meaning."""
    label = F.lit(EVIDENCE[-1])
    tests = [F.col(side) == level for side in ("owner_confidence", "semantic_confidence") for level in ("high", "medium")]
    for name, holds in reversed(list(zip(EVIDENCE, tests, strict=False))):
        label = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(label)
    return rows.select("rank", "id", label.alias("evidence"))


def rerank_json(row: dict, terms: list[str], phrase: str | None = None) -> str:
    """One rerank document: JSON with sorted keys, source within the bytes that the rest leaves, then references while they fit."""
    context: dict[str, list] = {name: [] for name in CONTEXT_CAPS}

    def document(excerpt: str) -> str:
        return json.dumps(
            {
                "candidate_role": row["role"],
                "canonical_symbol_label": row["label"],
                "query_relevant_source_excerpt": excerpt,
                "repository_relative_path": row["path"],
                "signature_or_declaration": row["declaration"],
                "structural_context": context,
                "symbol_kind": row["kind"],
            },
            ensure_ascii=False, separators=(",", ":"), sort_keys=True,
        )

    size = lambda text: len(text.encode())
    if size(document("")) > RERANK_BYTES:
        raise ValueError("names and declaration alone exceed a rerank document")
    content = row["content"] or ""
    lines, excerpt, room = content.split("\n"), "", RERANK_BYTES - size(document(""))
    # escapes need more bytes than the source has: the budget is lowered by what is too much
    while room > 0:
        parts = source.excerpts(content, 1, len(lines), phrase, terms, room)
        excerpt = "\n".join("\n".join(lines[a - 1 : b]) for a, b in parts)
        over = size(document(excerpt)) - RERANK_BYTES
        if over <= 0:
            break
        excerpt, room = "", min(room, size(excerpt)) - max(1, over // 6)
    for name, cap in CONTEXT_CAPS.items():
        held = row.get(name)
        for reference in sorted([] if held is None else held, key=lambda r: (r["path"], r["label"]))[:cap]:
            context[name].append({"label": reference["label"], "path": reference["path"]})
            if size(document(excerpt)) > RERANK_BYTES:
                context[name].pop()
                return document(excerpt)
    return document(excerpt)


def rerank_documents(rows: DataFrame, terms: list[str], phrase: str | None = None) -> DataFrame:
    """(id, document) of at most RERANK_BYTES.

    rows: id, path, role, kind, label, declaration, content, and arrays of
    (path, label) direct_callers, direct_callees and supporting_tests.
    """
    columns = ["id", "path", "role", "kind", "label", "declaration", "content", *CONTEXT_CAPS]

    def work(parts):
        for part in parts:
            made = [rerank_json(r, terms, phrase) for r in part.to_dict("records")]
            yield pd.DataFrame({"id": part["id"], "document": made})

    plain = [F.transform(F.coalesce(c, F.array()), lambda r: F.struct(r["path"].alias("path"), r["label"].alias("label"))).alias(c) for c in CONTEXT_CAPS]
    return rows.select(*columns[:7], *plain).mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, document string")


def survival(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, last_stage, removed_at): how far each candidate came."""
    rows = None
    for i, (name, frame) in enumerate(stages):
        part = frame.select("id", F.lit(i).alias("n"), F.lit(name).alias("name"))
        rows = part if rows is None else rows.unionByName(part)
    names = F.array(*(F.lit(n) for n, _ in stages), F.lit(None).cast("string"))
    last = rows.groupBy("id").agg(F.max("n").alias("n"), F.max_by("name", "n").alias("last_stage"))
    return last.select("id", "last_stage", F.element_at(names, F.col("n") + 2).alias("removed_at"))


def rerank_valid(scores: DataFrame, n: int) -> DataFrame:
    """One row of checks on a reranker's answer for ``n`` candidates: (count_ok, index_ok, unique_ok, finite_ok)."""
    return scores.agg(
        (F.count("*") == n).alias("count_ok"), F.every((F.col("index") >= 0) & (F.col("index") < n)).alias("index_ok"),
        (F.countDistinct("index") == F.count("*")).alias("unique_ok"), F.every(~F.isnan("score") & (F.abs("score") != float("inf"))).alias("finite_ok"),
    )


def rerank_start(exact: list[bool]) -> int | None:
    """From which place on to rerank: none if the only result is exact, past the first if that is exact."""
    if len(exact) <= 1 and all(exact):
        return None
    return 1 if exact and exact[0] else 0


def symbol_order() -> list[Column]:
    return [F.asc("file"), F.asc("start_line"), F.desc("end_line"), F.asc("kind"), F.asc("qualified_name"), F.asc("id")]


def relationship_order() -> list[Column]:
    spans = ("line", "start_byte", "end_byte", "start_column", "end_column")
    return [F.asc("file"), *map(F.asc_nulls_last, spans), F.asc("src"), F.asc("dst"), F.asc("type")]


def fallback_calls(sources: DataFrame, names: list[str]) -> DataFrame:
    """(id, name): direct calls by name in a source, declarations left out."""
    found = F.regexp_extract_all("content", F.lit(r"(?:^|[^\w.])([A-Za-z_]\w*)\s*\("), 1)
    rows = sources.select("id", F.explode(F.array_distinct(found)).alias("name"))
    return rows.filter(F.col("name").isin(*names))


def projections(rows: DataFrame) -> DataFrame:
    """(id, embedding_text, lexical_text): metadata as JSON before the content; the additive terms behind it."""
    meta = F.to_json(F.struct("path", "language", F.col("label").alias("symbolLabel")))
    terms = F.array_join(text.additive_terms(F.concat_ws(" ", "path", "language", "label", "content")), " ")
    return rows.select("id", F.concat(meta, F.lit("\n"), "content").alias("embedding_text"), F.concat(meta, F.lit("\n"), "content", F.lit("\n"), terms).alias("lexical_text"))


def controls(old: DataFrame, put: DataFrame, drop: DataFrame) -> DataFrame:
    """Key-value markers after an insert of new keys and a delete."""
    fresh = put.join(old.select("key"), "key", "left_anti")
    return old.unionByName(fresh).join(drop.select("key"), "key", "left_anti")


def dirty_overlay(rows: DataFrame, changed: DataFrame, term: str, most: int = OVERLAY_RESULTS) -> DataFrame:
    """Of changed files the chunks that hold the term, the first so many files by path."""
    hits = rows.join(changed.select("path").distinct(), "path", "left_semi").filter(text.has_term(F.col("content"), term))
    first = hits.select("path").distinct().orderBy("path").limit(most)
    return hits.join(F.broadcast(first), "path", "left_semi").select("id", "path", paths.role(F.col("path"), F.col("language"), F.lit("function")).alias("role"))


def unique_symbols(symbols: DataFrame, key: str = "symbol_key") -> DataFrame:
    """The rows, or an error where one key stands for different symbols; full repeats count once."""
    once = symbols.dropDuplicates().withColumn("n_", F.count("*").over(Window.partitionBy(key)))
    return once.filter(F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("symbol key used twice: "), key))).otherwise(F.lit(True))).drop("n_")


def must_coverage(outcome: str | None, *, skipped: bool = False) -> str | None:
    """How far the lane of ``must:`` terms came: ``outcome`` is a key of MUST_STATUS, or none if the lane did not run."""
    if outcome is None:
        return "lane_skipped_primary_limit_filled" if skipped else None
    return MUST_STATUS[outcome]


def traversal_pages(edges: DataFrame, symbol: str, *, after: str = "", limit: int = 20, confidences: tuple[str, ...] = ("high", "medium")) -> tuple[DataFrame, DataFrame]:
    """A page of callers and callees of a symbol by key, and a count of the edges left out, by direction and confidence."""
    side = F.when(F.col("src") == symbol, "callee").when(F.col("dst") == symbol, "caller")
    near = edges.withColumn("side", side).filter("side IS NOT NULL")
    key = F.concat_ws("\0", "side", "file", "src", "dst", "type")
    trusted = near.filter(F.col("confidence").isin(*confidences)).withColumn("key", key).dropDuplicates(["key"])
    page = trusted.filter(F.col("key") > after).orderBy("key").limit(limit)
    left_out = near.filter(~F.col("confidence").isin(*confidences)).groupBy("side", "confidence").agg(F.count("*").alias("n"))
    return page, left_out


def retry_limits(limit: int, has_must: bool) -> list[int]:
    """Candidate limits of the attempts: doubled up to 80, three with ``must:``, else one."""
    first = max(1, min(80, max(8 * limit, 32)))
    return [min(80, first << i) for i in range(3 if has_must else 1)]


def reranks(policy: str, present: bool, scope: str, allowed: bool) -> bool:
    return policy != "off" and present and scope != "docs" and allowed


def observed_counts(rows: DataFrame, name: str):
    """The rows with an observation of how many were written and how many bytes their content has."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")), seen
