"""The engine's public surface: index a tree, search it, read it and walk its calls."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmap.functions import paths, source, text
from quillmap.operators import changes, detail, graph, joins, lexical, search, shape
from quillmap.plans import language
from quillmap.plans.language import Operators, Plan, Request, make_plan, parse_operators
from quillmap.sources.scan import Policy, code_files
from quillmap.sources.store import Store, use_checkpoints

#: Dimensions of the offline embedding.
DIMENSIONS = 256
#: Seconds for which a frozen answer can be paged, and results that a live path may add.
PAGE_SECONDS, LIVE_RESULTS = 15 * 60, 16
#: Bytes of a disclosed answer, and of what surrounds its results.
ANSWER_BYTES, ENVELOPE_BYTES, RESULT_BYTES = 24_000, 1_500, 600


@lru_cache(maxsize=8)
def _unit_counts(dimensions: int):
    @F.pandas_udf("array<double>")
    def counts(places: pd.Series) -> pd.Series:
        out = []
        for held in places:
            n = np.bincount(np.asarray(held if held is not None else [], dtype=np.int64), minlength=dimensions).astype(float)
            size = float(np.sqrt((n * n).sum()))
            out.append(n / size if size else n)
        return pd.Series(out)

    return counts


def embed(content: Column, dimensions: int = DIMENSIONS) -> Column:
    """A hashed bag of lower-case words, as a unit vector: the embedding that needs no model."""
    places = F.transform(text.line_tokens(content), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    return _unit_counts(dimensions)(places)


#: A reranker takes a query and (id, document) rows and gives (index, score).
Reranker = Callable[[str, list[tuple[str, str]]], list[tuple[int, float]]]


@dataclass
class Answer:
    """The rows of a search and what became of its candidates."""

    rows: DataFrame
    plan: Plan
    passes: list[str] = field(default_factory=list)
    expansion: str | None = None
    must: str | None = None
    removed: dict[str, int] = field(default_factory=dict)
    snapshot: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class Engine:
    """Tables of one code base in a store: files, chunks, symbols, calls, bindings, edges and the lexical index."""

    spark: SparkSession
    store: Store
    embedding: Callable[[Column], Column] = embed
    reranker: Reranker | None = None
    #: Gives symbols of files (path, content), and further rules that give (call, target) from calls, callers, symbols and modules.
    analysis: Callable[[DataFrame], DataFrame] = source.symbols
    resolvers: tuple[Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame], ...] = ()

    # -- index -----------------------------------------------------------------
    def build(self, root: str, policy: Policy = Policy()) -> dict[str, int]:
        """Index the tree afresh; all tables are published at once."""
        return self._publish(self._scan(root, policy), {})

    def sync(self, root: str, policy: Policy = Policy()) -> dict[str, int]:
        """Bring the index up to the tree: only added and modified files are analysed again."""
        snapshot = self.store.snapshot()
        new, old = self._scan(root, policy), self._read("files", snapshot)
        changed = changes.diff(old, new).checkpoint()
        counts = {r.change_type: r["count"] for r in changed.groupBy("change_type").count().collect()}
        if counts:
            fresh = new.join(changed.filter("change_type <> 'removed'"), "path", "left_semi")
            self._publish(fresh, snapshot, changed.select("path"))
        return {k: counts.get(k, 0) for k in ("added", "modified", "removed")}

    def _scan(self, root: str, policy: Policy) -> DataFrame:
        """One reading of the tree, from which all tables are made."""
        use_checkpoints(self.spark)
        return code_files(self.spark, root, policy).withColumn("content", F.col("content").cast("string")).checkpoint()

    def _read(self, name: str, snapshot: dict[str, int]) -> DataFrame:
        return self.store.read(name, snapshot.get(name))

    def _publish(self, files: DataFrame, snapshot: dict[str, int], gone: DataFrame | None = None) -> dict[str, int]:
        staged = {}
        for name, rows in self._tables(files).items():
            if gone is not None:
                key = "path" if "path" in rows.columns else "file"
                kept = self._read(name, snapshot).join(gone.withColumnRenamed("path", key), key, "left_anti")
                rows = kept.unionByName(rows)
            staged[name] = self.store.stage(name, rows)
        staged["edges"] = self.store.stage("edges", self._link(staged))
        staged |= lexical.stage(self.store, self._lexical(self._read("chunks", staged)), content="lexical")
        roots = changes.bucketed_root(self._read("files", staged))
        staged["checkpoint"] = self.store.stage("checkpoint", roots)
        self.store.publish_all(staged)
        return {name: self._read(name, staged).count() for name in ("files", "chunks", "symbols", "edges")}

    @staticmethod
    def _lexical(chunks: DataFrame) -> DataFrame:
        terms = F.array_join(text.additive_terms(F.col("content")), " ")
        return chunks.select("id", F.lower(F.concat_ws(" ", "path", "label", "content", terms)).alias("lexical"))

    def _chunks(self, files: DataFrame) -> DataFrame:
        chunks = source.chunks(files.select("path", "content")).withColumn("indexed_at", F.current_timestamp())
        return chunks.withColumn("language", text.language_of(F.col("path"))).withColumn("embedding", self.embedding(F.concat_ws(" ", "path", "content")))

    @staticmethod
    def _key(file: str) -> Column:
        return F.concat(F.lit("symkey_"), F.substring(F.sha2(F.concat_ws("\0", file, "kind", "qualified_name"), 256), 1, 32))

    def _tables(self, files: DataFrame) -> dict[str, DataFrame]:
        symbols = self.analysis(files)
        # of declarations repeated in a file the first stands for all
        symbols = symbols.withColumn("symbol_key", self._key("file"))
        first = symbols.groupBy("symbol_key").agg(F.min_by(F.struct(*symbols.columns), F.struct("start_line", "end_line")).alias("s"))
        symbols = detail.unique_symbols(first.select("s.*"))
        # a symbol's windows are its own; what lies between symbols belongs to the innermost around it
        chunks = self._chunks(files).withColumn("own", F.when(F.col("qualified_name").isNotNull(), self._key("path"))).drop("kind", "qualified_name")
        between = chunks.filter("own IS NULL").withColumnRenamed("path", "file").select("id", "file", "start_line", "end_line")
        owners = joins.innermost(between, self._spans(symbols), keys=["id"]).select("id", F.col("owner").alias("around"))
        chunks = chunks.join(owners, "id", "left").withColumn("owner", F.coalesce("own", "around")).drop("own", "around")
        labels = symbols.select(F.col("symbol_key").alias("owner"), F.col("qualified_name").alias("label"))
        return {
            "files": files.select("path", "hash", "content"),
            "symbols": symbols,
            "chunks": chunks.join(labels, "owner", "left"),
            "calls": source.calls(files),
            "bindings": source.bindings(files),
        }

    @staticmethod
    def _spans(symbols: DataFrame) -> DataFrame:
        return symbols.select("file", F.col("start_line").alias("s"), F.col("end_line").alias("e"), (F.col("kind") == "file").cast("int").alias("kind_rank"), "symbol_key")

    def _link(self, staged: dict[str, int]) -> DataFrame:
        """CALLS, TESTS, IMPORTS and EXPORTS edges.

        A call goes from the innermost symbol around it to what its name means:
        a member call by its receiver (own class, imported module or class), a
        direct one by the imports of its file, then by its file, then by being
        the only one. A call whose name an import brings in goes there or nowhere.
        """
        symbols, calls, bindings, files = (self._read(n, staged) for n in ("symbols", "calls", "bindings", "files"))
        modules = self._modules(bindings, files).checkpoint()
        numbered = calls.withColumn("call", F.xxhash64("file", "callee", "line", "kind", "receiver")).dropDuplicates(["call"])
        callers = joins.innermost(numbered.select("call", "file", F.col("line").alias("start_line"), F.col("line").alias("end_line")), self._spans(symbols), keys=["call"])
        found = self._targets(numbered, callers, symbols, modules)
        where = symbols.select(F.col("symbol_key").alias("target"), F.col("file").alias("dst_path"), F.col("kind").alias("dst_kind"))
        rows = numbered.join(callers.select("call", F.col("owner").alias("src")), "call").join(found, "call").join(where, "target").withColumnRenamed("file", "src_path")
        # a call of a class from its own file says little about what runs
        sure = (F.col("src_path") == F.col("dst_path")) & ~((F.col("kind") != "member") & (F.col("dst_kind") == "class"))
        edges = rows.select("src", F.col("target").alias("dst"), F.lit("CALLS").alias("type"), F.col("src_path").alias("file"), "line", F.when(sure, "high").otherwise("low").alias("confidence"), F.col("callee").alias("name"), "src_path", "dst_path")
        reached = detail.reexports(modules.filter("kind = 'import'").select("file", F.col("path").alias("target")), modules.filter("kind <> 'import'").select("file", F.col("path").alias("target")))
        edges = detail.upgraded_calls(edges, symbols, reached)
        both = edges.unionByName(graph.tests_of(edges)).select("src", "dst", "type", "file", "line", "confidence")
        return both.unionByName(self._imports(symbols, modules)).distinct()

    @staticmethod
    def _modules(bindings: DataFrame, files: DataFrame) -> DataFrame:
        """The bindings with the file (path) that their module is: relative ones by their folder, others by the only file of that dotted name."""
        folder = F.regexp_extract("file", "^(?:(.*)/)?[^/]*$", 1)
        rows = bindings.withColumn("import", F.xxhash64("file", "module", "imported", "local", "line"))
        dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
        name = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/")
        steps = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), name)
        dotted = F.when(F.col("module").startswith("./") | F.col("module").startswith("../"), text.module_path(folder, F.col("module"))).when(dots > 0, text.module_path(folder, steps))
        # what a package's name brings in may be a module of it
        inner = F.when(F.col("imported").isNotNull(), F.concat_ws("/", dotted, "imported"))
        ends = [f"{end}" for end in (".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", "")]
        tries = F.filter(F.concat(F.array(*(F.concat(inner, F.lit(e)) for e in (".py", "/__init__.py"))), F.array(*(F.concat(dotted, F.lit(e)) for e in ends))), lambda p: p.isNotNull())
        known = files.select("path").distinct()
        near = joins.first_module(rows.filter(dotted.isNotNull()).select("import", tries.alias("candidates")), known)
        plain = known.withColumn("path_", F.col("path")).withColumn("path", F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), r"\.(ts|tsx|js|jsx)$", ""))
        # a package's module before the package
        names = F.filter(F.array(F.when(F.col("imported").isNotNull(), F.concat_ws(".", "module", "imported")), F.col("module")), lambda n: n.isNotNull())
        asked = rows.filter(dotted.isNull()).select("import", F.posexplode(names).alias("turn", "name"))
        far = joins.unique_suffix(asked.select("name").distinct(), plain.select("path")).filter("path IS NOT NULL").join(plain, "path").select("name", "path_")
        absolute = asked.join(far, "name").groupBy("import").agg(F.min_by("path_", "turn").alias("path"))
        return rows.join(near.unionByName(absolute).dropDuplicates(["import"]), "import")

    def _targets(self, calls: DataFrame, callers: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
        """(call, target) by the first rule that says anything about the call."""
        named = symbols.filter("kind <> 'file'").select("symbol_key", "name", "file", "kind", "parent", "qualified_name")
        top = named.filter("parent IS NULL")
        one = lambda rows, keys: rows.groupBy(*keys).agg(F.countDistinct("symbol_key").alias("n"), F.min("symbol_key").alias("target"), F.first("qualified_name").alias("class_name")).filter("n = 1").drop("n")
        brought = modules.filter("kind = 'import'").select(F.col("file"), F.col("local"), F.col("imported"), F.col("path")).distinct()
        member, direct = calls.filter("kind = 'member'"), calls.filter("kind <> 'member'")
        # the receiver is an imported module
        module_of = brought.filter("imported IS NULL OR path RLIKE concat('(^|/)', imported, '(/__init__)?[.]py$')").select("file", F.col("local").alias("receiver"), "path")
        by_module = member.join(module_of, ["file", "receiver"]).join(one(top, ["file", "name"]).withColumnsRenamed({"file": "path", "name": "callee"}), ["path", "callee"]).select("call", "target")
        # the receiver is the caller's own class, a class of the file, or an imported one
        classes = one(top.filter("kind = 'class'"), ["file", "name"]).select("file", F.col("name").alias("receiver"), F.col("file").alias("path"), "class_name")
        outside = brought.filter("imported IS NOT NULL").join(classes.select("path", F.col("receiver").alias("imported"), "class_name"), ["path", "imported"]).select("file", F.col("local").alias("receiver"), "path", "class_name")
        around = callers.select("call", F.col("owner").alias("symbol_key")).join(named.select("symbol_key", "parent"), "symbol_key").filter("parent IS NOT NULL")
        own = member.filter("receiver IN ('self', 'cls')").join(around.select("call", F.col("parent").alias("class_name")), "call").select("call", F.col("file").alias("path"), "class_name", "callee")
        by_name = member.join(classes.unionByName(outside), ["file", "receiver"]).select("call", "path", "class_name", "callee")
        methods = one(named.filter("kind = 'method'"), ["file", "parent", "name"]).drop("class_name").withColumnsRenamed({"file": "path", "parent": "class_name", "name": "callee"})
        by_class = own.unionByName(by_name).join(methods, ["path", "class_name", "callee"]).select("call", "target")
        # a direct call: what an import brings in decides alone
        imported = direct.join(brought.filter("imported IS NOT NULL").select("file", F.col("local").alias("callee"), "imported", "path"), ["file", "callee"])
        by_import = imported.join(one(top, ["file", "name"]).withColumnsRenamed({"file": "path", "name": "imported"}), ["path", "imported"]).select("call", "target")
        local = joins.resolve_unambiguous(
            direct.join(imported.select("call"), "call", "left_anti").select("call", F.col("callee").alias("name"), "file"),
            named.filter("kind <> 'method'").select(F.col("symbol_key").alias("key"), "name", "file"),
        )
        every = None
        further = [resolve(calls, callers, symbols, modules).select("call", "target") for resolve in self.resolvers]
        for rank, rows in enumerate((by_module, by_class, by_import, local.filter("target IS NOT NULL"), *further)):
            part = rows.withColumn("rule", F.lit(rank))
            every = part if every is None else every.unionByName(part)
        first = every.groupBy("call", "rule").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
        chosen = first.groupBy("call").agg(F.min_by(F.struct("n", "target"), "rule").alias("m"))
        return chosen.filter("m.n = 1").select("call", "m.target")

    @staticmethod
    def _imports(symbols: DataFrame, modules: DataFrame) -> DataFrame:
        """IMPORTS from a file to what it names (the file if it names nothing that is there), EXPORTS the other way round for what is passed on."""
        files = symbols.filter("kind = 'file'").select("file", F.col("symbol_key").alias("file_key"))
        names = symbols.filter("kind <> 'file' AND parent IS NULL").groupBy("file", "name").agg(F.count("*").alias("n"), F.min("symbol_key").alias("key")).filter("n = 1")
        rows = modules.join(files, "file").join(files.withColumnsRenamed({"file": "path", "file_key": "target_key"}), "path")
        rows = rows.join(names.select(F.col("file").alias("path"), F.col("name").alias("imported"), "key"), ["path", "imported"], "left")
        kind = F.when(F.col("kind") == "import", "IMPORTS").otherwise("EXPORTS")
        return rows.select(F.col("file_key").alias("src"), F.coalesce("key", "target_key").alias("dst"), kind.alias("type"), "file", "line", F.lit("high").alias("confidence"))

    # -- search ----------------------------------------------------------------
    def search(self, request: Request) -> DataFrame:
        """Ranked rows: grouped by owner or file, or the chunks themselves."""
        return self.answer(request).rows

    def answer(self, request: Request, *, changed: DataFrame | None = None, snapshot: dict[str, int] | None = None) -> Answer:
        """The ranked rows and how they were found.

        ``changed`` holds files (path, content) that are newer than the index:
        their indexed chunks are left out, and what they hold now is searched in
        their place. All of an answer is read from one snapshot.
        """
        request.check()
        ops = parse_operators(request.query)
        plan = make_plan(ops.query, operators=ops)
        at = snapshot if snapshot is not None else self.store.snapshot()
        out = Answer(self.spark.range(0).select(F.lit(0).alias("rank")), plan, snapshot=at)
        status, symbol = self._exact(plan, ops, request, at)
        if status == "hit" and changed is None:
            out.rows, out.passes = symbol, ["exact_registry"]
            out.counts = shape.result_counts(request.limit, 1)
            return out
        rows = self._read("chunks", at).withColumn("owner", F.coalesce("owner", "path"))
        fresh = None
        if changed is not None:
            rows = rows.join(changed.select("path").distinct(), "path", "left_anti")
            fresh = self._chunks(changed.select("path", "content")).withColumn("label", F.lit(None).cast("string")).withColumn("owner", F.col("path")).checkpoint()
        checks = self._checks(request, ops)
        for limit in detail.retry_limits(request.limit, bool(ops.must)):
            found = self._candidates(out, plan, ops, request, rows, fresh, checks, limit, registry_fallback=status == "ambiguous")
            if not ops.must or found.filter("reason IS NULL").count() >= request.limit:
                break
        out.removed = {r.reason: r["count"] for r in found.filter("reason IS NOT NULL").groupBy("reason").count().collect()}
        told = text.lexical_evidence(F.col("label"), F.col("path"), F.col("content"), plan.terms, plan.phrases, reference=plan.flags["reference"], writer=plan.flags["writer"])
        kept = found.filter("reason IS NULL").withColumn("must", F.lit(bool(ops.must))).withColumn("exact", told["exact"] if plan.flags["pinned"] else F.lit(False))
        kept = detail.sound(kept)
        good, _ = detail.valid_spans(kept)
        ranked = self._reranked(shape.authoritative_rank(good), plan, request).checkpoint()
        out.rows = self._shaped(ranked, request)
        out.counts = shape.result_counts(request.limit, ranked.count())
        return out

    def _exact(self, plan: Plan, ops: Operators, request: Request, at: dict[str, int]) -> tuple[str, DataFrame | None]:
        """The one symbol that a query for an identifier names, if grouped results may be that alone."""
        if plan.target is None or plan.route not in ("exact_identifier", "ownership") or request.result_mode != "grouped" or request.group_by != "symbol":
            return "none", None
        symbols = self._read("symbols", at).filter("kind <> 'file'").filter(paths.in_scope(request.scope, paths.category(F.col("file"))))
        symbols = symbols.withColumn("path", F.col("file")).withColumn("label", F.col("qualified_name")).withColumn("language", text.language_of(F.col("file"))).withColumn("parents", F.split(F.coalesce("parent", F.lit("")), r"\."))
        symbols = symbols.filter(detail.symbol_filter(lang=ops.lang, must=ops.must, exclude=ops.exclude) & self._globs(ops))
        asked = self.spark.createDataFrame([(0, plan.target)], "query int, term string")
        tiers = [("instance", F.col("symbol_key")), ("name", F.col("name")), ("qualified", F.col("qualified_name")), ("identity", text.normalized_identity(F.col("name"))), ("label", F.col("label"))]
        found = joins.exact_lookup(symbols.withColumn("key", F.col("symbol_key")), asked, tiers).first()
        if found.status != "hit":
            return found.status, None
        hit = symbols.filter(F.col("symbol_key") == found.key)
        return "hit", hit.select(F.lit(1).cast("long").alias("rank"), F.col("symbol_key").alias("owner"), "file", F.col("qualified_name").alias("name"), "start_line", "end_line", F.lit(0).cast("long").alias("chunks"), F.lit(1.0).alias("score"))

    @staticmethod
    def _globs(ops: Operators) -> Column:
        keep = F.lit(True)
        for wanted, patterns in ((True, ops.path), (False, ops.exclude_path)):
            if patterns:
                any_of = F.lit(False)
                for p in patterns:
                    any_of = any_of | F.col("path").rlike(paths.glob_regex(p))
                keep = keep & (any_of if wanted else ~any_of)
        return keep

    def _checks(self, request: Request, ops: Operators) -> list[tuple[str, Column]]:
        """What a candidate must pass, in the order in which removals are counted."""
        fields = ["label", "path", "content"]
        return [
            ("scope", paths.in_scope(request.scope, paths.category(F.col("path")))),
            ("language", F.lower("language").isin(*ops.lang) if ops.lang else F.lit(True)),
            ("path", self._globs(replace(ops, exclude_path=[]))),
            ("exclude_path", self._globs(replace(ops, path=[]))),
            ("must", search.must(fields, ops.must)),
            ("exclude", search.exclude(fields, ops.exclude)),
        ]

    def _candidates(self, out: Answer, plan: Plan, ops: Operators, request: Request, rows: DataFrame, fresh: DataFrame | None, checks: list, limit: int, *, registry_fallback: bool) -> DataFrame:
        """The chunks of all passes with their fused score and the reason for which one is removed."""
        at, passed = out.snapshot, search.first_removal(checks).isNull()
        terms = [t for t, _ in plan.terms] or ops.query.lower().split()[:8]
        scoped = rows.filter(passed)
        passes: dict[str, tuple[DataFrame, float]] = {}
        primary = self._pass(scoped, terms, plan, request.match_mode, at, limit, ops.query)
        passes["primary"] = primary, 1.0
        more, out.expansion = language.expansion(plan, primary.count(), operators=ops, registry_fallback=registry_fallback)
        if more:
            words = list(dict.fromkeys([*terms, *(w for t in terms for w in t.split())]))
            passes["expanded"] = self._pass(scoped, words, plan, "any_terms", at, limit, " ".join(words)), 1.0
        if ops.must:
            words = [w.lower() for t in ops.must for w in t.split()]
            lane = self._lane(scoped, words, at) if words else None
            if lane is not None:
                passes["must_lane"] = lane, 1.0
                out.must = detail.must_coverage("budget" if lane.count() >= shape.MOST_CANDIDATES else "completed")
            else:
                out.must = detail.must_coverage("unsupported")
        if plan.route in ("literal", "exact_identifier", "configuration") and (plan.target or plan.phrases):
            scan = search.best_lines(self._named(scoped, plan, at), [plan.target] if plan.target else [], phrase=plan.phrases[0] if plan.phrases else None)
            head = scan.orderBy(*search.scan_order(), "id").limit(search.SCAN_FILES)
            if plan.target or plan.phrases:
                passes["lexical_files"] = head.withColumn("rank", F.row_number().over(Window.orderBy(*search.scan_order(), "id"))).select("id", "rank"), 1.0
        every = rows
        if fresh is not None:
            columns = [c for c in rows.columns if c in fresh.columns]
            every = rows.select(columns).unionByName(fresh.select(columns))
            overlay = self._overlay(fresh.filter(passed), terms, plan)
            if ops.path and plan.route == "exact_path":
                # a changed file that is asked for by its path is an answer whatever it holds
                live = fresh.filter(F.col("path").isin(*ops.path) & passed).orderBy("path", "start_line", "id").limit(LIVE_RESULTS)
                passes["live_path"] = live.withColumn("rank", F.row_number().over(Window.orderBy("path", "start_line", "id"))).select("id", "rank"), 1.0
            passes["dirty_overlay"] = overlay, float(len(passes))
        out.passes = list(passes)
        fused = search.fuse_passes(list(passes.values()))
        return fused.join(every, "id").withColumn("reason", search.first_removal(checks)).checkpoint()

    def _scores(self, terms: list[str], mode: str, at: dict[str, int]) -> DataFrame:
        """Scores by the whole index, whatever filter comes after."""
        return lexical.bm25(self._read("postings", at), self._read("totals", at), terms, mode=mode)

    @staticmethod
    def _words(terms: list[str]) -> list[str]:
        """The index's tokens of terms that may hold more than one."""
        return list(dict.fromkeys(w for t in terms for w in re.findall(r"\w+", t.lower())))

    def _pass(self, scoped: DataFrame, terms: list[str], plan: Plan, mode: str, at: dict[str, int], limit: int, query: str) -> DataFrame:
        """(id, rank) of one pass: the lexical arm, the dense arm or both, fused."""
        arms = []
        if words := self._words(terms):
            scored = self._scores(words, mode if plan.mode == "lexical" else "any_terms", at)
            arms.append(search.top(scored.join(scoped.select("id", "owner"), "id"), limit))
        if plan.mode != "lexical" or not arms:
            asked = self.spark.range(1).select(self.embedding(F.lit(query)).alias("embedding"))
            arms.append(search.top(search.cosine(scoped.select("id", "owner", "embedding"), asked).filter("score > 0").select("id", "owner", "score"), limit))
        best = search.top(search.fuse(arms), limit)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank").checkpoint()

    def _lane(self, scoped: DataFrame, words: list[str], at: dict[str, int]) -> DataFrame | None:
        """(id, rank): chunks that hold all words of the ``must:`` terms."""
        if not (tokens := self._words(words)):
            return None
        best = search.top(self._scores(tokens, "all_terms", at).join(scoped.select("id"), "id"), shape.MOST_CANDIDATES)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank").checkpoint()

    def _named(self, scoped: DataFrame, plan: Plan, at: dict[str, int]) -> DataFrame:
        """Chunks that hold the words of the target or phrase, found by the index and not by reading every text."""
        words = self._words([plan.target] if plan.target else plan.phrases[:1])
        if not words:
            return scoped.limit(0)
        best = search.top(self._scores(words, "all_terms", at).join(scoped.select("id"), "id"), search.SCAN_FILES)
        return scoped.join(F.broadcast(best.select("id")), "id", "left_semi")

    def _overlay(self, fresh: DataFrame, terms: list[str], plan: Plan) -> DataFrame:
        """(id, rank) of changed chunks with lexical evidence, of a bounded number of files."""
        hit, worth = F.lit(False), F.lit(0)
        for t in [*terms, *([plan.target.lower()] if plan.target else [])]:
            has = text.has_term(F.col("content"), t)
            hit, worth = hit | has, worth + has.cast("int")
        found = fresh.filter(hit).withColumn("worth", worth).withColumn("declared", text.declares(F.col("content"), plan.target) if plan.target else F.lit(False))
        order = [F.desc("declared"), F.desc("worth"), "path", "start_line", "id"]
        return found.orderBy(*order).limit(detail.OVERLAY_RESULTS).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "rank")

    def _reranked(self, ranked: DataFrame, plan: Plan, request: Request) -> DataFrame:
        """The reranker's order for the first of each family; other places stay as they are."""
        allowed = plan.flags["rerank"] and not plan.flags["documentation"]
        if not detail.reranks("auto", self.reranker is not None, request.scope, allowed):
            return ranked
        head = ranked.orderBy("rank").limit(shape.rerank_budget(request.limit, plan.confidence != "high"))
        begin = detail.rerank_start([r.exact for r in head.select("exact", "rank").orderBy("rank").collect()])
        if begin is None:
            return ranked
        pool = shape.family_pool(head.filter(F.col("rank") > begin).withColumn("family", F.col("owner")), shape.MOST_RERANKED)
        wanted = pool.withColumn("role", paths.role(F.col("path"), F.col("language"), F.lit(None).cast("string"))).withColumn("kind", F.lit("chunk")).withColumn("label", F.coalesce("label", "path")).withColumn("declaration", F.col("label"))
        for name in detail.CONTEXT_CAPS:
            wanted = wanted.withColumn(name, F.array().cast("array<struct<path:string,label:string>>"))
        documents = sorted((r.id, r.document) for r in detail.rerank_documents(wanted, [t for t, _ in plan.terms]).collect())  # at most MOST_RERANKED
        scores = self.reranker(plan.query, documents)
        if not documents or len(scores) != len(documents) or sorted(i for i, _ in scores) != list(range(len(documents))) or any(s != s or abs(s) == float("inf") for _, s in scores):
            return ranked
        chosen = self.spark.createDataFrame([(documents[i][0], float(s)) for i, s in scores], "id string, rerank_score double")
        return ranked.drop("rank").join(shape.apply_rerank(ranked.select("id", "rank"), chosen), "id")

    def _shaped(self, ranked: DataFrame, request: Request) -> DataFrame:
        if request.result_mode == "raw":
            age = text.staleness(F.col("indexed_at"), F.current_timestamp())
            return ranked.filter(F.col("rank") <= request.limit).select("rank", "id", "path", "start_line", "end_line", "label", "score", "content", age.alias("staleness"))
        key = "path" if request.group_by == "file" else "owner"
        grouped = ranked.groupBy(key).agg(F.min("rank").alias("best"), F.min_by("path", "rank").alias("file"), F.min_by("label", "rank").alias("name"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("chunks"), F.max("score").alias("score"))
        # an answer's groups, no more than its candidates
        order = grouped.withColumn("rank", F.row_number().over(Window.orderBy("best", key)))
        kept = shape.diversity(order.select(F.col(key).alias("id"), "file", F.col(key).alias("symbol"), "rank"), limit=request.limit).filter("kept").select(F.col("id").alias(key))
        final = order.join(kept, key).withColumn("rank", F.row_number().over(Window.orderBy("best", key)))
        return final.select(F.col("rank").cast("long").alias("rank"), key, "file", "name", "start_line", "end_line", "chunks", "score")

    def open_page(self, request: Request) -> str:
        """Freeze a search of up to 200 results; the handle pages through it."""
        handle = f"{int(time.time()):x}-{uuid.uuid4().hex}"
        name = f"results_{handle}"
        rows = self.search(replace(request, limit=shape.MAX_RESULTS))
        self.store.publish(name, self.store.stage(name, rows))
        return handle

    def continue_search(self, handle: str, offset: int, limit: int, *, now: float | None = None) -> DataFrame:
        """The next results of a frozen answer, as many as were asked for and fit an answer's bytes."""
        began = int(handle.split("-")[0], 16)
        if (now or time.time()) - began > PAGE_SECONDS:
            self.store.drop(f"results_{handle}")
            raise ValueError("the frozen answer has expired")
        rows = self.store.read(f"results_{handle}")
        if not 0 <= offset <= (total := rows.count()):
            raise ValueError(f"the answer has {total} results")
        shown = shape.disclosed([RESULT_BYTES] * (total - offset), limit, ANSWER_BYTES, ENVELOPE_BYTES)
        return shape.page(rows, offset, shown).orderBy("rank")

    def drop_expired(self, now: float | None = None) -> list[str]:
        """Drop frozen answers that can no longer be paged."""
        old = [n for n in self.store.names() if n.startswith("results_") and (now or time.time()) - int(n.split("_")[1].split("-")[0], 16) > PAGE_SECONDS]
        for name in old:
            self.store.drop(name)
        return old

    # -- navigation --------------------------------------------------------------
    def call_graph(self, symbol_key: str, *, direction: str = "callees", depth: int = 1, limit: int | None = None, confidences: tuple[str, ...] = ("high", "medium")) -> tuple[DataFrame, DataFrame]:
        at = self.store.snapshot()
        edges = self._read("edges", at)
        start = self.spark.createDataFrame([(symbol_key,)], "node string")
        nodes, left_out = graph.neighbours(edges, start, depth=depth, confidences=confidences, types=["CALLS"], reverse=direction == "callers", limit=limit)
        return nodes.join(self._read("symbols", at).withColumnRenamed("symbol_key", "node"), "node"), left_out

    def symbol_context(self, symbol_key: str, *, query: str = "", budget: int = 8000, limit: int = 20) -> dict:
        """A symbol's source within a byte budget, a page of its callers and callees, and what was left out of that."""
        at = self.store.snapshot()
        row = self._read("symbols", at).filter(F.col("symbol_key") == symbol_key).first()
        if row is None:
            raise ValueError(f"no symbol {symbol_key}")
        content = self._read("files", at).filter(F.col("path") == row.file).first().content
        plan = make_plan(query or row.name)
        parts = source.excerpts(content, row.start_line, row.end_line, plan.phrases[0] if plan.phrases else None, [t for t, _ in plan.terms], budget)
        lines = content.split("\n")
        page, left_out = detail.traversal_pages(self._read("edges", at).filter("type = 'CALLS'"), symbol_key, limit=limit)
        return {
            "symbol": row.qualified_name,
            "file": row.file,
            "parts": [(a, b, "\n".join(lines[a - 1 : b])) for a, b in parts],
            "relations": sorted((r.side, r.src, r.dst) for r in page.collect()),  # at most ``limit`` rows
            "left_out": {(r.side, r.confidence): r.n for r in left_out.collect()},  # a row a side and confidence
        }

    def outline(self, path: str, *, first: int = 1, last: int = 1 << 30, limit: int = 500) -> DataFrame:
        rows = self._read("symbols", self.store.snapshot()).filter((F.col("file") == path) & (F.col("kind") != "file") & (F.col("start_line") <= last) & (F.col("end_line") >= first))
        return rows.orderBy("start_line", F.desc("end_line"), "kind", "qualified_name").limit(limit)

    def read_file(self, path: str, first: int = 1, last: int = 1 << 30) -> str | None:
        lines = F.split("content", "\n")
        rows = self._read("files", self.store.snapshot()).filter(F.col("path") == path)
        row = rows.select(F.array_join(F.slice(lines, first, F.least(F.lit(last), F.size(lines)) - first + 1), "\n").alias("part")).first()
        return row.part if row else None

    def status(self) -> dict[str, int | None]:
        at = self.store.snapshot()
        return {name: at.get(name, self.store.published(name)) for name in self.store.names()}

    def clear(self) -> None:
        """Drop all tables; the set that names them goes first, so that no reader finds half of them."""
        names = self.store.names()
        self.store.drop_sets()
        for name in names:
            self.store.drop(name)
