"""Column functions on identifiers, labels, lines and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the lexical index are runs of letters, digits and underscores of at most so many characters.
TOKEN, TOKEN_MAX = r"[\p{L}\p{N}_]+", 255
#: Fixed value: identifier tokens of the search projections.
IDENTIFIER = r"[\p{L}\p{N}_$]+"
#: Words that say that something is written.
WRITER_WORDS = (
    "write writes writing written update updates updated updating create creates created creating generate generates generated generating "
    "emit emits emitted emitting persist persists persisted persisting configure configures configured configuring "
    "install installs installed installing build builds built builder"
).split()
#: Confidence of an edge as a number.
CONFIDENCE = {"high": 0.95, "medium": 0.65, "low": 0.35}
#: Minutes up to which an index counts as fresh and as aging.
FRESH_MINUTES, AGING_MINUTES = 30, 24 * 60
#: Label prefixes and the kind of symbol they name; type-like names end before ``<`` too.
LABEL_KINDS = ("method", "function", "class", "interface", "type", "enum", "trait", "module", "namespace", "macro")
TYPE_LIKE = ("class", "interface", "type")
#: Languages by file extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "md": "markdown"}


def lexical_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.length(t) <= TOKEN_MAX)


def identifier_components(token: Column) -> Column:
    """Parts of an identifier at case changes, acronym ends, underscores, dollars and blanks."""
    spaced = F.regexp_replace(token, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(spaced, r"[_$\s]+"), lambda p: p != "")


def additive_terms(text: Column) -> Column:
    """Distinct components, in order, that are not whole tokens themselves."""
    tokens = F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.filter(identifier_components(t), lambda p: p != t))))


def identifier_words(value: Column) -> Column:
    """Lower-case ASCII words of an identifier."""
    spaced = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda p: p != "")


def normalized_identity(value: Column) -> Column:
    return F.array_join(identifier_words(value), " ")


def last_segment(value: Column) -> Column:
    parts = F.filter(F.split(value, "[.#:/]+"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(value)


def search_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", ""))


def has_term(field: Column, term: str) -> Column:
    """The term between characters that are neither ASCII letters nor digits, in either case."""
    return F.coalesce(field.rlike(f"(?i)(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)"), F.lit(False))


#: Keywords in front of a declared name, of a bound name and of a construction, and what a usage is followed by.
DECLARING, BINDING, CONSTRUCTING = ("class", "def", "function", "type", "interface", "enum", "struct"), ("const", "let", "var"), ("new",)
CALL_MARK, ASSIGN_MARK = r"\(", "="


def _behind(keywords: tuple[str, ...], name: str) -> str:
    return rf"\b(?:{'|'.join(keywords)})\s+{name}\b"


def usage_kind(content: Column, term: str) -> Column:
    """``executable`` for a construction, call or assignment, ``import`` for an import line, else null."""
    name = re.escape(term)
    running = [_behind(CONSTRUCTING, name), rf"\b{name}\s*{CALL_MARK}", rf"\b{name}\b\s*{ASSIGN_MARK}"]
    bringing = [rf"\bimport\s+.*\b{name}\b"]  # ``from x import name`` holds one too
    return F.when(content.rlike("(?i)" + "|".join(running)), "executable").when(content.rlike("(?i)" + "|".join(bringing)), "import")


def declares(content: Column, term: str) -> Column:
    """The term behind a declaring keyword, or bound to a function."""
    name, argument = re.escape(term), r"(?:\([^)]*\)|[a-z_$][\w$]*)"
    function = rf"(?:(?:async\s+)?function\b|(?:async\s*)?{argument}\s*=>)"
    return F.coalesce(content.rlike(rf"(?i){_behind(DECLARING, name)}|{_behind(BINDING, name)}\s*=\s*{function}"), F.lit(False))


def lexical_evidence(label: Column, path: Column, content: Column, terms: list[tuple[str, str]], phrases: list[str] = (), *, reference: bool = False, writer: bool = False) -> Column:
    """struct(has, exact, whole, phrases): what a query's terms (term, kind) and quoted phrases find in a chunk.

    A phrase counts wherever it stands. A term counts in any part of a word, but
    as an exact match only as a whole one; where references are asked for, terms
    show none, and one that is only used and not declared here shows no more than
    that it is there.
    """
    label, path, content = (F.coalesce(F.lower(c), F.lit("")) for c in (label, path, content))
    folders = F.filter(F.split(path, "/"), lambda f: f != "")
    held = {p: label.contains(p) | F.exists(folders, lambda f: f.contains(p)) | content.contains(p) for p in map(str.lower, phrases)}
    some, whole = {}, {}
    for term, kind in terms:
        term = term.lower()
        used = usage_kind(content, term).isNotNull() & ~declares(content, term) if reference else F.lit(False)
        words = has_term(label, term) | F.exists(folders, lambda f: has_term(f, term)) | has_term(content, term)
        some[term] = used | words | label.contains(term) | path.contains(term) | content.contains(term)
        if kind == "whole":
            whole[term] = ~used & words

    def names(found: dict[str, Column]) -> Column:
        listed = [F.when(hit, F.lit(name)) for name, hit in found.items()]
        return F.filter(F.array(*listed), lambda x: x.isNotNull()) if listed else F.array().cast("array<string>")

    def any_of(found: dict[str, Column]) -> Column:
        out = F.lit(False)
        for hit in found.values():
            out = out | hit
        return out

    exact = any_of(held) | (any_of(whole) if writer or not reference else F.lit(False))
    return F.struct((any_of(held) | any_of(some)).alias("has"), exact.alias("exact"), names(whole).alias("whole"), names(held).alias("phrases"))


def staleness(indexed_at: Column, now: Column) -> Column:
    age = F.greatest(F.lit(0), F.unix_micros(now.cast("timestamp")) - F.unix_micros(indexed_at.cast("timestamp"))) / 60e6
    return F.when(indexed_at.isNull(), "unknown").when(age <= FRESH_MINUTES, "fresh").when(age <= AGING_MINUTES, "aging").otherwise("stale")


def confidence(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in CONFIDENCE.items():
        out = out.when(level == name, F.lit(value))
    return out


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 units: a character above U+FFFF counts as two."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 8)


def line_count(text: Column) -> Column:
    return F.size(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n", -1))


def line_tokens(line: Column) -> Column:
    spaced = F.regexp_replace(line, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda p: p != "")


def is_writer_term(term: Column) -> Column:
    return term.isin(*WRITER_WORDS)


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("text"))


def label_kind(label: Column) -> Column:
    """struct(kind, name) of a label such as ``async method run(x)``; kind null if it names none."""
    compact = F.trim(F.regexp_replace(label, r"\s+", " "))
    kind = F.regexp_extract(compact, "^(?:async (?=method |function ))?(" + "|".join(LABEL_KINDS) + r") .+$", 1)
    rest = F.regexp_extract(compact, "^(?:async )?(?:" + "|".join(LABEL_KINDS) + ") (.+)$", 1)
    type_like = F.trim(F.split(F.trim(F.split(rest, "[<(]")[0]), " ")[0])
    plain = F.trim(F.split(rest, "\\(")[0])
    name = F.when(kind.isin(*TYPE_LIKE), type_like).otherwise(plain)
    return F.struct(F.when(kind != "", kind).alias("kind"), F.when((kind != "") & (name != ""), name).alias("name"))


def module_path(folder: Column, specifier: Column) -> Column:
    """``./`` and ``../`` of a relative specifier worked off against the folder."""
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")
