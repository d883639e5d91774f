"""Scanning a tree of files under a policy."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions import paths

#: Bytes that are probed for text, and the size up to which unknown files count as text.
PROBE_BYTES, TEXT_BYTES = 8192, 1 << 20
#: Extensions by what they hold, and names of files without one.
SOURCES = "ts tsx js jsx mjs cjs py java cpp c h hpp cs go rs php rb swift kt scala m mm".split()
DOCUMENTS = "md markdown mdx rst txt adoc ipynb".split()
SETTINGS = "toml yaml yml json jsonc ini cfg conf properties xml".split()
SCRIPTS = "sh bash zsh fish ps1 bat cmd".split()
QUERIES = "sql graphql gql tf tfvars".split()
NAMES = ("Dockerfile", "Makefile", "Justfile", "Taskfile", "Procfile", "Jenkinsfile", ".dockerignore")
#: Extensions that each profile reads; ``all-text`` reads what looks like text too.
PROFILES = {
    "minimal": (*SOURCES, *DOCUMENTS),
    "default": (*SOURCES, *DOCUMENTS, *SETTINGS, *SCRIPTS, *QUERIES),
    "all-text": (*SOURCES, *DOCUMENTS, *SETTINGS, *SCRIPTS, *QUERIES),
}
#: Patterns that are ignored at first.
DEFAULT_IGNORE = tuple(
    """
    node_modules/** dist/** build/** out/** target/** coverage/** .nyc_output/**
    .vscode/** .idea/** *.swp *.swo
    .git/** .svn/** .hg/**
    .cache/** __pycache__/** .pytest_cache/**
    logs/** tmp/** temp/** *.log
    .env .env.* *.local
    package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lockb Cargo.lock Gemfile.lock composer.lock
    poetry.lock Pipfile.lock uv.lock
    *.pem *.key *.crt *.cer *.p12 *.pfx
    *.min.js *.min.css *.min.map *.bundle.js *.bundle.css *.chunk.js *.vendor.js *.polyfills.js *.runtime.js *.map
    *.sqlite *.sqlite3 *.db *.dump *.bak *.snap __snapshots__/**
    node_modules .git .svn .hg build dist out target .vscode .idea __pycache__ .pytest_cache coverage .nyc_output logs tmp temp
    """.split()
)


@dataclass(frozen=True)
class Policy:
    extensions: tuple[str, ...] = PROFILES["default"]
    names: tuple[str, ...] = NAMES
    ignore: tuple[str, ...] = DEFAULT_IGNORE
    all_text: bool = False

    @classmethod
    def of_profile(cls, name: str, **more) -> Policy:
        return cls(extensions=PROFILES[name], all_text=name == "all-text", **more)

    @classmethod
    def from_toml(cls, raw: str) -> Policy:
        """``[index] profile = "..."`` and ``ignore = [...]`` of a repository's settings."""
        index = tomllib.loads(raw).get("index", {})
        profile = index.get("profile", "default")
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile}")
        return cls.of_profile(profile, ignore=DEFAULT_IGNORE + tuple(index.get("ignore", ())))

    def by_extension(self, path: Column) -> Column:
        name = F.element_at(F.split(path, "/"), -1)
        return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*self.extensions) | name.isin(*self.names)

    def is_text(self, content: Column) -> Column:
        """Valid UTF-8 without NUL at the beginning, and not large; a character cut at the probe's end does no harm."""
        head = F.substring(content, 1, PROBE_BYTES)
        ok = F.lit(False)
        for cut in range(4):
            ok = ok | F.is_valid_utf8(F.substring(content, 1, PROBE_BYTES - cut).cast("string"))
            if cut == 0:
                ok = F.when(F.length(content) <= PROBE_BYTES, ok).otherwise(ok)
        return (F.length(content) <= TEXT_BYTES) & ok & ~F.hex(head).rlike("^(..)*00")

    def is_ignored(self, path: Column) -> Column:
        return paths.ignored(path, list(self.ignore))

    def may(self, path: Column) -> Column:
        """What the path alone allows."""
        return ~self.is_ignored(path) & (self.by_extension(path) | F.lit(self.all_text))

    def accepts(self, path: Column, content: Column) -> Column:
        known = self.by_extension(path) if self.extensions else F.lit(False)
        return ~self.is_ignored(path) & (known | (F.lit(self.all_text) & self.is_text(content)))


def code_files(spark: SparkSession, root: str, policy: Policy = Policy()) -> DataFrame:
    """(path, size, mtime, content, hash) of the files that the policy accepts; paths are relative to the root.

    Spark's reader passes over names that begin with a dot or an underscore, such
    as ``__init__.py``; they are listed by themselves and read by tasks.
    """
    base = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    path = F.substring_index(base, root.rstrip("/").split("://")[-1].rstrip("/") + "/", -1)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    seen = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    # the path's test comes first: of what it leaves out no content is read
    rows = seen.filter(policy.may(F.col("path"))).unionByName(hidden_files(spark, root, policy))
    rows = rows.filter(policy.accepts(F.col("path"), F.col("content")))
    return rows.withColumn("hash", F.sha2("content", 256))


def hidden_files(spark: SparkSession, root: str, policy: Policy) -> DataFrame:
    """(path, size, mtime, content) of the allowed files with a name or folder that begins with a dot or an underscore."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else Path(root).absolute().as_uri())
    listed = []
    for info in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        name = info.path.removeprefix(base).lstrip("/")
        if info.is_file and any(part[0] in "._" for part in name.split("/")):
            listed.append((name, info.size, info.mtime, info.path))
    rows = spark.createDataFrame(listed, "path string, size long, mtime timestamp, full string").filter(policy.may(F.col("path")))
    uri = root if "://" in root else "file:///"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = pafs.FileSystem.from_uri(uri)[0]
        for part in parts:
            for i in range(len(part)):
                one = part.iloc[i : i + 1]
                with files.open_input_file(one["full"].iloc[0]) as f:
                    yield one.drop(columns="full").assign(content=[f.read()])

    return rows.mapInPandas(read, "path string, size long, mtime timestamp, content binary")


def observe(files: DataFrame, path: str, listed: DataFrame | None = None) -> DataFrame:
    """(state, hash) of one path: indexed; not_indexable if only ``listed``, the whole listing, has it; else absent."""
    found = files.filter(F.col("path") == path).agg(F.first("hash").alias("hash"))
    there = listed.filter(F.col("path") == path).agg((F.count("*") > 0).alias("there")) if listed is not None else found.select(F.lit(False).alias("there"))
    both = found.crossJoin(there)  # one row each
    return both.select(F.when(F.col("hash").isNotNull(), "indexed").when(F.col("there"), "not_indexable").otherwise("absent").alias("state"), "hash")


def clean_status_path(raw: Column) -> Column:
    """A path of the tree, or null for one outside of it."""
    path = F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when((path != "") & (path != "..") & ~path.startswith("../"), path)


def git_status(lines: DataFrame, *, untracked: bool = False) -> DataFrame:
    """The paths of ``git status`` lines: ignored and, unless asked for, untracked entries go; a rename counts by its new name.

    Quoted paths are unquoted; lines without a path of the tree give no row.
    """
    line = F.rtrim("line")
    rows = lines.withColumn("line", line).filter((F.length("line") >= 4) & ~F.col("line").startswith("!!"))
    if not untracked:
        rows = rows.filter(~F.col("line").startswith("??"))
    body = F.trim(F.col("line").substr(F.lit(4), F.length("line")))
    target = F.trim(F.element_at(F.split(body, " -> "), -1))
    quoted = (F.length(target) >= 2) & target.startswith('"') & target.endswith('"')
    inner = F.replace(F.replace(target.substr(F.lit(2), F.length(target) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return rows.withColumn("path", clean_status_path(F.when(quoted, inner).otherwise(target))).drop("line").filter("path IS NOT NULL")


def git_status_z(output: DataFrame, *, untracked: bool = False) -> DataFrame:
    """(path) of NUL-separated status output in column ``output``: the record behind a rename or copy is where it came from."""
    records = F.split("output", "\0")
    # a record is an origin if the one before it is a rename that is no origin itself
    origin = F.aggregate(
        records,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip")),
        lambda acc, r: F.struct(
            F.when(acc["skip"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(r))).alias("kept"),
            (~acc["skip"] & (F.length(r) >= 4) & F.substring(r, 1, 1).isin("R", "C")).alias("skip"),
        ),
    )
    rows = output.select(F.explode(origin["kept"]).alias("r")).filter((F.length("r") >= 4) & ~F.col("r").startswith("!!"))
    if not untracked:
        rows = rows.filter(~F.col("r").startswith("??"))
    return rows.select(clean_status_path(F.col("r").substr(F.lit(4), F.length("r"))).alias("path")).filter("path IS NOT NULL").distinct()
