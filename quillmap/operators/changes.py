"""Change sets between a checkpoint and the present, and the digests that guard them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change_type) of two frames of (path, hash)."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("is")), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return both.select("path", kind.alias("change_type")).filter("change_type IS NOT NULL")


def guarded(new: DataFrame, old: DataFrame, unread: list[str]) -> DataFrame:
    """The present with the old entries of folders that could not be read, so that they do not look removed."""
    hidden = F.lit(False)
    for p in unread:
        hidden = hidden | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
    return new.select("path", "hash").unionByName(old.filter(hidden).join(new, "path", "left_anti").select("path", "hash"))


def reuse_hashes(listing: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(path, hash, rehashed): the checkpoint's hash where size and time are as before, else a hash of the content."""
    old = checkpoint.select("path", F.col("hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    joined = listing.join(old, "path", "left")
    keep = F.coalesce(same, F.lit(False))
    return joined.select("path", F.when(keep, F.col("old_hash")).otherwise(F.sha2("content", 256)).alias("hash"), (~keep).alias("rehashed"))


def _joined(lines: str) -> Column:
    """A hash of a group's lines in order of their paths."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), ""), 256)


def merkle(files: DataFrame) -> DataFrame:
    """(root): sha256 over sorted lines of path, NUL, hash.

    The lines of all files make one string, so this is for the checkpoint of one
    repository; ``bucketed_root`` is for any number of files.
    """
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\n"))
    return files.select(F.struct("path", line.alias("line")).alias("x")).agg(_joined("x").alias("root"))


def bucket_roots(files: DataFrame, digits: int = 3) -> DataFrame:
    """(bucket, root): a root for each slice of the paths, so that no row holds all of them; 16 to the ``digits`` slices."""
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\n"))
    rows = files.select(F.substring(F.sha2("path", 256), 1, digits).alias("path_"), F.struct("path", line.alias("line")).alias("x"))
    return rows.groupBy(F.col("path_").alias("bucket")).agg(_joined("x").alias("root"))


def bucketed_root(files: DataFrame, digits: int = 3) -> DataFrame:
    """(root): the same over the roots of the slices."""
    return merkle(bucket_roots(files, digits).select(F.col("bucket").alias("path"), F.col("root").alias("hash")))


def source_digests(files: DataFrame, group: str, digits: int = 2) -> DataFrame:
    """(group, files, digest): for each group a root over the roots of its slices (path, hash)."""
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\n"))
    slices = files.select(group, F.substring(F.sha2("path", 256), 1, digits).alias("slice"), F.struct("path", line.alias("line")).alias("x"))
    roots = slices.groupBy(group, "slice").agg(F.count("*").alias("n"), _joined("x").alias("root"))
    lines = roots.select(group, "n", F.struct(F.col("slice").alias("path"), F.concat("slice", F.lit("\0"), "root", F.lit("\n")).alias("line")).alias("x"))
    return lines.groupBy(group).agg(F.sum("n").alias("files"), _joined("x").alias("digest"))


def compressed_prefixes(prefixes: DataFrame) -> DataFrame:
    """Prefixes that no other one covers: each is looked up among its own ancestors."""
    parts = F.split("prefix", "/")
    ups = prefixes.select("prefix", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("up"))
    covered = ups.join(prefixes.select(F.col("prefix").alias("up")), "up", "left_semi").select("prefix")
    return prefixes.join(covered, "prefix", "left_anti")


def merge_passes(rows: DataFrame) -> DataFrame:
    """Candidates of several passes by chunk key: scores added, the best backend score, the passes that found it."""
    return rows.groupBy("path", "start_line", "end_line", "language").agg(F.sum("score").alias("score"), F.max("backend_score").alias("backend_score"), F.array_join(F.array_sort(F.collect_set("pass")), ",").alias("passes"))
