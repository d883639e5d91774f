"""The store: immutable generations of parquet tables behind a pointer.

A generation is written whole beside the published ones and published by a new
pointer file, so a reader keeps the snapshot that it resolved. Paths go through
Spark's file systems only.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the sets of generations that were published together.
SETS = "sets"


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; a folder of our own is for local runs only."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(said or tempfile.mkdtemp(prefix="quillmap-checkpoints-"))


class Store:
    """Named tables under one root; each has generations ``g00000001`` and so on, and a pointer to the published one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def fingerprint(self, path: str) -> str:
        """Names, sizes and times of the files of a path."""
        fs, p = self._fs(path)
        found = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
        return json.dumps([path, sorted(found)])

    def generations(self, name: str) -> list[int]:
        return [int(n[1:]) for n in self._list(f"{self.root}/{name}") if n.startswith("g")]

    def published(self, name: str) -> int | None:
        """The generation of the newest pointer."""
        marks = [n for n in self._list(f"{self.root}/{name}/published") if n.startswith("p")]
        return int(marks[-1][1:]) if marks else None

    def stage(self, name: str, rows: DataFrame, *, partition_by: list[str] | None = None) -> int:
        """Write the rows as a new generation that nobody reads yet."""
        n = max([0, *self.generations(name)]) + 1
        writer = rows.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/g{n:08d}")
        return n

    def publish(self, name: str, generation: int) -> None:
        if generation not in self.generations(name):
            raise ValueError(f"{name} has no generation {generation}")
        if (now := self.published(name)) is not None and generation <= now:
            raise ValueError(f"generation {generation} of {name} is older than the published one")
        fs, p = self._fs(f"{self.root}/{name}/published/p{generation:08d}")
        fs.create(p, False).close()

    def publish_all(self, generations: dict[str, int]) -> int:
        """Publish several tables at once: a reader of ``snapshot`` sees all of them or none."""
        for name, generation in generations.items():
            if generation not in self.generations(name):
                raise ValueError(f"{name} has no generation {generation}")
        number = max([0, *self._sets()]) + 1
        fs, draft = self._fs(f"{self.root}/{SETS}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(self.snapshot() | generations, sort_keys=True).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/{SETS}/s{number:08d}")
        if not fs.rename(draft, final):
            raise RuntimeError("another writer published first")
        return number

    def _sets(self) -> list[int]:
        return [int(n[1:]) for n in self._list(f"{self.root}/{SETS}") if n.startswith("s")]

    def snapshot(self) -> dict[str, int]:
        """The generations that were published together last."""
        if not (numbers := self._sets()):
            return {}
        raw = self.spark.read.text(f"{self.root}/{SETS}/s{max(numbers):08d}").first()
        return json.loads(raw.value)

    def changed(self, snapshot: dict[str, int]) -> bool:
        """Whether something was published since the snapshot was taken."""
        return self.snapshot() != snapshot

    def discard(self, name: str, generation: int) -> None:
        if generation in (self.published(name), self.snapshot().get(name)):
            raise ValueError("the published generation stays")
        fs, p = self._fs(f"{self.root}/{name}/g{generation:08d}")
        fs.delete(p, True)

    def prune(self, name: str, keep: int = 2) -> list[int]:
        """Drop published generations older than the last ``keep``; staged ones stay."""
        now = max(self.published(name) or 0, self.snapshot().get(name, 0))
        old = [g for g in self.generations(name) if g <= now][:-keep]
        for g in old:
            self.discard(name, g)
        return old

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        g = generation if generation is not None else self.published(name) or self.snapshot().get(name)
        if g is None:
            raise ValueError(f"{name} is not published")
        return self.spark.read.parquet(f"{self.root}/{name}/g{g:08d}")

    def names(self) -> list[str]:
        own = [n for n in self._list(self.root) if n != SETS and self.published(n) is not None]
        return sorted({*own, *self.snapshot()})

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def drop_sets(self) -> None:
        fs, p = self._fs(f"{self.root}/{SETS}")
        fs.delete(p, True)

    def fork(self, name: str, new: str) -> int:
        """Another table that begins with this one's published rows."""
        g = self.stage(new, self.read(name))
        self.publish(new, g)
        return g

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> int:
        g = self.stage(name, upserted(self.read(name), rows, key) if self.published(name) else rows)
        self.publish(name, g)
        return g


#: Fixed value: beginning of ids that mark the store's own rows.
RESERVED = "__"


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The old rows without those of the new keys, and one new row of each key.

    Of new rows of one key that of the largest ``_turn`` stays if there is such a
    column, and of what is still equal the one of largest hash, so that the same
    rows written twice, in whatever order, give the same table.
    """
    values = [c for c in new.columns if c != "_turn"]
    turn = F.col("_turn") if "_turn" in new.columns else F.lit(0)
    last = new.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(turn.alias("t"), F.xxhash64(*values).alias("h"))).alias("row_"))
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(last.select("row_.*"))


def deleted(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The old rows without those of the ids; the store's own rows cannot be deleted this way."""
    name = F.col(key).cast("string")
    ids = ids.filter(F.when(name.startswith(RESERVED), F.raise_error(F.concat(F.lit("reserved id: "), name))).otherwise(F.lit(True)))
    return old.join(ids.select(key), key, "left_anti")


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that only one store has, or whose columns differ."""
    hashed = lambda d, n: d.select(F.col(key), F.xxhash64(*columns).alias(n))
    both = hashed(a, "x").join(hashed(b, "y"), key, "full_outer")
    problem = F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").when(F.col("x") != F.col("y"), "differs")
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def now() -> str:
    return datetime.now(UTC).isoformat()
