"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmap.sources.store import use_checkpoints

__all__ = ["SLICE_BYTES", "WORD", "give_back", "slices", "spare", "table", "tokenizer_path", "use_checkpoints", "written"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that a worker turns into Python strings at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a compressed table in the shared folder, read back: like a checkpoint, for rows with texts."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have, whatever the case, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text; one longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(text))
        width = max(1, column.nbytes // batch.num_rows)
        step = max(1, limit // width)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    give_back()
