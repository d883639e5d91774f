"""Keeping an index fresh: decisions, bursts of events, and streams of changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Fixed value: milliseconds under which a checkpoint counts as recent.
THRESHOLD_MS = 60_000


#: Decisions in order of precedence, each with the sign that leads to it.
DECISIONS = (
    ("ignore_changed", "reconciled_ignore_change"),
    ("active", "coalesced"),
    ("missing", "skipped_source_checkpoint_unavailable"),
    ("unchanged", "skipped_source_unchanged"),
    ("recent", "skipped_recent"),
)


def decide(roots: DataFrame, now: Column, threshold_ms: int = THRESHOLD_MS) -> DataFrame:
    """What to do for each root: epoch (events so far), covered (of the last sync), checkpoint (its time in microseconds, null if none).

    Boolean columns, if there are any, say that only ignore rules changed
    (``ignore_changed``), that a sync is under way (``active``) and that the
    source is as it was (``unchanged``). An event that no sync covers forces a
    sync whatever the age.
    """
    pending = F.col("epoch") > F.col("covered")
    said = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in roots.columns else F.lit(False)
    signs = {
        "ignore_changed": said("ignore_changed"),
        "active": said("active"),
        "missing": F.col("checkpoint").isNull(),
        "unchanged": said("unchanged") & ~pending,
        "recent": (now - F.col("checkpoint") < threshold_ms * 1000) & ~pending,
    }
    decision = F.lit("synced")
    for sign, name in reversed(DECISIONS):
        decision = F.when(signs[sign], name).otherwise(decision)
    return roots.withColumn("decision", decision)


def epochs(events: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, pending, epoch) of finished batches: events (root, at, event_id) count up, and a sync covers those before its last start (root, at, event_id)."""
    order = Window.partitionBy("root").orderBy("at", "event_id")
    rows = events.withColumn("epoch", F.row_number().over(order))
    covered = starts.join(rows, ["root", "at", "event_id"]).groupBy("root").agg(F.max("epoch").alias("covered"))
    joined = rows.join(covered, "root", "left")
    return joined.groupBy("root").agg(F.sum((F.col("epoch") > F.coalesce("covered", F.lit(0))).cast("long")).alias("pending"), F.max("epoch").cast("long").alias("epoch"))


def bursts(events: DataFrame, gap_us: int) -> DataFrame:
    """Events (root, at, event_id) of a root that follow each other within the gap, as one row."""
    order = Window.partitionBy("root").orderBy("at", "event_id")
    new = (F.col("at") - F.lag("at").over(order)) > gap_us
    numbered = events.withColumn("burst", F.sum(F.coalesce(new, F.lit(True)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("root", "burst").agg(F.count("*").alias("n"), F.min("at").alias("begin"), F.max("at").alias("finish"))


def coverage(events: DataFrame) -> DataFrame:
    """A stream of (root, kind, epoch): ``event`` rows raise the root's epoch, ``begin`` notes it, ``end`` covers what was noted.

    Events between a sync's begin and its end stay pending. The frame is a
    stream of (root string, seq long, kind string).
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, noted, covered = state.get if state.exists else (0, 0, 0)
        for part in parts:
            for kind in part.sort_values("seq")["kind"]:
                if kind == "event":
                    epoch += 1
                elif kind == "begin":
                    noted = epoch
                elif kind == "end":
                    covered = max(covered, noted)
        state.update((epoch, noted, covered))
        yield pd.DataFrame({"root": [key[0]], "epoch": [epoch], "covered": [covered], "pending": [epoch - covered]})

    return events.groupBy("root").applyInPandasWithState(fold, "root string, epoch long, covered long, pending long", "epoch long, noted long, covered long", "update", GroupStateTimeout.NoTimeout)


def on_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` on each micro-batch of changes; a batch that is tried again has the same number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
