"""Freshness over the events table, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.plans.inputs import table
from quillmap.plans.registry import query
from quillmap.streaming import freshness


@query("""WITH w AS (SELECT user_id AS root, count(*) AS epoch, max(epoch_us(ts)) AS last, count(*) FILTER (ts <= TIMESTAMP '2024-01-25 00:00:00') AS covered, max(epoch_us(ts)) FILTER (event_type = 'purchase') AS checkpoint FROM events GROUP BY user_id)
SELECT root, CASE WHEN root % 13 = 1 THEN 'reconciled_ignore_change' WHEN root % 7 = 2 THEN 'coalesced' WHEN checkpoint IS NULL THEN 'skipped_source_checkpoint_unavailable' WHEN root % 5 = 3 AND epoch <= covered THEN 'skipped_source_unchanged'
  WHEN epoch <= covered AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - checkpoint < 864000000000 THEN 'skipped_recent' ELSE 'synced' END AS decision, epoch - covered AS pending FROM w""")  # fmt: skip
def m3_ensure_freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    cut, now = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("2024-01-25 00:00:00", "2024-01-31 00:00:00"))
    roots = e.groupBy(F.col("user_id").alias("root")).agg(F.count("*").alias("epoch"), F.sum((F.col("at") <= cut).cast("long")).alias("covered"), F.max(F.when(F.col("event_type") == "purchase", F.col("at"))).alias("checkpoint"))
    roots = roots.withColumn("ignore_changed", F.col("root") % 13 == 1).withColumn("active", F.col("root") % 7 == 2).withColumn("unchanged", F.col("root") % 5 == 3)
    return freshness.decide(roots, now, threshold_ms=10 * 86_400_000).select("root", "decision", (F.col("epoch") - F.col("covered")).alias("pending"))


@query("""WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, event_id FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id AS root, burst::BIGINT AS burst, count(*) AS n, min(epoch_us(ts)) AS begin, max(epoch_us(ts)) AS finish FROM s GROUP BY ALL""")  # fmt: skip
def m1_debounced_bursts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return freshness.bursts(e, 7_200_000_000)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events), s AS (SELECT user_id, max(epoch) AS covered FROM e WHERE event_type = 'view' GROUP BY user_id)
SELECT e.user_id AS root, count(*) FILTER (epoch > coalesce(covered, 0)) AS pending, max(epoch) AS epoch FROM e LEFT JOIN s USING (user_id) GROUP BY e.user_id""")  # fmt: skip
def m2_epoch_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.col("ts").alias("at"), "event_id", "event_type")
    return freshness.epochs(e.drop("event_type"), e.filter("event_type = 'view'").drop("event_type"))


@query("SELECT user_id AS root, bool_and(event_type IN ('view', 'click')) AS ignore_only FROM events GROUP BY user_id")
def m11_reindex_preflight(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("root")).agg(F.every(F.col("event_type").isin("view", "click")).alias("ignore_only"))
