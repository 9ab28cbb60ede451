"""The landing manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import ledger as ops
from skyledger.queries import base
from skyledger.queries.base import AT_SQL, query

ORDER = "ingested_at, source_file, ingestion_id"


@query("latest_landing_per_target", "manifest", f"""
SELECT target, ingested_at, ingestion_id, source, source_file, bytes, etag FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY ingested_at DESC, source_file DESC, ingestion_id DESC) AS rk
  FROM manifest) WHERE rk = 1""")
def latest_landing_per_target(spark, sf):
    return ops.latest_per_target(fx.manifest(spark, sf))


@query("cache_fresh", "manifest", f"""
SELECT source, target, max(ingested_at) AS ingested_at,
  (epoch_us({AT_SQL} - INTERVAL 30 DAY) - epoch_us(max(ingested_at))) / 1e6 AS age_seconds,
  (epoch_us({AT_SQL} - INTERVAL 30 DAY) - epoch_us(max(ingested_at))) / 1e6
     < CASE source WHEN 'gp' THEN 7200 ELSE 86400 END AS is_fresh
FROM manifest GROUP BY source, target""")
def cache_fresh(spark, sf):
    now = fx.snapshot_ts() - F.make_dt_interval(F.lit(30))
    return ops.cache_fresh(fx.manifest(spark, sf), now)


@query("daily_volume", "manifest", """
SELECT cast(cast(ingested_at AS DATE) AS VARCHAR) AS day, cast(sum(bytes) AS BIGINT) AS bytes, count(*) AS landings
FROM manifest GROUP BY 1""")
def daily_volume(spark, sf):
    return base.plain(ops.daily_volume(fx.manifest(spark, sf)))


@query("budget_breach", "manifest", f"""
SELECT ingestion_id, cast(day AS VARCHAR) AS day, cast(used - bytes AS BIGINT) AS used_before FROM (
  SELECT *, cast(ingested_at AS DATE) AS day, sum(bytes) OVER (
    PARTITION BY cast(ingested_at AS DATE) ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS used
  FROM manifest) WHERE used - bytes >= 600000""")
def budget_breach(spark, sf):
    return base.plain(
        ops.budget_breaches(fx.manifest(spark, sf), 600_000).select(
            "ingestion_id", "day", "used_before"
        )
    )


@query("unchanged_payload", "manifest", f"""
SELECT target, ingestion_id, etag FROM (
  SELECT *, lag(etag) OVER (PARTITION BY target ORDER BY {ORDER}) AS before FROM manifest)
WHERE before = etag""")
def unchanged_payload(spark, sf):
    # Etags of neighbouring landings rarely agree here; coarser ones do.
    coarse = fx.manifest(spark, sf).withColumn(
        "etag", F.floor(F.col("ingestion_id").cast("long") / 4).cast("string")
    )
    return ops.unchanged_payloads(coarse).select("target", "ingestion_id", "etag")


@query("empty_landings", "manifest", """
SELECT ingestion_id, source_file FROM manifest WHERE source_file NOT IN (
  SELECT 'landing_' || cast(l_orderkey AS VARCHAR) || '.csv' FROM lineitem)""")
def empty_landings(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("landing_"), F.col("l_orderkey").cast("string"), F.lit(".csv"))
        .alias("source_file")
    )
    return ops.empty_landings(fx.manifest(spark, sf), rows).select("ingestion_id", "source_file")
