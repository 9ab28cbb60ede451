"""Questions about what was landed: the manifest as a table instead of a mutable file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ordered import OrderedGroups
from skyledger.schemas import DAILY_BYTE_BUDGET, FEED_TTL_SECONDS


def latest_per_target(manifest: DataFrame) -> DataFrame:
    """The newest landing of each target. Partial maxima keep few targets from being a hot spot."""
    rest = [c for c in manifest.columns if c != "target"]
    newest = F.max_by(F.struct(*rest), F.struct("ingested_at", "source_file", "ingestion_id"))
    return manifest.groupBy("target").agg(newest.alias("n")).select("target", "n.*")


def cache_fresh(manifest: DataFrame, now: Column) -> DataFrame:
    """Is the newest landing of each (feed, target) younger than the feed's time to live?"""
    ttl = F.create_map(*[F.lit(x) for kv in FEED_TTL_SECONDS.items() for x in kv])
    newest = manifest.groupBy("source", "target").agg(F.max("ingested_at").alias("ingested_at"))
    age = (F.unix_micros(now) - F.unix_micros("ingested_at")) / F.lit(1e6)
    return newest.select(
        "source", "target", "ingested_at",
        age.alias("age_seconds"),
        (age < F.try_element_at(ttl, F.col("source"))).alias("is_fresh"),
    )


def daily_volume(manifest: DataFrame) -> DataFrame:
    """Bytes landed per UTC day."""
    return manifest.groupBy(F.to_date("ingested_at").alias("day")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("landings")
    )


def budget_breaches(manifest: DataFrame, budget: int = DAILY_BYTE_BUDGET) -> DataFrame:
    """Landings fetched although the day's earlier ones had already used up the budget."""
    days = manifest.withColumn("day", F.to_date("ingested_at"))
    groups = OrderedGroups(
        days, ["day"], ["ingested_at", "source_file", "ingestion_id"]
    ).running_sums({"used": F.col("bytes")})
    return (
        groups.result()
        .withColumn("used_before", F.col("used") - F.col("bytes"))
        .where(F.col("used_before") >= budget)
        .drop("used")
    )


def unchanged_payloads(manifest: DataFrame) -> DataFrame:
    """Landings whose etag equals that of the landing before, per target."""
    groups = OrderedGroups(
        manifest, ["target"], ["ingested_at", "source_file", "ingestion_id"]
    ).neighbours(previous={"previous_etag": "etag"})
    return groups.result().where(F.col("previous_etag") == F.col("etag"))


def empty_landings(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest records without a single payload row. `rows` needs `source_file` only."""
    return manifest.join(rows.select("source_file").distinct(), "source_file", "left_anti")


def require_no_empty_landings(manifest: DataFrame, rows: DataFrame) -> None:
    """Fail if a landing carries no rows."""
    empty = [r.source_file for r in empty_landings(manifest, rows).select("source_file").take(5)]
    if empty:
        raise ValueError(f"landings without rows: {empty}")
