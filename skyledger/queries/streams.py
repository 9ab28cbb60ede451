"""Structured Streaming, driven to completion over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import silver
from skyledger.queries.base import gp_plain, plain, query
from skyledger.queries.storage import _LOADED, _SNAPSHOT, _landing, _recorded, _snapshots
from skyledger.schemas import GP
from skyledger.session import scratch_path
from skyledger.sources.bronze import scan_bronze
from skyledger.streaming import landings


@query("stream_landings", "raw_gp", _LOADED)
def stream_landings(spark, sf):
    root, table = scratch_path(spark, "stream-bronze"), scratch_path(spark, "stream-table")
    rows = fx.raw_gp(spark, sf).select(*GP.columns)
    checkpoint = scratch_path(spark, "stream-state")
    for name in ("gp_a.csv", "gp_b.csv"):
        rows.where(F.col("source_file") == name).write.mode("append").parquet(root)
        stream = landings.stream_bronze(spark, root, GP)
        landings.stream_load(stream, table, GP, checkpoint).awaitTermination()
    return scan_bronze(spark, table, GP)


@query("stream_land", "raw_gp", _recorded(", ".join(GP.payload), _SNAPSHOT))
def stream_land(spark, sf):
    """CSV files and sidecars as streams; the second file's sidecar comes a batch late."""
    folder, table = _landing(spark, _snapshots(spark, sf), GP.payload), scratch_path(spark, "land-table")
    checkpoint, hadoop = scratch_path(spark, "land-state"), spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    late, away = hadoop.Path(f"{folder}/gp_b.csv.meta.json"), hadoop.Path(f"{folder}-late.json")
    store.rename(late, away)
    landings.stream_land(spark, folder, table, GP, checkpoint).awaitTermination()
    store.rename(away, late)
    landings.stream_land(spark, folder, table, GP, checkpoint).awaitTermination()
    return scan_bronze(spark, table, GP)


@query("stream_dedup_first_seen", "elset_first", f"SELECT * REPLACE ({gp_plain()}) FROM elset_first")
def stream_dedup_first_seen(spark, sf):
    """Three batches, the newest landings first."""
    root, table = scratch_path(spark, "dedup-in"), scratch_path(spark, "dedup-table")
    rows = fx.raw_gp(spark, sf).select(*GP.columns)
    checkpoint = scratch_path(spark, "dedup-state")
    third = F.pmod(F.xxhash64("epoch"), F.lit(2))
    late = F.col("source_file") == "gp_b.csv"
    for part in (late, ~late & (third == 0), ~late & (third == 1)):
        rows.where(part).write.mode("append").parquet(root)
        staged = silver.stage_gp(landings.stream_bronze(spark, root, GP))
        landings.stream_first_seen(staged, table, checkpoint).awaitTermination()
    return plain(landings.first_seen_table(spark, staged.schema, table).read())


@query("touched_keys_rebuild", "elset", "SELECT norad_cat_id, epoch, valid_to, is_current FROM elset")
def touched_keys_rebuild(spark, sf):
    root, table = scratch_path(spark, "rebuild-in"), scratch_path(spark, "rebuild-table")
    rows = fx.raw_gp(spark, sf).select(*GP.columns)
    checkpoint = scratch_path(spark, "rebuild-state")
    # The later half of the epochs arrives first: late rows re-tile what is there.
    for late in (False, True):
        part = F.col("epoch") < "1998-06-01"
        rows.where(part if late else ~part).write.mode("append").parquet(root)
        staged = silver.stage_gp(landings.stream_bronze(spark, root, GP))
        landings.stream_rebuild(staged, table, checkpoint).awaitTermination()
    kept = landings.interval_table(spark, staged.schema, table).read()
    return kept.select("norad_cat_id", "epoch", "valid_to", "is_current")
