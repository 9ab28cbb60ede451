"""Bronze: landed rows as partitioned Parquet, and the idempotent load."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.ledger import require_no_empty_landings
from skyledger.operators.silver import first_per_key
from skyledger.schemas import PARTITION_COLUMNS, Feed
from skyledger.session import configure, folders, path_exists
from skyledger.sources import landing


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet dataset under a declared schema; empty where nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return configure(spark).read.schema(schema).parquet(path)


def write_bronze(rows: DataFrame, root: str) -> str:
    """Write rows of `attach_lineage` under `ingest_date=/hour=/ingestion_id=`.

    A repeated write replaces the partitions of its own ingestions and no others, which is
    why the ingestion is part of the layout. No shuffle: a scan task reads one landing
    file, so it writes to one partition.
    """
    configure(rows.sparkSession)
    rows.write.partitionBy(*PARTITION_COLUMNS).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(root)
    return root


def land_to_bronze(
    spark: SparkSession, path: str, feed: Feed, root: str, *, null_tokens: tuple[str, ...] = ()
) -> str:
    """Convert every landed CSV of a feed, in one job."""
    configure(spark)
    manifest = landing.scan_manifest(spark, path, mode="PERMISSIVE")
    landing.require_sidecars(spark, path, manifest)
    landing.require_payload(spark, path)
    rows = landing.scan_landing_csv(spark, path, feed, null_tokens=null_tokens)
    require_no_empty_landings(manifest, rows)
    return write_bronze(landing.attach_lineage(rows, manifest, feed), root)


def scan_bronze(
    spark: SparkSession, root: str, feed: Feed, *, source_file: str | None = None
) -> DataFrame:
    """Bronze rows in the feed's column order, optionally of one landing file."""
    rows = read_or_empty(spark, root, feed.schema).select(*feed.columns)
    return rows if source_file is None else rows.where(F.col("source_file") == source_file)


def new_rows(batch: DataFrame, target: DataFrame, feed: Feed) -> DataFrame:
    """Rows of a batch whose key the target does not hold, one per key.

    Copies within the batch are removed first, one survivor per map task, so neither side
    of the join has repeated keys. Only keys of the batch's landing files are looked at.
    """
    files = batch.select("source_file").distinct()
    known = target.select(*feed.key).join(files, "source_file", "left_semi")
    ranked = [F.col("ingest_ts").asc_nulls_last(), F.col("ingestion_id").asc_nulls_last()]
    ranked.append(F.xxhash64(*feed.payload))
    unique = first_per_key(batch, list(feed.key), ranked)
    return unique.join(known, list(feed.key), "left_anti").select(*feed.columns)


#: Which landing files each load of a table has rows of; hidden from readers of the table.
_SUMMARY = "_landings"
_SUMMARY_SCHEMA = "loaded string, source_file string"


def _loads(spark: SparkSession, table: str) -> set[str]:
    """Loads that a table holds, from the names of its folders."""
    return {n.removeprefix("loaded=") for n in folders(spark, table) if n.startswith("loaded=")}


def loads_in_question(batch: DataFrame, table: str) -> list[str]:
    """Loads of a table that may hold a key of the batch.

    A key names its landing file, so only loads with rows of the batch's landing files count. Each
    load has written down its files; one that was interrupted before it could is in question too.
    """
    spark = batch.sparkSession
    held = _loads(spark, table)
    if not held or not path_exists(spark, f"{table}/{_SUMMARY}"):
        return sorted(held)
    known = spark.read.schema(_SUMMARY_SCHEMA).json(f"{table}/{_SUMMARY}")
    files = batch.select("source_file").distinct()
    marked = known.join(files.withColumn("_here", F.lit(True)), "source_file", "left").groupBy("loaded").agg(
        F.coalesce(F.bool_or("_here"), F.lit(False)).alias("here"))
    marks = {r["loaded"]: r["here"] for r in marked.collect()}  # one row for each load
    return sorted(load for load in held if marks.get(load, True))


def load_insert_if_absent(batch: DataFrame, table: str, feed: Feed) -> int:
    """Append the rows whose key is not in the table yet; returns how many there were.

    Every load has a folder of its own. Of the table only the loads that have rows of the batch's
    landing files are read, so a load costs what it brings, however large the table is.
    """
    spark = batch.sparkSession
    in_question = [f"{table}/loaded={load}" for load in loads_in_question(batch, table)]
    if in_question:
        target = configure(spark).read.schema(feed.schema).parquet(*in_question)
    else:
        target = spark.createDataFrame([], feed.schema)
    load, inserted = uuid.uuid4().hex, Observation()
    # Names of landing files: the scan of the batch has listed them on the driver already.
    counted = new_rows(batch, target, feed).observe(
        inserted, F.count(F.lit(1)).alias("n"), F.collect_set("source_file").alias("files"))
    counted.write.parquet(f"{table}/loaded={load}")
    rows = [(load, name) for name in inserted.get["files"]] or [(load, None)]
    spark.createDataFrame(rows, _SUMMARY_SCHEMA).coalesce(1).write.mode("append").json(f"{table}/{_SUMMARY}")
    return inserted.get["n"]


def load_all(
    spark: SparkSession,
    feeds: Mapping[Feed, tuple[str | None, str, str]],
    *,
    source_file: str | None = None,
) -> dict[str, int]:
    """Convert and load feeds given as (landing folder, bronze root, table).

    Without a landing folder, or where nothing has landed yet, the conversion is skipped and
    existing bronze rows are loaded.
    """
    loaded = {}
    for feed, (path, root, table) in feeds.items():
        if path is not None and path_exists(spark, path):
            land_to_bronze(spark, path, feed, root)
        batch = scan_bronze(spark, root, feed, source_file=source_file)
        loaded[feed.name] = load_insert_if_absent(batch, table, feed)
    return loaded
