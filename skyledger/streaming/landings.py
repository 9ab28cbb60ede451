"""Incremental ingest with Structured Streaming.

Landed files and their sidecars are two streams, paired by the file's name: what comes first waits
in the state for the other, so a sidecar may be late, or early. Only names and records are in the
state; rows are read once their file is attributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from skyledger.operators.silver import dedup_earliest, with_validity
from skyledger.schemas import MANIFEST_SCHEMA, Feed
from skyledger.session import configure
from skyledger.sources import landing
from skyledger.sources.bronze import load_insert_if_absent
from skyledger.sources.published import KeyedTable

#: Buckets of a keyed table by default; a large table wants more of them, so that a bucket stays
#: around a gigabyte.
ID_BUCKETS = 64


def stream_bronze(spark: SparkSession, root: str, feed: Feed) -> DataFrame:
    """New bronze files as a stream, each file once."""
    return configure(spark).readStream.schema(feed.schema).parquet(root)


def _each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda batch, _: work(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_PAIR = "source_file string, path string, record string"


def stream_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, path, record): landed CSV files with their sidecar's record as JSON text.

    A file, or a part of one, is put out once. A sidecar that cannot be read leaves its file waiting.
    """

    def paired(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A landed file's new paths with its record, once that is there. Later copies of either are ignored."""
        waiting, known, record = state.get if state.exists else ([], [], None)
        waiting, known = list(waiting), set(known)
        for part in parts:
            fresh = [p for p in dict.fromkeys(part["path"].dropna()) if p not in known]
            waiting, known = waiting + fresh, known.union(fresh)
            record = record or next(iter(part["record"].dropna()), None)
        if waiting and record:
            yield pd.DataFrame({"source_file": key[0], "path": waiting, "record": record})
            waiting = []
        state.update((waiting, sorted(known), record))

    configure(spark)
    # Only the path is read; a stream wants the whole schema of the source.
    listed = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv")
    files = listed.load(landing.landed_below(folder)).select(
        landing.file_name(F.col("path")).alias("source_file"), "path", F.lit(None).cast("string").alias("record"))
    records = spark.readStream.schema(MANIFEST_SCHEMA).options(
        multiLine="true", mode="PERMISSIVE", pathGlobFilter="*.meta.json").json(folder)
    whole = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    sidecars = records.where("source_file IS NOT NULL AND ingested_at IS NOT NULL").select(
        "source_file", F.lit(None).cast("string").alias("path"), whole.alias("record"))
    return files.unionByName(sidecars).groupBy("source_file").applyInPandasWithState(
        paired, _PAIR, "waiting array<string>, known array<string>, record string", "append", GroupStateTimeout.NoTimeout)


def load_pairs(pairs: DataFrame, table: str, feed: Feed) -> int:
    """Read the files of a batch of pairs, attribute their rows and load them."""
    spark = pairs.sparkSession
    pairs = pairs.persist()  # else the state is consulted once for each use
    listed = [r["path"] for r in pairs.select("path").collect()]  # the files of one micro-batch
    if not listed:
        return 0
    manifest = pairs.select(F.from_json("record", MANIFEST_SCHEMA).alias("r")).distinct().select("r.*").withColumn(
        "ingested_at", F.col("ingested_at").cast("timestamp"))
    rows = landing.attach_lineage(landing.scan_landing_csv(spark, listed, feed), manifest, feed)
    loaded = load_insert_if_absent(rows.select(*feed.columns), table, feed)
    pairs.unpersist()
    return loaded


def stream_land(spark: SparkSession, folder: str, table: str, feed: Feed, checkpoint: str) -> StreamingQuery:
    """Load landed CSV files as they come, each with its sidecar.

    A replayed micro-batch finds its own rows in the table and adds nothing.
    """
    return _each_batch(stream_pairs(spark, folder), checkpoint, lambda pairs: load_pairs(pairs, table, feed))


def stream_load(stream: DataFrame, table: str, feed: Feed, checkpoint: str) -> StreamingQuery:
    """Load a stream of bronze rows into a table, skipping keys it already holds.

    A micro-batch that is replayed after a failure finds its own rows in the table and adds
    nothing, so the load is exactly-once by key.
    """
    return _each_batch(
        stream, checkpoint,
        lambda batch: load_insert_if_absent(batch.select(*feed.columns), table, feed),
    )


def first_seen_table(
    spark: SparkSession, schema: StructType, table: str, *, buckets: int = ID_BUCKETS
) -> KeyedTable:
    """The earliest landing of each (object, epoch), kept by `stream_first_seen`."""
    return KeyedTable(spark, table, schema, ["norad_cat_id", "epoch"], buckets)


def stream_first_seen(
    stream: DataFrame, table: str, checkpoint: str, *, buckets: int = ID_BUCKETS
) -> StreamingQuery:
    """Keep the earliest landing of each (object, epoch), however late it arrives.

    Rows of a batch and stored rows of the same buckets go through one deduplication. It keeps
    the least row by time of ingestion, so neither the order of batches nor a replay matters.
    """

    def merge(batch: DataFrame) -> None:
        kept = first_seen_table(batch.sparkSession, batch.schema, table, buckets=buckets)
        kept.merge(batch, lambda stored, new: dedup_earliest(stored.unionByName(new)))

    return _each_batch(stream, checkpoint, merge)


def interval_table(
    spark: SparkSession, schema: StructType, table: str, *, buckets: int = ID_BUCKETS
) -> KeyedTable:
    """Validity intervals of staged rows of a schema, kept by `stream_rebuild`."""
    tiled = with_validity(spark.createDataFrame([], schema)).schema
    return KeyedTable(spark, table, tiled, ["norad_cat_id"], buckets)


def rebuild_touched(batch: DataFrame, table: str, *, buckets: int = ID_BUCKETS) -> None:
    """Merge new element sets into an interval table by rebuilding what they touch.

    A new epoch changes the interval before it, so the whole history of a touched object is
    tiled again. Only the buckets of touched objects are read and written.
    """
    kept = interval_table(batch.sparkSession, batch.schema, table, buckets=buckets)
    kept.merge(batch, lambda stored, new: with_validity(
        dedup_earliest(stored.select(*new.columns).unionByName(new))))


def stream_rebuild(
    stream: DataFrame, table: str, checkpoint: str, *, buckets: int = ID_BUCKETS
) -> StreamingQuery:
    """Keep an interval table up to date with a stream of staged element sets."""
    return _each_batch(stream, checkpoint, lambda batch: rebuild_touched(batch, table, buckets=buckets))
