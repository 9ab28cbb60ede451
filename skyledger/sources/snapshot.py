"""Position snapshots: replaced as a whole, published atomically."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import geo
from skyledger.operators.silver import first_per_key
from skyledger.schemas import POSITION_COLUMNS, POSITION_SCHEMA
from skyledger.sources.published import new_run, newest_run, publish

STORED_SCHEMA = T.StructType(
    POSITION_SCHEMA.fields
    + [
        T.StructField(
            "geo_point",
            T.StructType(
                [T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]
            ),
        ),
        T.StructField("geo_curve", T.IntegerType()),
    ]
)


def with_geo_point(positions: DataFrame) -> DataFrame:
    """Point and place on the curve, always derived from the coordinates they stand for."""
    lat, lon = F.col("latitude_deg"), F.col("longitude_deg")
    return positions.select(
        *POSITION_COLUMNS,
        geo.geo_point(lat, lon).alias("geo_point"),
        geo.geo_curve(lat, lon).alias("geo_curve"),
    )


def write_snapshot(positions: DataFrame, root: str) -> int:
    """Replace the snapshot below `root`; returns the rows written.

    Rows go to a folder of their own and become visible with one small marker file, so a
    reader sees the old snapshot or the new one, never a mixture. If there are no rows the
    old snapshot stays. Rows are counted while they are written.

    Files are ranges of the curve and sorted along it, so a search around a place reads the row
    groups near it. The ranges come from a sample, for which `positions` is computed once more.
    """
    spark = positions.sparkSession
    run, written = new_run(), Observation()
    laid_out = with_geo_point(positions).repartitionByRange("geo_curve").sortWithinPartitions("geo_curve")
    laid_out.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{run}")
    if written.get["n"]:
        publish(spark, root, run)
    return written.get["n"]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot, empty if there is none."""
    _, run = newest_run(spark, root)
    if run is None:
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(f"{root}/{run}")


def upsert_positions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per (object, instant); fresh rows win over stored ones."""
    both = stored.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    return first_per_key(both, ["norad_cat_id", "snapshot_ts"], [F.col("_age")]).drop("_age")


def upsert_snapshot(fresh: DataFrame, root: str) -> int:
    """Put fresh positions into the stored snapshot; returns the rows it then has."""
    stored = read_snapshot(fresh.sparkSession, root).select(*POSITION_COLUMNS)
    return write_snapshot(upsert_positions(stored, fresh.select(*POSITION_COLUMNS)), root)


def latest_snapshot(positions: DataFrame) -> DataFrame:
    """Rows of the newest instant. Stored by instant, only its partition is read."""
    newest = positions.agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return positions.join(F.broadcast(newest), "snapshot_ts", "left_semi")
