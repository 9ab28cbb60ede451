"""Versions of a dataset that become visible with one small marker file, and keyed tables.

A writer puts rows into folders of their own and then appends a marker. A reader takes the newest
marker, so it sees the old version or the new one, never a mixture; an interrupted or refused
write leaves the old version readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.session import folders, path_exists

_MARKER = T.StructType(
    [T.StructField("sequence", T.LongType()), T.StructField("run", T.StringType())]
)


def new_run() -> str:
    return f"run={uuid.uuid4().hex}"


def newest_run(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Sequence number and folder of the published version."""
    if not path_exists(spark, f"{root}/_published"):
        return 0, None
    markers = spark.read.schema(_MARKER).json(f"{root}/_published")
    newest = markers.agg(F.max(F.struct("sequence", "run")).alias("m")).first()["m"]
    return (newest["sequence"], newest["run"]) if newest else (0, None)


def publish(spark: SparkSession, root: str, run: str) -> None:
    """Make a run the version that readers see."""
    sequence, _ = newest_run(spark, root)
    marker = spark.createDataFrame([(sequence + 1, run)], _MARKER)
    marker.coalesce(1).write.mode("append").json(f"{root}/_published")


class KeyedTable:
    """Rows in buckets by a hash of their key, kept up to date batch by batch.

    A bucket is a partition, and each of its versions a partition below it. A merge writes the next
    version of the buckets it touches, with dynamic overwrite; a reader takes the newest of each. A
    merge has to be idempotent, as deduplication is: then a batch that is replayed after a failure,
    with some of its buckets written and some not, leaves what it would have left at once.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str],
                 buckets: int):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, list(keys), buckets
        others = [n for n in folders(spark, root) if n.startswith("buckets=") and n != f"buckets={buckets}"]
        if others:
            raise ValueError(f"{root} is stored in {others[0].removeprefix('buckets=')} buckets, not {buckets}")
        self.root = f"{root}/buckets={buckets}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, buckets: Sequence[int]) -> dict[int, int]:
        """The newest version of each bucket that has any."""
        found = {}
        for b in buckets:
            versions = [int(n.removeprefix("version=")) for n in folders(self.spark, f"{self.root}/bucket={b}")
                        if n.startswith("version=")]
            if versions:
                found[b] = max(versions)
        return found

    def _read(self, newest: dict[int, int]) -> DataFrame:
        if not newest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            *[f"{self.root}/bucket={b}/version={v}" for b, v in newest.items()])

    def read(self) -> DataFrame:
        """All rows, empty if there are none."""
        return self._read(self._newest(range(self.buckets)))

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of the batch's keys by `combine(their stored rows, batch)`."""
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]
        newest = self._newest(touched)
        after = max(newest.values(), default=0) + 1
        merged = combine(self._read(newest), batch)
        merged.withColumns({"bucket": self._bucket(), "version": F.lit(after)}).write.partitionBy(
            "bucket", "version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.root)
