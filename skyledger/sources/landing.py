"""Landed CSV files and their JSON sidecars.

A landing is one CSV file, or a folder named like one that holds its parts, as Spark writes them
(`gp_a.csv/part-*.csv`), so that no task has to write or hold a whole landing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.schemas import GP_PAYLOAD, LINEAGE_COLUMNS, MANIFEST_SCHEMA, Feed


class MissingSidecarError(RuntimeError):
    """A landed file has no readable audit record, so its rows cannot be attributed."""


def file_name(path) -> F.Column:
    """Name of the landing a path belongs to, without percent-encoding: the last segment, or of a
    part the folder."""
    part = F.regexp_extract(path, r"([^/]+\.csv)/part-[^/]*$", 1)
    return F.url_decode(F.when(part != "", part).otherwise(F.element_at(F.split(path, "/"), -1)))


def landed_below(folder: str) -> str:
    """Glob of the landings in a folder, files or folders of parts."""
    return f"{folder}/*.csv"


def scan_landing_csv(
    spark: SparkSession, path: str | list[str], feed: Feed, *, null_tokens: tuple[str, ...] = ()
) -> DataFrame:
    """All landed CSV files below a folder, or those listed; every column text, empty fields NULL.

    Every file, and every part of one, is read by its own header line: the line is found among the
    file's rows and joined to them by the file's path. `null_tokens` lists further texts to read as NULL.
    """
    options = {"pathGlobFilter": "*.csv"}
    path = landed_below(path) if isinstance(path, str) else path
    first = spark.read.options(**options, header="true").csv(path).columns
    unknown = {c.lower() for c in first} ^ set(feed.payload)
    if unknown:
        raise ValueError(f"feed {feed.name}: unexpected or missing columns {sorted(unknown)}")
    cells = [f"_c{i}" for i in range(len(feed.payload))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    lines = spark.read.options(**options, mode="FAILFAST").schema(schema).csv(path).select(
        F.col("_metadata.file_path").alias("_file"), F.array(*cells).alias("_cells"))
    names = F.transform("_cells", F.lower)
    is_header = F.coalesce(
        F.array_sort(names) == F.array(*map(F.lit, sorted(feed.payload))), F.lit(False))
    # The place of every column in the file, once for each file.
    places = F.array(*[F.array_position(names, c).cast("int") for c in feed.payload])
    headers = lines.where(is_header).select("_file", places.alias("_places")).distinct().withColumn(
        "source_file", file_name(F.col("_file")))
    bare = F.raise_error(F.concat(F.lit("no header in "), file_name(F.col("_file"))))
    known = F.when(F.col("_places").isNull(), bare).otherwise(F.col("_places"))
    named = (
        lines.where(~is_header).join(headers, "_file", "left")
        .select("source_file", "_cells", known.alias("_places"))
        .select("source_file", *[
            F.element_at("_cells", F.col("_places")[i]).alias(c) for i, c in enumerate(feed.payload)])
    )
    if null_tokens:
        named = named.withColumns(
            {c: F.when(~F.col(c).isin(*null_tokens), F.col(c)) for c in feed.payload}
        )
    return named.select("source_file", *feed.payload)


def scan_manifest(
    spark: SparkSession, path: str, *, mode: str = "FAILFAST", compacted: bool = False
) -> DataFrame:
    """Audit records below a folder: one sidecar per landed file, or compacted into logs of
    one record per line, which spares a job over millions of landings as many tiny files.

    A malformed record fails the job, or with `mode="PERMISSIVE"` becomes one of NULLs that
    belongs to no file.
    """
    layout = {} if compacted else {"multiLine": "true", "pathGlobFilter": "*.meta.json"}
    raw = spark.read.schema(MANIFEST_SCHEMA).options(mode=mode, **layout).json(path)
    return raw.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def landed_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Names of the landed files, one for each part, without reading their content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(landed_below(path))
        .select(file_name(F.col("path")).alias("source_file"))
    )


def require_sidecars(spark: SparkSession, path: str, manifest: DataFrame) -> None:
    """Fail if a landed file has no sidecar, or one that could not be read."""
    attributed = manifest.where(F.col("ingested_at").isNotNull()).select("source_file")
    bare = landed_files(spark, path).join(attributed, "source_file", "left_anti").take(5)
    if bare:
        raise MissingSidecarError(f"no readable sidecar for {[row.source_file for row in bare]}")


#: Fixed value: what the feed answers when it has nothing to give.
NO_DATA = "No GP data found"


def require_payload(spark: SparkSession, path: str) -> None:
    """Fail if a landed file holds the feed's message instead of rows."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(landed_below(path))
    empty = lines.where(F.trim("value").startswith(NO_DATA)).select(
        file_name(F.col("_metadata.file_path")).alias("source_file")).take(5)
    if empty:
        raise ValueError(f"landings without data: {[row.source_file for row in empty]}")


def attach_lineage(rows: DataFrame, manifest: DataFrame, feed: Feed) -> DataFrame:
    """Lineage columns in front, and the partition columns derived from `ingested_at`.

    One manifest record belongs to one file. Adaptive execution broadcasts a small manifest and
    splits very large files otherwise.
    """
    audit = manifest.select(
        F.col("ingested_at").alias("ingest_ts"), *[c for c in LINEAGE_COLUMNS if c != "ingest_ts"]
    )
    joined = rows.join(audit, "source_file")
    return joined.select(
        *feed.columns,
        F.date_format("ingest_ts", "yyyy-MM-dd").alias("ingest_date"),
        F.date_format("ingest_ts", "HH").alias("hour"),
    )


def to_omm(elsets: DataFrame) -> DataFrame:
    """Element sets under their exchange-format names, every value as text."""
    exported = []
    for name in GP_PAYLOAD:
        value = (
            F.date_format("epoch", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if name == "epoch"
            else F.col(name).cast("string")
        )
        exported.append(value.alias(name.upper()))
    return elsets.select(*exported)
