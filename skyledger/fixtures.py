"""Feed-shaped views over the driver tables.

The driver's star schema carries no orbital data, so the feeds are derived from it row by
row with exact arithmetic: `orders` become element-set landings, `customer` the object
catalogue, `nation` the observers and `events` tracks and elevation series. Every view
grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import configure

#: The instant every snapshot is computed for; never the wall clock.
SNAPSHOT = "2001-09-01T00:00:00Z"
#: Off the hundredths of a degree that `geo_points` stand on.
BERLIN = (52.5205, 13.4053, 0.0)
#: Added to the ids of objects that have element sets but no catalogue entry.
UNLISTED = 90_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_ts() -> Column:
    return F.lit(SNAPSHOT).cast("timestamp")


def _scaled(number: Column, step: str) -> Column:
    """An integer times a decimal step, as text with the step's scale."""
    scale = len(step.split(".")[1])
    return (
        number.cast("decimal(10,0)") * F.lit(step).cast(f"decimal({scale + 1},{scale})")
    ).cast("string")


def raw_gp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-set landings: every order in landing A, every third one again in landing B.

    Every 101st is of an object that the catalogue does not list.
    """
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    first = F.struct(F.lit("gp_a.csv").alias("source_file"), F.lit(2).alias("lag_hours"))
    again = F.struct(F.lit("gp_b.csv").alias("source_file"), F.lit(4).alias("lag_hours"))
    landings = F.explode(F.when(k % 3 == 0, F.array(first, again)).otherwise(F.array(first)))
    return (
        table(spark, sf_dir, "orders")
        .select(k, "o_custkey", at.alias("at"), landings.alias("landing"))
        .select(
            (F.col("at") + F.make_interval(hours=F.col("landing.lag_hours"))).alias("ingest_ts"),
            k.cast("string").alias("ingestion_id"),
            F.lit("feed").alias("source"),
            F.col("landing.source_file").alias("source_file"),
            F.lit("active").alias("target"),
            F.concat(F.lit("SAT "), (F.col("o_custkey") % 1000).cast("string")).alias("object_name"),
            F.concat(F.lit("1998-"), F.col("o_custkey").cast("string"), F.lit("A")).alias("object_id"),
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("epoch"),
            _scaled(100 + k % 1500, "0.01").alias("mean_motion"),
            _scaled(k % 1000, "0.0001").alias("eccentricity"),
            _scaled(k * 7 % 18000, "0.01").alias("inclination"),
            _scaled(k * 13 % 36000, "0.01").alias("ra_of_asc_node"),
            _scaled(k * 17 % 36000, "0.01").alias("arg_of_pericenter"),
            _scaled(k * 29 % 36000, "0.01").alias("mean_anomaly"),
            F.lit("0").alias("ephemeris_type"),
            F.lit("U").alias("classification_type"),
            (F.col("o_custkey") + F.when(k % 101 == 0, UNLISTED).otherwise(0)).cast("string").alias("norad_cat_id"),
            F.lit("999").alias("element_set_no"),
            (k % 90000).cast("string").alias("rev_at_epoch"),
            F.concat((k % 100).cast("string"), F.lit("e-06")).alias("bstar"),
            F.lit("1.4e-05").alias("mean_motion_dot"),
            F.lit("0").alias("mean_motion_ddot"),
        )
    )


# Catalogue attributes by market segment and nation key.
_TYPE_OF_SEGMENT = {
    "AUTOMOBILE": "PAY", "BUILDING": "R/B", "FURNITURE": "DEB", "HOUSEHOLD": "PAY",
    "MACHINERY": "UNK",
}
_SITES = ("AFETR", "TYMSC", "FRGUI", "JSC", "XXXXX", "SRILR", "PLMSC", "ZZZ")


def raw_satcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue landings: day 1, and day 2 in two files landed at the same instant."""
    k = F.col("c_custkey")
    second_day = F.col("landing.day") == 2
    gone = (F.col("c_acctbal") < 0) & second_day
    landing = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("source_file"), F.lit(d).alias("day"), F.lit(b).alias("bump"))
                for f, d, b in (
                    ("satcat_1.csv", 1, 0), ("satcat_2a.csv", 2, 1), ("satcat_2b.csv", 2, 2)
                )
            ]
        )
    )
    kind = F.lit("UNK")
    for segment, code in _TYPE_OF_SEGMENT.items():
        kind = F.when(F.col("c_mktsegment") == segment, code).otherwise(kind)
    site = F.lit(None).cast("string")
    for i, code in enumerate(_SITES):
        site = F.when(F.col("c_nationkey") % 9 == i, code).otherwise(site)
    apogee = F.when(k % 13 != 0, k * 97 % 60000)
    return (
        table(spark, sf_dir, "customer")
        .select(k, "c_nationkey", "c_acctbal", "c_mktsegment", landing.alias("landing"))
        .select(
            F.when(second_day, F.lit("2001-08-31T06:00:00Z"))
            .otherwise(F.lit("2001-08-30T06:00:00Z")).cast("timestamp").alias("ingest_ts"),
            F.concat(F.lit("cat-"), F.col("landing.source_file")).alias("ingestion_id"),
            F.lit("feed").alias("source"),
            F.col("landing.source_file").alias("source_file"),
            F.lit("catalogue").alias("target"),
            F.when(k % 40 != 3, F.concat(F.lit("Sat "), (k % 1000).cast("string")))
            .alias("object_name"),
            F.concat(F.lit("1998-"), k.cast("string"), F.lit("A")).alias("object_id"),
            k.cast("string").alias("norad_cat_id"),
            kind.alias("object_type"),
            F.when(gone, "D").otherwise("+").alias("ops_status_code"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("owner"),
            F.date_add(F.lit("1957-10-04").cast("date"), (k * 37 % 15000).cast("int"))
            .cast("string").alias("launch_date"),
            site.alias("launch_site"),
            F.when(gone, "2001-08-30").alias("decay_date"),
            F.when(k % 13 != 0, _scaled(9000 + k % 140000, "0.01")).alias("period"),
            F.when(k % 13 != 0, _scaled(k * 7 % 18000, "0.01")).alias("inclination"),
            apogee.cast("string").alias("apogee"),
            F.floor(apogee / 2).cast("string").alias("perigee"),
            F.when(k % 5 != 0, _scaled(k % 1000 + F.col("landing.bump"), "0.0001")).alias("rcs"),
            F.lit(None).cast("string").alias("data_status_code"),
            F.when(k % 50 == 0, "SU").when(k % 50 == 1, "25544")
            .when(k % 50 != 2, "EA").alias("orbit_center"),
            F.lit("ORB").alias("orbit_type"),
        )
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landing record per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ingested_at"),
        k.cast("string").alias("ingestion_id"),
        F.when(k % 2 == 0, "gp").otherwise("satcat").alias("source"),
        F.concat(F.lit("landing_"), k.cast("string"), F.lit(".csv")).alias("source_file"),
        F.col("o_orderpriority").alias("target"),
        F.floor("o_totalprice").cast("bigint").alias("bytes"),
        F.floor(k / 4).cast("string").alias("etag"),
    )


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observers from `nation`, with Berlin as number -1.

    They stand off the grid of `geo_points`, where an azimuth could be exactly north.
    """
    k = F.col("n_nationkey")
    here = table(spark, sf_dir, "nation").select(
        k.cast("int").alias("observer_id"),
        (k * 7 - 83.9965).alias("observer_latitude_deg"),
        (k * 14 - 169.9965).alias("observer_longitude_deg"),
        F.lit(0.0).alias("observer_altitude_km"),
    )
    return here.union(
        spark.range(1).select(F.lit(-1), *[F.lit(v) for v in BERLIN])
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodetic points from `orders`."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("point_id"),
        (k * 7 % 18000 / F.lit(100.0) - 90.0).alias("latitude_deg"),
        (k * 13 % 36000 / F.lit(100.0) - 180.0).alias("longitude_deg"),
        (400.0 + k % 35000).cast("double").alias("altitude_km"),
        F.col("o_orderdate").cast("timestamp").alias("seen_at"),
    )


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from `events`, one per user, in time order."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("norad_cat_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        e.alias("sample_idx"),
        ((e * 31 % 170) - 85).cast("double").alias("latitude_deg"),
        ((e * 53 % 360) - 180).cast("double").alias("longitude_deg"),
        (400 + e % 500).cast("double").alias("altitude_km"),
    )


def elevation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-angle series from `events`: per user and observer bucket."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("norad_cat_id"),
        (F.col("user_id") % 5).cast("int").alias("observer_id"),
        e.alias("sample_idx"),
        F.col("ts").cast("timestamp").alias("ts"),
        (e * 11 % 360).cast("double").alias("azimuth_deg"),
        ((e * 37 % 120) - 30).cast("double").alias("elevation_deg"),
    )


# The same views as DuckDB text: name -> (views it reads, SELECT).
_TYPE_CASE = " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in _TYPE_OF_SEGMENT.items())
_SITE_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SITES))

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_gp": ((), f"""
SELECT o_orderdate + to_hours(l.lag_hours) AS ingest_ts,
       cast(o_orderkey AS VARCHAR) AS ingestion_id, 'feed' AS source, l.source_file,
       'active' AS target,
       'SAT ' || cast(o_custkey % 1000 AS VARCHAR) AS object_name,
       '1998-' || cast(o_custkey AS VARCHAR) || 'A' AS object_id,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS epoch,
       cast(cast(100 + o_orderkey % 1500 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) AS mean_motion,
       cast(cast(o_orderkey % 1000 AS DECIMAL(10,0)) * 0.0001 AS VARCHAR) AS eccentricity,
       cast(cast(o_orderkey * 7 % 18000 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) AS inclination,
       cast(cast(o_orderkey * 13 % 36000 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) AS ra_of_asc_node,
       cast(cast(o_orderkey * 17 % 36000 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) AS arg_of_pericenter,
       cast(cast(o_orderkey * 29 % 36000 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) AS mean_anomaly,
       '0' AS ephemeris_type, 'U' AS classification_type,
       cast(o_custkey + CASE WHEN o_orderkey % 101 = 0 THEN {UNLISTED} ELSE 0 END AS VARCHAR) AS norad_cat_id,
       '999' AS element_set_no,
       cast(o_orderkey % 90000 AS VARCHAR) AS rev_at_epoch,
       cast(o_orderkey % 100 AS VARCHAR) || 'e-06' AS bstar,
       '1.4e-05' AS mean_motion_dot, '0' AS mean_motion_ddot
FROM orders JOIN (VALUES ('gp_a.csv', 2), ('gp_b.csv', 4)) AS l(source_file, lag_hours)
  ON l.source_file = 'gp_a.csv' OR o_orderkey % 3 = 0"""),
    "raw_satcat": ((), f"""
SELECT CASE WHEN l.day = 2 THEN TIMESTAMP '2001-08-31 06:00:00'
            ELSE TIMESTAMP '2001-08-30 06:00:00' END AS ingest_ts,
       'cat-' || l.source_file AS ingestion_id, 'feed' AS source, l.source_file,
       'catalogue' AS target,
       CASE WHEN c_custkey % 40 <> 3 THEN 'Sat ' || cast(c_custkey % 1000 AS VARCHAR) END AS object_name,
       '1998-' || cast(c_custkey AS VARCHAR) || 'A' AS object_id,
       cast(c_custkey AS VARCHAR) AS norad_cat_id,
       CASE c_mktsegment {_TYPE_CASE} ELSE 'UNK' END AS object_type,
       CASE WHEN c_acctbal < 0 AND l.day = 2 THEN 'D' ELSE '+' END AS ops_status_code,
       'N' || cast(c_nationkey AS VARCHAR) AS owner,
       cast(DATE '1957-10-04' + cast(c_custkey * 37 % 15000 AS INTEGER) AS VARCHAR) AS launch_date,
       CASE c_nationkey % 9 {_SITE_CASE} END AS launch_site,
       CASE WHEN c_acctbal < 0 AND l.day = 2 THEN '2001-08-30' END AS decay_date,
       CASE WHEN c_custkey % 13 <> 0 THEN
         cast(cast(9000 + c_custkey % 140000 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) END AS period,
       CASE WHEN c_custkey % 13 <> 0 THEN
         cast(cast(c_custkey * 7 % 18000 AS DECIMAL(10,0)) * 0.01 AS VARCHAR) END AS inclination,
       CASE WHEN c_custkey % 13 <> 0 THEN cast(c_custkey * 97 % 60000 AS VARCHAR) END AS apogee,
       CASE WHEN c_custkey % 13 <> 0 THEN cast(c_custkey * 97 % 60000 // 2 AS VARCHAR) END AS perigee,
       CASE WHEN c_custkey % 5 <> 0 THEN
         cast(cast(c_custkey % 1000 + l.bump AS DECIMAL(10,0)) * 0.0001 AS VARCHAR) END AS rcs,
       cast(NULL AS VARCHAR) AS data_status_code,
       CASE WHEN c_custkey % 50 = 0 THEN 'SU' WHEN c_custkey % 50 = 1 THEN '25544'
            WHEN c_custkey % 50 <> 2 THEN 'EA' END AS orbit_center,
       'ORB' AS orbit_type
FROM customer CROSS JOIN (VALUES ('satcat_1.csv', 1, 0), ('satcat_2a.csv', 2, 1),
                                 ('satcat_2b.csv', 2, 2)) AS l(source_file, day, bump)"""),
    "manifest": ((), """
SELECT o_orderdate AS ingested_at, cast(o_orderkey AS VARCHAR) AS ingestion_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'gp' ELSE 'satcat' END AS source,
       'landing_' || cast(o_orderkey AS VARCHAR) || '.csv' AS source_file,
       o_orderpriority AS target, cast(floor(o_totalprice) AS BIGINT) AS bytes,
       cast(o_orderkey // 4 AS VARCHAR) AS etag
FROM orders"""),
    "observers": ((), f"""
SELECT n_nationkey AS observer_id, n_nationkey * 7 - 83.9965e0 AS observer_latitude_deg,
       n_nationkey * 14 - 169.9965e0 AS observer_longitude_deg,
       cast(0 AS DOUBLE) AS observer_altitude_km
FROM nation
UNION ALL SELECT -1, cast({BERLIN[0]} AS DOUBLE), cast({BERLIN[1]} AS DOUBLE), cast({BERLIN[2]} AS DOUBLE)"""),
    "geo_points": ((), """
SELECT o_orderkey AS point_id, (o_orderkey * 7 % 18000) / 100.0::DOUBLE - 90.0::DOUBLE AS latitude_deg,
       (o_orderkey * 13 % 36000) / 100.0::DOUBLE - 180.0::DOUBLE AS longitude_deg,
       cast(400 + o_orderkey % 35000 AS DOUBLE) AS altitude_km, o_orderdate AS seen_at
FROM orders"""),
    "track_points": ((), """
SELECT cast(user_id AS INTEGER) AS norad_cat_id, ts, event_id AS sample_idx,
       cast((event_id * 31 % 170) - 85 AS DOUBLE) AS latitude_deg,
       cast((event_id * 53 % 360) - 180 AS DOUBLE) AS longitude_deg,
       cast(400 + event_id % 500 AS DOUBLE) AS altitude_km
FROM events"""),
    "elevation_series": ((), """
SELECT cast(user_id AS INTEGER) AS norad_cat_id, cast(user_id % 5 AS INTEGER) AS observer_id,
       event_id AS sample_idx, ts, cast(event_id * 11 % 360 AS DOUBLE) AS azimuth_deg,
       cast((event_id * 37 % 120) - 30 AS DOUBLE) AS elevation_deg
FROM events"""),
}
