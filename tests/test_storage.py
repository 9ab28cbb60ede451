import json
from pathlib import Path

import pytest
from support import ISS_EPOCH, SF, same_rows
from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import spatial
from skyledger.operators.checks import CheckFailure
from skyledger.operators.propagate import propagate, propagate_grid
from skyledger.plans import warehouse
from skyledger.queries.storage import _landing
from skyledger.schemas import GP, POSITION_COLUMNS, POSITION_SCHEMA
from skyledger.sources import bronze, landing, snapshot
from skyledger.sources.published import KeyedTable

HEADER = ",".join(c.upper() for c in GP.payload)
ROWS = [
    "STARLINK-1,2019-074A,2026-08-07T10:00:00.123456,15.05,0.0001,53.05,10,20,30,0,U,100001,999,100,1.4e-05,1e-05,0",
    "STARLINK-2,,2026-08-07T11:00:00.000000,15.06,0.0002,53.06,11,21,31,0,U,100002,999,101,NA,1e-05,0",
]


def land(folder: Path, name: str, ingestion: str, at="2026-08-07T20:17:37.187277+00:00", rows=ROWS):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes("\r\n".join([HEADER, *rows, ""]).encode())
    (folder / f"{name}.meta.json").write_text(json.dumps({
        "ingested_at": at, "ingestion_id": ingestion, "source": "feed", "source_file": name,
        "target": "active", "bytes": 1,
    }, indent=2))


@pytest.fixture
def landed(tmp_path):
    land(tmp_path / "in", "a.csv", "id-a")
    return tmp_path


def test_csv_is_all_text(spark, landed):
    rows = {r.norad_cat_id: r for r in landing.scan_landing_csv(spark, str(landed / "in"), GP).collect()}
    assert rows["100001"].bstar == "1.4e-05" and rows["100001"].mean_motion_ddot == "0"
    assert rows["100002"].object_id is None and rows["100002"].bstar == "NA"
    strict = landing.scan_landing_csv(spark, str(landed / "in"), GP, null_tokens=("NA",))
    assert strict.where("bstar IS NULL").count() == 1


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cells = [line.split(",") for line in (HEADER, *ROWS)]
    for name, turn in (("a.csv", 1), ("b.csv", -1)):
        (tmp_path / "in" / name).write_text("\n".join(",".join(c[::turn]) for c in cells))
    rows = landing.scan_landing_csv(spark, str(tmp_path / "in"), GP)
    assert rows.select(*GP.payload).distinct().count() == 2 and rows.count() == 4
    (tmp_path / "in" / "c.csv").write_text("\n".join(ROWS))
    with pytest.raises(Exception, match="no header in c.csv"):
        landing.scan_landing_csv(spark, str(tmp_path / "in"), GP).collect()


def test_a_landing_may_be_a_folder_of_parts(spark, tmp_path):
    land(tmp_path / "in", "a.csv", "id-a", rows=ROWS[:1])
    land(tmp_path / "in", "b.csv", "id-b")
    (tmp_path / "in" / "b.csv").rename(tmp_path / "whole.csv")
    (tmp_path / "in" / "b.csv").mkdir()
    cells = [line.split(",") for line in (HEADER, *ROWS)]
    for i, turn in ((1, 1), (2, -1)):  # every part is read by its own header
        text = "\n".join(",".join(c[::turn]) for c in (cells[0], cells[i]))
        (tmp_path / "in" / "b.csv" / f"part-{i}.csv").write_text(text)
    bronze.land_to_bronze(spark, str(tmp_path / "in"), GP, str(tmp_path / "bronze"))
    rows = bronze.scan_bronze(spark, str(tmp_path / "bronze"), GP).collect()
    got = sorted((r.source_file, r.ingestion_id, r.norad_cat_id) for r in rows)
    assert got == [("a.csv", "id-a", "100001"), ("b.csv", "id-b", "100001"), ("b.csv", "id-b", "100002")]


def test_landings_are_written_by_more_than_one_task(spark, tmp_path):
    rows = fx.raw_gp(spark, SF).repartition(3)
    folder = Path(_landing(spark, rows, GP.payload))
    assert all(len(list((folder / name).glob("part-*.csv"))) == 3 for name in ("gp_a.csv", "gp_b.csv"))
    read = landing.scan_landing_csv(spark, str(folder), GP)
    assert same_rows(read, rows.select("source_file", *GP.payload))


def test_layout_and_rewrite(spark, landed):
    root = str(landed / "bronze")
    for _ in range(2):
        bronze.land_to_bronze(spark, str(landed / "in"), GP, root)
    folder = landed / "bronze" / "ingest_date=2026-08-07" / "hour=20" / "ingestion_id=id-a"
    assert folder.is_dir()
    rows = bronze.scan_bronze(spark, root, GP)
    assert tuple(rows.columns) == GP.columns and rows.count() == 2
    assert rows.first().ingest_ts.microsecond == 187277
    # Another ingestion of the same hour is left alone by a rewrite of the first.
    land(landed / "in2", "b.csv", "id-b", at="2026-08-07T20:50:00+00:00")
    bronze.land_to_bronze(spark, str(landed / "in2"), GP, root)
    bronze.land_to_bronze(spark, str(landed / "in"), GP, root)
    assert bronze.scan_bronze(spark, root, GP).count() == 4
    assert bronze.scan_bronze(spark, root, GP, source_file="b.csv").count() == 2
    assert bronze.scan_bronze(spark, root, GP, source_file="none.csv").count() == 0


def test_sidecars_are_required(spark, landed):
    (landed / "in" / "bare.csv").write_text(f"{HEADER}\n{ROWS[0]}\n")
    with pytest.raises(landing.MissingSidecarError):
        bronze.land_to_bronze(spark, str(landed / "in"), GP, str(landed / "x"))
    (landed / "in" / "bare.csv.meta.json").write_text("{not json")
    with pytest.raises(landing.MissingSidecarError):
        bronze.land_to_bronze(spark, str(landed / "in"), GP, str(landed / "x"))


def test_unexpected_columns_are_refused(spark, tmp_path):
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        landing.scan_landing_csv(spark, str(tmp_path / "odd"), GP)


def test_load_is_idempotent(spark, landed):
    land(landed / "in", "b.csv", "id-b", rows=[*ROWS, ROWS[0]])
    feeds = {GP: (str(landed / "in"), str(landed / "bronze"), str(landed / "table"))}
    assert bronze.load_all(spark, feeds, source_file="a.csv") == {"gp": 2}
    assert bronze.load_all(spark, feeds) == {"gp": 2}
    assert bronze.load_all(spark, feeds) == {"gp": 0}
    assert bronze.load_all(spark, feeds, source_file="none.csv") == {"gp": 0}
    assert bronze.scan_bronze(spark, str(landed / "table"), GP).count() == 4


def test_a_load_reads_only_the_loads_it_may_repeat(spark, tmp_path):
    table, rows = str(tmp_path / "table"), fx.raw_gp(spark, SF).select(*GP.columns)
    days = [rows.withColumn("source_file", F.concat(F.lit(f"day{d}_"), "source_file")) for d in range(3)]
    n = [bronze.load_insert_if_absent(day, table, GP) for day in days]
    assert n[0] == n[1] == n[2] > 0
    first, = bronze.loads_in_question(days[0].where("source_file = 'day0_gp_b.csv'"), table)
    assert spark.read.parquet(f"{table}/loaded={first}").where("source_file not like 'day0%'").isEmpty()
    assert bronze.loads_in_question(rows, table) == []
    assert bronze.load_insert_if_absent(days[1].unionByName(rows), table, GP) == n[0]
    assert len(bronze.loads_in_question(days[1], table)) == 1
    assert bronze.scan_bronze(spark, table, GP).count() == 4 * n[0]


def test_an_interrupted_load_is_looked_at_again(spark, tmp_path, monkeypatch):
    table, rows = tmp_path / "table", fx.raw_gp(spark, SF).select(*GP.columns)
    n = bronze.load_insert_if_absent(rows, str(table), GP)
    bronze.load_insert_if_absent(rows.withColumn("source_file", F.lit("other.csv")), str(table), GP)
    monkeypatch.setattr(bronze, "_SUMMARY", "_never_written")
    assert len(bronze.loads_in_question(rows, str(table))) == 2
    assert bronze.load_insert_if_absent(rows, str(table), GP) == 0 and n > 0


def test_a_radius_reads_the_row_groups_around_it(spark, tmp_path):
    """Counted rows: a circle of 1000 km holds under 1 % of the ground."""
    root = str(tmp_path / "snapshot")
    k = F.col("id")
    rows = spark.range(200_000).select(
        k.cast("int").alias("norad_cat_id"), F.lit(ISS_EPOCH).alias("snapshot_ts"),
        F.degrees(F.asin((k * 7919 % 200_003) / F.lit(100_002.0) - 1.0)).alias("latitude_deg"),
        (k * 104_729 % 360_007 / F.lit(1000.0) - 180.0).alias("longitude_deg"),
    )
    rows = rows.select(*[
        F.col(c) if c in rows.columns else F.lit(1.0).cast(POSITION_SCHEMA[c].dataType).alias(c) for c in POSITION_COLUMNS])
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
    try:
        assert snapshot.write_snapshot(rows, root) == 200_000
    finally:
        spark.conf.unset("parquet.block.size")
    stored = snapshot.read_snapshot(spark, root)
    for lat, lon in ((52.52, 13.40), (0.0, 179.9), (-89.5, 0.0)):
        near = spatial.within_radius(stored, lat, lon, 1000.0)
        found = near.count()
        plain = spatial.within_radius(stored.drop("geo_curve"), lat, lon, 1000.0)
        assert found == plain.count() == spatial.distances_from(stored, lat, lon).where("distance_km <= 1000").count() > 0
        read = scanned(near)
        assert read < 0.05 * 200_000
        assert abs(lat) > 80 or read < 0.5 * scanned(plain)  # near a pole latitude alone does it


def scanned(df) -> int:
    """Rows that the scan of a plan without exchange puts out."""
    df._jdf.queryExecution().toRdd().count()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_missing_roots_are_empty(spark, tmp_path):
    assert bronze.scan_bronze(spark, str(tmp_path / "nowhere"), GP).isEmpty()
    assert snapshot.read_snapshot(spark, str(tmp_path / "nowhere")).isEmpty()


def test_snapshot_is_replaced(spark, iss, tmp_path):
    root, rows = str(tmp_path / "snapshot"), propagate(iss, ISS_EPOCH)
    assert snapshot.write_snapshot(rows, root) == 1
    first = snapshot.read_snapshot(spark, root).first()
    assert first.geo_point.lon == first.longitude_deg and first.geo_point.lat == first.latitude_deg
    assert snapshot.write_snapshot(propagate_grid(iss, ISS_EPOCH, samples=3, step_seconds=60), root) == 3
    assert snapshot.read_snapshot(spark, root).count() == 3
    assert snapshot.write_snapshot(rows.where("false"), root) == 0
    stored = snapshot.read_snapshot(spark, root)
    assert stored.count() == 3
    assert snapshot.latest_snapshot(stored).count() == 1
    again = snapshot.upsert_positions(
        stored.select(*POSITION_COLUMNS), rows.select(*POSITION_COLUMNS).withColumn("altitude_km", F.lit(1.0))
    )
    assert again.count() == 3 and again.where("altitude_km = 1.0").count() == 1


def test_build_stops_at_a_failed_check(spark, tmp_path):
    raw, satcat = fx.raw_gp(spark, SF), fx.raw_satcat(spark, SF)
    with pytest.raises(CheckFailure, match="is_earth_orbiting"):
        warehouse.build(spark, raw, satcat, str(tmp_path / "w"))
    bad = raw.withColumn("eccentricity", F.lit("1.5"))
    with pytest.raises(CheckFailure, match="eccentricity"):
        warehouse.build(spark, bad, satcat, str(tmp_path / "v"))
    assert not list((tmp_path / "v").glob("*/gold"))


def test_a_refused_build_leaves_the_old_version(spark, tmp_path):
    root, raw = str(tmp_path / "w"), fx.raw_gp(spark, SF)
    satcat = fx.raw_satcat(spark, SF).fillna("LU", subset=["orbit_center"])
    assert warehouse.read_built(spark, root) == {}
    warehouse.build(spark, raw, satcat, root)
    before = warehouse.read_built(spark, root)["elset"].count()
    with pytest.raises(CheckFailure):
        warehouse.build(spark, raw.withColumn("eccentricity", F.lit("1.5")), satcat, root)
    published = warehouse.read_built(spark, root)
    assert published["elset"].count() == before and published["fact"].count() > 0


def test_missing_feeds_are_skipped_and_empty_answers_refused(spark, landed):
    feeds = {GP: (str(landed / "nothing"), str(landed / "bronze"), str(landed / "table"))}
    assert bronze.load_all(spark, feeds) == {"gp": 0}
    land(landed / "in3", "c.csv", "id-c")
    (landed / "in3" / "c.csv").write_text("No GP data found\n")
    with pytest.raises(ValueError, match="c.csv"):
        bronze.land_to_bronze(spark, str(landed / "in3"), GP, str(landed / "y"))


def test_buckets_are_replaced_by_version(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, v int")
    table = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], 4)
    assert table.read().isEmpty()
    newest = lambda old, new: new.unionByName(old.join(new, "k", "left_anti"))
    table.merge(rows, newest)
    files = {str(f) for f in tmp_path.rglob("*.parquet")}
    table.merge(spark.createDataFrame([(7, 99)], rows.schema), newest)
    fresh = {f.split("bucket=")[1][0] for f in map(str, tmp_path.rglob("*.parquet")) if f not in files}
    assert len(fresh) == 1 and files <= {str(f) for f in tmp_path.rglob("*.parquet")}
    table.merge(spark.createDataFrame([(7, 99)], rows.schema), newest)  # a replay
    assert {r.k: r.v for r in table.read().collect()} == {i: 99 if i == 7 else i % 3 for i in range(50)}

    def fails(old, new):
        raise RuntimeError("interrupted")

    with pytest.raises(RuntimeError):
        table.merge(rows, fails)
    assert table.read().count() == 50
    with pytest.raises(ValueError, match="4 buckets"):
        KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], 8).read()
