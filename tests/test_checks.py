from datetime import datetime, timedelta

import pytest
from support import SF
from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import checks
from skyledger.plans import warehouse
from skyledger.schemas import GP


@pytest.fixture(scope="module")
def layers(spark):
    return warehouse.layers(fx.raw_gp(spark, SF), fx.raw_satcat(spark, SF))


def test_every_declared_check_runs(layers):
    results = checks.run_checks(layers).collect()
    assert len(results) == 48
    failed = {(r.model, r.column) for r in results if r.failures}
    assert failed == {("dim_object", "is_earth_orbiting")}
    with pytest.raises(checks.CheckFailure):
        checks.require_passed(checks.run_checks({"dim_object": layers["dim_object"]}))
    checks.require_passed(checks.run_checks({"elset": layers["elset"]}))


def test_intervals(spark):
    for t in ([datetime(2026, 1, d) for d in (1, 2, 3)], [datetime(2026, m, 1) for m in (1, 5, 9)]):
        rows = spark.createDataFrame(
            [(1, t[0], t[1]), (1, t[1], None), (2, t[0], t[2]), (2, t[1], None), (3, t[0], None)],
            "norad_cat_id int, valid_from timestamp, valid_to timestamp",
        )
        broken = checks.broken_intervals(rows).collect()
        assert [(r.norad_cat_id, r.valid_from) for r in broken] == [(2, t[0])]
    twice = rows.withColumn("is_current", F.lit(True))
    assert {r.norad_cat_id for r in checks.many_current(twice).collect()} == {1, 2}


def test_null_outcomes_are_not_failures(spark):
    rows = spark.createDataFrame([(None,), ("PAY",), ("X",)], "object_type string")
    check = checks.accepted_values("m", "object_type", ("PAY",))
    assert [r.object_type for r in checks.violating_rows(rows, check).collect()] == ["X"]


@pytest.mark.parametrize("hours,status", [(1, "pass"), (5, "warn"), (13, "error")])
def test_freshness(spark, hours, status):
    at = datetime(2026, 1, 1, 12)
    rows = spark.createDataFrame([(at,)], "ingest_ts timestamp")
    now = F.lit((at + timedelta(hours=hours)).isoformat() + "Z").cast("timestamp")
    assert checks.freshness(rows, "gp", now).first().status == status
    assert checks.freshness(rows.where("false"), "gp", now).first().status == "error"


def test_column_order(spark):
    rows = fx.raw_gp(spark, SF)
    checks.require_columns(rows, GP)
    with pytest.raises(checks.CheckFailure):
        checks.require_columns(rows.select(*reversed(rows.columns)), GP)


def test_history_in_one_pass_equals_the_three_checks(spark):
    days = lambda *n: [f"2024-01-{x:02d}" for x in n]
    rows = []
    for number, epochs in ((1, days(1, 2, 3)), (2, days(1, 1, 4, 4, 4)), (3, days(5)), (None, days(1, 1)), (4, days(2, 9))):
        ends = [*epochs[1:], None]
        rows += [(number, e, e, t, t is None) for e, t in zip(epochs, ends, strict=True)]
    rows += [(5, "2024-01-01", "2024-01-01", None, True), (5, "2024-01-02", "2024-01-02", "2024-01-09", True),
             (6, "2024-01-01", "2024-01-01", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "norad_cat_id int, epoch string, valid_from string, valid_to string, is_current boolean")
    df = df.select("norad_cat_id", *[F.col(c).cast("timestamp").alias(c) for c in ("epoch", "valid_from", "valid_to")], "is_current")
    got = {r.check: r.failures for r in checks.history_counts(df).collect()}
    assert got["unique"] == checks.repeated_keys(df, ("norad_cat_id", "epoch")).count() == 2
    assert got["one_current"] == checks.many_current(df).count() == 1
    assert got["contiguous"] == checks.broken_intervals(df).count() > 0
    empty = {r.check: r.failures for r in checks.history_counts(df.limit(0)).collect()}
    assert empty == dict.fromkeys(got, 0)


def test_watched_row_checks_equal_counted_ones(spark, tmp_path):
    raw = fx.raw_gp(spark, SF).withColumn("epoch", F.when(F.col("norad_cat_id") != "7", F.col("epoch")))
    watched = checks.Watched("raw_gp")
    watched.over(raw).write.parquet(str(tmp_path / "raw"))
    want = checks.row_check_counts(raw, checks.row_checks_of("raw_gp"))
    assert sorted(watched.results(spark).collect()) == sorted(want.collect())
    assert max(r.failures for r in want.collect()) > 0


def test_stale_feeds_stop_a_build(spark, tmp_path):
    raw, satcat = fx.raw_gp(spark, SF), fx.raw_satcat(spark, SF).fillna("LU", subset=["orbit_center"])
    with pytest.raises(checks.CheckFailure, match="freshness"):
        warehouse.build(spark, raw, satcat, str(tmp_path / "w"), now="2011-01-01T00:00:00Z")
    now = max(r[0] for r in raw.union(satcat).agg(F.max("ingest_ts")).collect()).isoformat() + "Z"
    found = {(r.model, r.check): (r.severity, r.failures) for r in checks.feed_results(raw, satcat, F.lit(now).cast("timestamp")).collect()}
    assert set(found) == {("raw_gp", "freshness"), ("raw_satcat", "freshness"), ("raw_satcat", "coupling")}
