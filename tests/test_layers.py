from datetime import datetime

import pytest
from support import SF, same_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import gold, ledger, ordered, silver
from skyledger.operators.ordered import OrderedGroups
from skyledger.schemas import FEEDS, GP, SATCAT, Feed


@pytest.fixture(scope="module")
def staged(spark):
    return silver.stage_gp(fx.raw_gp(spark, SF))


def test_staging_types(spark, staged):
    kinds = dict(staged.dtypes)
    assert kinds["inclination"] == "decimal(12,8)" and kinds["bstar"] == "decimal(15,12)"
    assert kinds["epoch"] == "timestamp" and kinds["norad_cat_id"] == "int"
    exponent = fx.raw_gp(spark, SF).limit(1).withColumn("bstar", F.lit("1.4e-05"))
    assert float(silver.stage_gp(exponent).first().bstar) == 1.4e-05


@pytest.mark.parametrize("column,value", [
    ("norad_cat_id", "abc"), ("epoch", "yesterday"), ("inclination", "1234567.0"),
])
def test_bad_values_fail_the_job(spark, column, value):
    bad = fx.raw_gp(spark, SF).limit(1).withColumn(column, F.lit(value))
    with pytest.raises(Exception, match="CAST|NUMERIC|cast"):
        silver.stage_gp(bad).collect()


def plain_history(staged):
    """The history by one window for each object."""
    w = Window.partitionBy("norad_cat_id").orderBy("epoch")
    first = silver.dedup_earliest(staged).withColumn("valid_to", F.lead("epoch").over(w))
    return first.withColumns({"valid_from": F.col("epoch"), "is_current": F.col("valid_to").isNull()})


def test_history_equals_one_window_for_each_object(staged):
    assert same_rows(silver.elset(staged), plain_history(staged))


def test_usual_groups_stay_whole(spark):
    """No group holds a large share: one scan, one window, no join with edges."""
    rows = spark.range(5000).select((F.col("id") % 50).cast("int").alias("norad_cat_id"), F.timestamp_seconds("id").alias("epoch"))
    plan = silver.with_validity(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window ") == 1 and plan.count("Range ") == 1


@pytest.mark.parametrize("crowded", [False, True])
def test_a_group_with_most_rows_is_split_evenly(spark, monkeypatch, crowded):
    """Pieces follow the rows: nine tenths of them may lie close together."""
    monkeypatch.setattr(ordered, "ROWS_IN_PIECE", 500)
    i = F.col("id") if not crowded else F.when(F.col("id") % 10 == 5, F.col("id") * 10_000).otherwise(F.col("id"))
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, 1).when(F.col("id") % 40 == 9, None).otherwise(F.col("id")).alias("k"), i.alias("i"))
    groups = OrderedGroups(rows, ["k"], ["i"]).neighbours(previous={"before": "i"})
    pieces = groups.frame.groupBy(*groups._pieces).count()
    assert pieces.where("k = 1").count() >= 30 and pieces.where("k = 1").agg(F.max("count")).first()[0] <= 1000
    assert pieces.where("k <> 1").agg(F.max("_block")).first()[0] == 0
    w = Window.partitionBy("k").orderBy("i")
    assert same_rows(groups.result(), rows.withColumn("before", F.lag("i").over(w)))
    none = groups.frame.where("not _cut").groupBy("_block").count().collect()
    assert [r._block for r in none] == [0]


def test_an_object_with_all_its_rows_in_one_month(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_IN_PIECE", 300)
    start = datetime(2024, 5, 1)
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).cast("int").alias("norad_cat_id"),
        F.timestamp_seconds(F.lit(int(start.timestamp())) + F.col("id") * 60).alias("epoch"))
    cut = ordered.borders(rows, ["norad_cat_id"], "epoch").collect()
    assert [r.norad_cat_id for r in cut] == [7] and len(cut[0]._borders) >= 5
    w = Window.partitionBy("norad_cat_id").orderBy("epoch")
    want = rows.withColumns({"valid_to": F.lead("epoch").over(w), "valid_from": F.col("epoch")}).withColumn(
        "is_current", F.col("valid_to").isNull())
    assert same_rows(silver.with_validity(rows), want)


def test_one_object_holding_most_rows(spark, staged):
    skewed = staged.withColumn(
        "norad_cat_id", F.when(F.col("rev_at_epoch") % 3 != 0, 7).otherwise(F.col("norad_cat_id"))
    )
    a = silver.elset(skewed)
    assert same_rows(a, plain_history(skewed)) and a.where("is_current").count() == a.select("norad_cat_id").distinct().count()


def test_earliest_and_latest(spark, staged):
    first = silver.dedup_earliest(staged)
    assert first.count() == staged.select("norad_cat_id", "epoch").distinct().count()
    newest = silver.space_object(silver.stage_satcat(fx.raw_satcat(spark, SF)))
    assert [r.source_file for r in newest.select("source_file").distinct().collect()] == ["satcat_2b.csv"]


def test_asof_equals_a_range_join(spark, staged):
    elsets = silver.elset(staged)
    probes = fx.geo_points(spark, SF).select(
        (F.col("point_id") % 150).cast("int").alias("norad_cat_id"), "point_id",
        F.col("seen_at").alias("at"),
    )
    want = probes.alias("p").join(
        elsets.alias("e"),
        F.expr("p.norad_cat_id = e.norad_cat_id AND e.valid_from <= p.at "
               "AND (e.valid_to IS NULL OR p.at < e.valid_to)"), "left",
    ).select("p.*", "e.epoch", "e.valid_to")
    assert same_rows(want, silver.asof_elset(probes, elsets))


def test_flags(spark):
    rows = spark.createDataFrame(
        [("EA", 1999), ("25544", 2000), ("SU", 34999), (None, 35000), ("EA1", None)],
        "orbit_center string, apogee_km int",
    ).select(
        gold.is_earth_orbiting(F.col("orbit_center")).alias("earth"),
        gold.orbit_regime(F.col("apogee_km")).alias("regime"),
    ).collect()
    assert [r.earth for r in rows] == [True, True, False, None, False]
    assert [r.regime for r in rows] == ["LEO", "MEO", "MEO", "GEO/HEO", "unknown"]


def test_limit_zero_means_all(spark, staged):
    rows = silver.elset(staged)
    assert gold.ordered_by_id(rows, 0).count() == rows.count()
    assert gold.ordered_by_id(rows, 3).count() == 3


def test_descriptors():
    assert [len(f.columns) for f in FEEDS] == [22, 22]
    assert GP.columns[:5] == SATCAT.columns[:5]
    with pytest.raises(ValueError):
        Feed("x", ("norad_cat_id", "norad_cat_id"))
    with pytest.raises(ValueError):
        Feed("x", ("object_name",))


def test_running_values_with_nulls_and_spread_groups(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(k, i, None if i % 4 else float(i), i) for k in (1, 2, None) for i in range(30)],
        "k int, i int, x double, n int",
    )

    def columns(rows_in_piece):
        monkeypatch.setattr(ordered, "ROWS_IN_PIECE", rows_in_piece)
        groups = OrderedGroups(rows, ["k"], ["i"])
        assert groups.cut == (rows_in_piece < 30)
        groups.neighbours(previous={"x0": "x", "n0": "n"}, following={"n1": "n"})
        groups.running_sums({"total": F.col("n"), "seen": F.col("x")}).fill_forward("last", "x")
        return groups.result()

    whole = columns(100)
    for size in (1, 4, 7):
        assert same_rows(whole, columns(size))


def test_ledger_equals_one_window_for_each_group(spark):
    manifest = fx.manifest(spark, SF)
    order = ("ingested_at", "source_file", "ingestion_id")
    day = Window.partitionBy(F.to_date("ingested_at")).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = manifest.withColumn("used_before", F.coalesce(F.sum("bytes").over(day), F.lit(0)))
    want = used.where("used_before >= 2000000").withColumn("day", F.to_date("ingested_at"))
    assert same_rows(ledger.budget_breaches(manifest, 2_000_000), want)
    before = F.lag("etag").over(Window.partitionBy("target").orderBy(*order))
    want = manifest.withColumn("previous_etag", before).where("previous_etag = etag")
    assert same_rows(ledger.unchanged_payloads(manifest), want)


def test_cache_and_budget(spark):
    ts = [datetime(2026, 8, 7, h) for h in (1, 2, 3)]
    manifest = spark.createDataFrame(
        [(ts[0], "1", "gp", "a", "active", 60, "x"), (ts[1], "2", "gp", "b", "active", 60, "x"),
         (ts[2], "3", "gp", "c", "active", 60, "y")],
        "ingested_at timestamp, ingestion_id string, source string, source_file string, "
        "target string, bytes long, etag string",
    )
    fresh = [ledger.cache_fresh(manifest, F.lit(t).cast("timestamp")).first().is_fresh
             for t in ("2026-08-07T04:59:59Z", "2026-08-07T05:00:00Z")]
    assert fresh == [True, False]
    assert [r.ingestion_id for r in ledger.budget_breaches(manifest, 120).collect()] == ["3"]
    assert [r.ingestion_id for r in ledger.unchanged_payloads(manifest).collect()] == ["2"]
    assert ledger.latest_per_target(manifest).first().source_file == "c"
    with pytest.raises(ValueError):
        ledger.require_no_empty_landings(manifest, manifest.where("source_file <> 'b'"))
