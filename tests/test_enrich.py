import pytest
from pyspark.sql import functions as F

from skyledger.operators import enrich, summaries
from skyledger.schemas import DEFAULT_STALENESS_HOURS, STALENESS_HOURS


AROUND_LIMITS = [
    (regime, limit + step, step > 0)
    for regime, limit in [*STALENESS_HOURS.items(), (None, DEFAULT_STALENESS_HOURS), ("odd", DEFAULT_STALENESS_HOURS)]
    for step in (-0.25, 0.0, 0.25, -2.0 * limit)
]


@pytest.mark.parametrize(
    "regime,age,stale", [*AROUND_LIMITS, ("LEO", None, False), ("MEO", float("nan"), False)]
)
def test_staleness(spark, regime, age, stale):
    row = spark.createDataFrame([(age, regime)], "age double, regime string").select(
        enrich.is_stale(F.col("age"), F.col("regime")).alias("s")
    )
    assert row.first().s is stale


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(1, "STARLINK-1", "PAY", "LEO", 500.0, False, "AFETR"),
         (2, "ISS (ZARYA)", "PAY", "LEO", 420.0, True, "TYMSC"),
         (3, None, "DEB", "MEO", 2000.0, False, "NEW"),
         (4, "GEO 1", "R/B", None, 36000.0, False, None)],
        "norad_cat_id int, object_name string, object_type string, orbit_regime string, "
        "altitude_km double, is_stale boolean, launch_site string",
    )


def _ids(df):
    return sorted(r.norad_cat_id for r in df.collect())


def test_filters(frame):
    def keep(**filters):
        return _ids(enrich.filter_positions(frame, **filters))

    assert keep() == [1, 2, 3, 4]
    assert keep(regimes=[]) == [] and keep(regimes=["LEO", "MEO"]) == [1, 2, 3]
    assert keep(object_types=["DEB"]) == [3]
    assert keep(altitude_range=(420.0, 2000.0)) == [1, 2, 3]
    assert keep(name_query="starlink") == [1] and keep(name_query="") == [1, 2, 3, 4]
    assert keep(name_query="(zarya)") == [2]
    assert keep(name_query="iss.*ya", regex=True) == [2] and keep(name_query="iss.*ya") == []
    assert keep(hide_stale=True) == [1, 3, 4]
    assert keep(regimes=["LEO"], hide_stale=True, name_query="S") == [1]


def test_names_and_labels(frame):
    rows = frame.select(
        enrich.launch_site_name(F.col("launch_site")).alias("site"),
        enrich.object_label(F.col("object_name"), F.col("norad_cat_id")).alias("label"),
    ).collect()
    assert [r.site for r in rows] == ["Cape Canaveral", "Baikonur", "NEW", None]
    assert [r.label for r in rows][1:3] == ["ISS (ZARYA) · 2", "3"]


def test_left_join_keeps_orphans(spark, frame):
    dim = frame.where("norad_cat_id < 3").withColumns({"owner": F.lit("X"), "launch_date": F.lit(None).cast("date")})
    joined = enrich.attach_dimension(frame.select("norad_cat_id", "altitude_km"), dim)
    assert _ids(joined) == [1, 2, 3, 4] and joined.where("object_type IS NULL").count() == 2


def test_speed(spark):
    rows = spark.createDataFrame(
        [(2.0, -3.0, 6.0), (0.0, 0.0, 0.0), (1.0, None, 1.0)], "velocity_x_km_s double, velocity_y_km_s double, velocity_z_km_s double")
    assert [r.v for r in rows.select(enrich.speed().alias("v")).collect()] == [7.0, 0.0, None]


def test_metrics_and_options(frame):
    shown = enrich.dashboard_filter(regimes=["LEO"])
    assert summaries.dashboard_metrics(frame, shown).first()[:] == (2, 4, 1)
    options = summaries.distinct_options(frame, ["orbit_regime"]).collect()
    assert [r.option for r in options] == ["LEO", "MEO"]
    assert summaries.dashboard_metrics(frame.where("false"), shown).first()[:] == (0, 0, 0)
