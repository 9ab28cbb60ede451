from datetime import timedelta

import numpy as np
import pytest
from support import ELEMENTS, GEO, ISS_EPOCH, SF, same_rows
from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.functions import frames
from skyledger.operators import visibility as v
from skyledger.operators.propagate import instant, propagate
from skyledger.queries import base, registry

BERLIN = [(0, 52.52, 13.40, 0.0)]
OBSERVER = "observer_id int, observer_latitude_deg double, observer_longitude_deg double, observer_altitude_km double"


def _find(df, **options):
    options = {"window_hours": 24, "kernel": "sgp4", **options}
    return v.find_passes(df, BERLIN, ISS_EPOCH, **options)


def test_iss_over_berlin(iss):
    found = _find(iss).orderBy("start_utc").collect()
    assert 3 <= len(found) <= 7
    for p in found:
        assert 0 < p.duration_minutes < 15
        assert p.start_utc <= p.peak_utc <= p.end_utc
        assert 10 <= p.peak_elevation_deg <= 90


def test_higher_thresholds_find_less(iss):
    counts = [_find(iss, minimum_elevation=float(e)).count() for e in (0, 10, 30, 60)]
    assert counts == sorted(counts, reverse=True)


def test_step_does_not_change_the_passes(iss):
    assert _find(iss, step_seconds=30).count() == _find(iss, step_seconds=15).count()


def test_an_object_that_never_sets_is_truncated(spark):
    # Over the equator below it, a geostationary object stays up for the whole window.
    geo = spark.createDataFrame([GEO], ELEMENTS)
    at = propagate(geo, ISS_EPOCH).first()
    one, = v.find_passes(
        geo, [(1, 0.0, at.longitude_deg, 0.0)], ISS_EPOCH, window_hours=6, step_seconds=300
    ).collect()
    assert one.truncated and one.duration_minutes == pytest.approx(355.0)


def _walk(series, minimum):
    """Runs at or above the threshold, by walking one series in order."""
    runs, current = [], []
    for i, row in enumerate(series):
        if row.elevation_deg >= minimum:
            current.append(i)
        elif current:
            runs.append(current)
            current = []
    if current:
        runs.append(current)
    return [(series[r[0]].ts, series[r[-1]].ts, r[0] == 0 or r[-1] == len(series) - 1)
            for r in runs if len(r) >= 2]


def test_islands_equal_a_sequential_walk(spark):
    series = fx.elevation_series(spark, SF)
    found = {}
    for p in v.pass_islands(series, minimum_elevation=10.0).collect():
        found.setdefault(p.norad_cat_id, []).append((p.start_utc, p.end_utc, p.truncated))
    rows = {}
    for r in series.orderBy("norad_cat_id", "sample_idx").collect():
        rows.setdefault(r.norad_cat_id, []).append(r)
    for key, one in rows.items():
        assert sorted(found.get(key, [])) == sorted(_walk(one, 10.0))


def test_islands_across_pieces(spark):
    series = fx.elevation_series(spark, SF)
    apart = series.withColumn("sample_idx", F.col("sample_idx") * 3000)
    assert same_rows(v.pass_islands(series), v.pass_islands(apart))


def test_first_maximum_is_the_peak_and_gaps_do_not_break(spark):
    rows = [(1, "a", 0, i, rank, 6, ISS_EPOCH + timedelta(seconds=30 * i), float(i), el)
            for i, rank, el in ((0, 0, 5.0), (1, 1, 20.0), (3, 2, 40.0), (4, 3, 40.0), (5, 4, 12.0), (6, 5, 3.0))]
    series = spark.createDataFrame(
        rows, "norad_cat_id int, object_name string, observer_id int, sample_idx int, "
        "sample_rank int, n_survived int, ts timestamp, azimuth_deg double, elevation_deg double",
    ).where("elevation_deg >= 10")
    one, = v.passes_of_series(series).collect()
    assert one.peak_azimuth_deg == 3.0 and not one.truncated
    assert one.duration_minutes == pytest.approx(2.0)
    # The lone sample before the gap is too short to be a pass of its own.
    broken, = v.passes_of_series(series, break_on_gap=True).collect()
    assert broken.duration_minutes == pytest.approx(1.0)


@pytest.mark.parametrize("minimum", [0.0, 10.0, 45.0])
def test_grid_join_finds_every_visible_pair(spark, minimum):
    places = [(i, lat, lon, 0.0) for i, (lat, lon) in enumerate(
        (lat, lon) for lat in (-90, -89.5, -60, -5, 0.1, 33, 66, 89.9) for lon in (-180, -90.2, 0, 77, 179.9)
    )]
    observers = spark.createDataFrame([(p[0], float(p[1]), float(p[2]), 0.0) for p in places], OBSERVER)
    k = F.col("id")
    positions = spark.range(400).select(
        k.cast("int").alias("norad_cat_id"),
        (k * 37 % 181 - 90).cast("double").alias("latitude_deg"),
        (k * 53 % 360 - 179.5).alias("longitude_deg"),
        F.pow(F.lit(10.0), 2.2 + (k % 7) * 0.4).alias("altitude_km"),
    )
    want = v.filter_visible(
        v.look_angles(positions, [(p[0], float(p[1]), float(p[2]), 0.0) for p in places]), minimum
    ).select("norad_cat_id", "observer_id")
    got = v.visible_now(positions, observers, minimum_elevation=minimum)
    assert same_rows(want, got.select("norad_cat_id", "observer_id"))


def test_table_of_observers_equals_list(spark, iss):
    table = spark.createDataFrame(BERLIN, OBSERVER)
    a = _find(iss).select("start_utc", "end_utc", "truncated")
    b = v.find_passes(iss, table, ISS_EPOCH, window_hours=24, kernel="sgp4").select("start_utc", "end_utc", "truncated")
    assert same_rows(a, b)


def test_bad_windows_are_refused(iss):
    with pytest.raises(ValueError):
        _find(iss, window_hours=0)
    with pytest.raises(ValueError):
        _find(iss, step_seconds=-1)
    with pytest.raises(ValueError):
        v.find_passes(iss, [], ISS_EPOCH)


def test_j2_pass_search_shuffles_element_sets_only(iss):
    plan = _find(iss, kernel="j2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION_BY_COL") <= 2


@pytest.mark.parametrize("name, kernel", [("find_passes_many", "j2"), ("find_passes_sgp4", "sgp4")])
def test_registered_passes_equal_a_walk_over_the_default_window(spark, name, kernel):
    found = {}
    for p in registry()[name].run(spark, SF).collect():
        found.setdefault((p.norad_cat_id, p.observer_id), []).append((p.start_utc, p.end_utc, p.truncated))
    observers = [tuple(o) for o in fx.observers(spark, SF).where("observer_id in (-1, 3, 17)").collect()]
    observers = [o for o in observers if o[0] == -1 or name == "find_passes_many"]
    some = base.fact(spark, SF).where("norad_cat_id % 12 = 1 or mean_motion > 14")
    rows = {}
    for r in v.look_angle_series(some, observers, base.AT, kernel=kernel).orderBy("sample_rank").collect():
        rows.setdefault((r.norad_cat_id, r.observer_id), []).append(r)
    walked = {key: _walk(one, 10.0) for key, one in rows.items()}
    assert {key: sorted(found.get(key, [])) for key in rows} == {key: sorted(w) for key, w in walked.items()}
    first = min(one[0].ts for one in rows.values())
    passes = [w for one in walked.values() for w in one]
    assert any(end - start < timedelta(minutes=5) for start, end, _ in passes)
    assert any(start - first > timedelta(hours=48) for start, _, _ in passes)
    assert {r.kernel_used for one in rows.values() for r in one} >= {kernel}


def test_registered_series_covers_the_default_window(spark):
    got = registry()["look_angle_series"].run(spark, SF).groupBy("norad_cat_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    assert got and all(r.n == 8640 and r.b - r.a == timedelta(hours=72, seconds=-30) for r in got)


def test_sgp4_puts_out_only_what_an_observer_may_see(spark):
    rows = [(i, f"S{i}", ISS_EPOCH, n, 0.001 * i, 10.0 * i, 30.0 * i, 77.0 * i, 91.0 * i, 1e-5)
            for i, n in enumerate([15.9, 15.2, 14.0, 12.5, 9.0, 7.0, 6.5, 2.0, 1.0])]
    objects = spark.createDataFrame(rows, ELEMENTS)
    sites = [(1, 52.52, 13.4, 0.0), (2, -33.9, 151.2, 0.1), (3, 89.9, 0.0, 2.0)]
    args = (objects, sites, ISS_EPOCH, 24, 30, 10.0)
    got = v._sgp4_risen(*args)
    series = v._series(objects, ISS_EPOCH, 24, 30, "sgp4")
    want = v.visible_pairs(series, v.observer_table(spark, sites), 10.0)
    key = ("norad_cat_id", "observer_id", "sample_idx", "sample_rank", "n_survived", "kernel_used")
    assert got.count() > 1000 and same_rows(got.select(*key), want.select(*key))
    near = objects.where("mean_motion > 6.4")
    at = spark.range(1).select(frames.julian_date(instant(ISS_EPOCH))).first()[0]
    place = frames.with_observer_frame(spark.createDataFrame(sites[:1], OBSERVER)).select(*frames.OBSERVER_FIELDS[:3]).first()
    keep = v._in_sight(np.array([place]), at, 2880, 30, 10.0)
    left = v._series(near, ISS_EPOCH, 24, 30, "sgp4", keep).count()
    assert 0 < left < 0.4 * v._series(near, ISS_EPOCH, 24, 30, "sgp4").count()


def test_samples_inside_a_pass_are_counted_and_not_computed(spark):
    elsets = base.fact(spark, SF).orderBy("norad_cat_id").limit(40)
    sites = [(0, 52.52, 13.40, 0.0), (1, -33.9, 151.2, 0.1), (2, 0.0, 20.0, 0.0)]
    up = v.look_angle_series(elsets, sites, base.AT, window_hours=24).where("elevation_deg >= 10")
    for observers in (sites, spark.createDataFrame(sites, OBSERVER)):
        rows = v.risen(elsets, observers, base.AT, 24, 30, 10.0).cache()
        covered = rows.withColumn("sample_idx", F.explode(F.expr("sequence(sample_idx, sample_idx + n_up - 1)")))
        keys = ("norad_cat_id", "observer_id", "sample_idx")
        assert same_rows(covered.select(*keys), up.select(*keys))
        # Passes last for many samples; the first, the last and those near the top have angles.
        assert rows.where("ts is not null").count() * 2 < up.count()


def test_the_end_of_a_window_cuts_passes_at_computed_samples(spark):
    elsets = base.fact(spark, SF).orderBy("norad_cat_id").limit(60)
    sites = [(0, 52.52, 13.40, 0.0)]
    for hours in (0.1, 0.5, 3.05):  # ends inside intervals, and windows shorter than one
        series = v.look_angle_series(elsets, sites, base.AT, window_hours=hours)
        plain = v.passes_of_series(series.where("elevation_deg >= 10"))
        assert same_rows(v.find_passes(elsets, sites, base.AT, window_hours=hours), plain)
