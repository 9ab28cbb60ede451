import numpy as np
import pytest
from support import ELEMENTS, ISS_EPOCH, same_rows
from pyspark.sql import functions as F

from skyledger.functions import frames, sight
from skyledger.operators import visibility as v
from skyledger.queries.base import rounded
from test_passes import OBSERVER

# The last ones dip below the ground at every perigee, which SGP4 declines, or move far from a circle.
MOTIONS = [(15.9, 0.001), (15.2, 0.01), (13.0, 0.1), (9.0, 0.2), (7.0, 0.05), (2.0, 0.6), (1.0027, 0.001), (1.0, 0.0),
           (0.6, 0.85), (0.4, 0.93), (8.0, 0.41), (10.0, 0.33)]


def _objects(spark):
    rows = [(i, f"S{i % 5}", ISS_EPOCH, n, e, 17.0 * i % 180, 30.0 * i, 77.0 * i, 91.0 * i, 1e-5) for i, (n, e) in enumerate(MOTIONS)]
    rows += [(90, "no motion", ISS_EPOCH, None, 0.1, 50.0, 0.0, 0.0, 0.0, 0.0), (91, "no epoch", None, 15.0, 0.0, 50.0, 0.0, 0.0, 0.0, 0.0),
             (92, "no node", ISS_EPOCH, 15.0, 0.0, 50.0, None, 0.0, 0.0, 0.0), (None, None, ISS_EPOCH, 14.0, 0.0, 60.0, 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, ELEMENTS)


def _sites(spark, count):
    rows = [(i if i != 3 else None, float(i * 37 % 181 - 90), float(i * 53 % 360 - 179.3), 0.1 * (i % 9)) for i in range(count)]
    return spark.createDataFrame(rows + [(-7, None, 3.0, 0.0)], OBSERVER)


def _plain(elsets, table, hours, minimum, kernel, **options):
    series = v._series(elsets, ISS_EPOCH, hours, 30, kernel)
    pairs = series.crossJoin(F.broadcast(frames.with_observer_frame(table.where("observer_latitude_deg is not null"))))
    # SGP4 gives no numbers, and no error, where the node is not known.
    up = (F.col("elevation_deg") >= minimum) & ~F.isnan("elevation_deg")
    return v.passes_of_series(frames.with_look_angles(pairs).where(up), **options)


@pytest.mark.parametrize("kernel, count, hours, minimum, gap", [
    ("j2", 150, 30, 10.0, False), ("j2", 20, 0.3, 0.0, True), ("j2", 9, 20, -95.0, False), ("j2", 9, 20, 70.0, False),
    ("sgp4", 90, 24, 10.0, False), ("sgp4", 20, 24, 10.0, True), ("sgp4", 9, 9.1, -20.0, True),
])
def test_passes_in_batches_equal_passes_of_all_samples(spark, kernel, count, hours, minimum, gap):
    objects, table = _objects(spark), _sites(spark, count)
    got = v.find_passes(
        objects, table, ISS_EPOCH, window_hours=hours, minimum_elevation=minimum, break_on_gap=gap, kernel=kernel).cache()
    want = _plain(objects, table, hours, minimum, kernel, break_on_gap=gap)
    assert got.dtypes == want.dtypes and got.count() > 20
    assert same_rows(rounded(got), rounded(want))


@pytest.mark.parametrize("kernel, listed", [("j2", False), ("sgp4", False), ("sgp4", True)])
def test_no_sample_is_exchanged_or_sorted(spark, kernel, listed):
    sites = [(i, 7.0 * i - 80, 14.0 * i - 170, 0.0) for i in range(25)]
    observers = sites if listed else spark.createDataFrame(sites, OBSERVER)
    plan = v.find_passes(_objects(spark), observers, ISS_EPOCH, kernel=kernel)._jdf.queryExecution().executedPlan().toString()
    # Only element sets and lists of observers are exchanged.
    assert "Window" not in plan and "Sort " not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_breaks_at_declined_samples_differ_from_none(spark):
    dips = _objects(spark).where("norad_cat_id in (10, 11)")
    kept = v.find_passes(dips, _sites(spark, 20), ISS_EPOCH, window_hours=24, minimum_elevation=-60.0, kernel="sgp4")
    broken = v.find_passes(dips, _sites(spark, 20), ISS_EPOCH, window_hours=24, minimum_elevation=-60.0, kernel="sgp4", break_on_gap=True)
    assert 0 < kept.count() < broken.count()


@pytest.mark.parametrize("kernel", ["j2", "sgp4"])
def test_observers_of_one_id_share_a_series_and_none_see_nothing(spark, kernel):
    one = spark.createDataFrame([(1, 52.5, 13.4, 0.0)], OBSERVER)
    twice = one.union(spark.createDataFrame([(1, -52.5, -166.6, 0.0)], OBSERVER))
    high = _objects(spark).where("norad_cat_id = 3")
    # No sample is up over both places, so the passes of both are those of the id.
    apart = [v.find_passes(high, t.where(f"observer_latitude_deg {side} 0"), ISS_EPOCH, window_hours=24, kernel=kernel)
             for t, side in ((twice, ">"), (twice, "<"))]
    both = v.find_passes(high, twice, ISS_EPOCH, window_hours=24, kernel=kernel)
    assert both.count() > 3 and same_rows(rounded(both), rounded(apart[0].union(apart[1])))
    assert v.find_passes(high, one.where("false"), ISS_EPOCH, kernel=kernel).isEmpty()


def test_unknown_kernels_are_refused(iss, spark):
    with pytest.raises(ValueError):
        v.find_passes(iss, _sites(spark, 2), ISS_EPOCH, kernel="sgp8")


def test_a_sure_sample_is_near_the_exact_one():
    gc, gs = sight.turn(1_626_645_596_518_368, 8640, 30)
    for n, e in MOTIONS:
        rate = n * 2 * np.pi / 86400
        a = (398600.8 / rate**2) ** (1 / 3)
        k = {"_k_e": e, "_k_n": rate, "_k_a": a, "_k_root": np.sqrt(1 - e * e), "_k_ci": 0.3, "_k_si": np.sqrt(0.91), "_k_node": 1.0,
             "_k_argp": 2.0, "_k_m": 3.0, "_k_node_rate": -1e-6, "_k_argp_rate": 7e-7}
        places = sight.j2_places(k, 1e8, 30, gc, gs)
        off = sight.j2_track(k, 1e8, 30, gc, gs, places) - places(np.arange(8640))
        assert np.abs(off).max() < 1e-5
