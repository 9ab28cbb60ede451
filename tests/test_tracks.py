import pytest
from support import ELEMENTS, ISS, ISS_EPOCH, SF, same_rows
from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import propagate, tracks

POINTS = "norad_cat_id int, sample_idx int, latitude_deg double, longitude_deg double, altitude_km double"


def _path(spark, longitudes, key=1):
    return spark.createDataFrame(
        [(key, i, float(i), float(lon), 400.0) for i, lon in enumerate(longitudes)], POINTS
    )


def _segments(df):
    out = {}
    for r in df.orderBy("sample_idx").collect():
        out.setdefault(r.segment, []).append(r.longitude_deg)
    return list(out.values())


def test_split(spark):
    assert _segments(tracks.split_antimeridian(_path(spark, [161, 173, -176, -165]))) == [
        [161, 173], [-176, -165]
    ]
    assert _segments(tracks.split_antimeridian(_path(spark, [10, 20, 30]))) == [[10, 20, 30]]
    # A segment of one point cannot be drawn, unless it is all there is.
    assert _segments(tracks.split_antimeridian(_path(spark, [151, -162, 158, 164]))) == [[158, 164]]
    assert _segments(tracks.split_antimeridian(_path(spark, [5]))) == [[5]]


def test_unwrap(spark):
    def lons(values):
        rows = tracks.unwrap_longitude(_path(spark, values)).orderBy("sample_idx").collect()
        return [r.unwrapped_lon_deg for r in rows]

    assert lons([156.0, 171.25, -173.5, -158.0]) == [156.0, 171.25, 186.5, 202.0]
    assert lons([-166, 172, 150]) == [-166, -188, -210]
    assert lons([149, -151, 160, -140, -20]) == [149, 209, 160, 220, 340]


def test_paths_in_pieces_equal_paths_in_one_window(spark):
    points = fx.track_points(spark, SF).withColumn("sample_idx", F.col("sample_idx") * 3000)
    for op in (tracks.split_antimeridian, tracks.unwrap_longitude):
        assert same_rows(op(points), op(points, bounded=True))


def test_orbit_path_closes_and_ground_track_does_not(iss):
    closed = tracks.track_closure(tracks.orbit_tracks(iss, ISS_EPOCH, ground_track=False)).first()
    assert abs(closed.lon_gap_deg) < 1 and abs(closed.lat_gap_deg) < 1
    ground = tracks.orbit_tracks(iss, ISS_EPOCH, samples=90)
    assert ground.count() == 90
    assert abs(tracks.track_closure(ground).first().lon_gap_deg) > 15


def test_batch_skips_objects_without_a_period(spark):
    both = spark.createDataFrame([ISS, (1, "x", ISS_EPOCH, 0.0, *ISS[4:])], ELEMENTS)
    rows = tracks.orbit_tracks(both, ISS_EPOCH, samples=10)
    assert [r.norad_cat_id for r in rows.select("norad_cat_id").distinct().collect()] == [25544]
    with pytest.raises(ValueError):
        tracks.orbit_tracks(both, ISS_EPOCH, samples=1)


def test_paths(iss):
    flat = tracks.tracks_to_paths(tracks.orbit_tracks(iss, ISS_EPOCH), globe=False).collect()
    assert sum(len(r.path) for r in flat) <= 90 and all(len(p) == 2 for r in flat for p in r.path)
    for r in flat:
        assert all(abs(b[0] - a[0]) <= 180 for a, b in zip(r.path, r.path[1:]))
    globe, = tracks.tracks_to_paths(
        tracks.orbit_tracks(iss, ISS_EPOCH, ground_track=False), globe=True, exaggeration=2.0
    ).collect()
    assert len(globe.path) == 90 and 780_000 < globe.path[0][2] < 880_000
    assert globe.period_minutes == 93.0


def test_tasks_of_a_track_grow_with_the_objects(spark, monkeypatch):
    rows = [(i, f"S{i}", ISS_EPOCH, 2.0 + i % 13, 0.001, 10.0 * (i % 9), 0.0, 0.0, 1.0 * i, 0.0) for i in range(50)]
    objects = spark.createDataFrame(rows, ELEMENTS)
    few = tracks.orbit_tracks(objects, ISS_EPOCH, samples=90)
    monkeypatch.setattr(propagate, "SAMPLES_IN_TASK", 100)
    many = tracks.orbit_tracks(objects, ISS_EPOCH, samples=90)
    assert many.rdd.getNumPartitions() == 45 > few.rdd.getNumPartitions()
    assert same_rows(tracks.tracks_to_paths(many, globe=True), tracks.tracks_to_paths(few, globe=True))
