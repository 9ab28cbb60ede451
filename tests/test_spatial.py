import pytest
from support import same_rows
from pyspark.sql import functions as F
from pyspark.sql import Window

from skyledger.operators import spatial

PLACES = "observer_id int, observer_latitude_deg double, observer_longitude_deg double"


@pytest.fixture(scope="module")
def points(spark):
    k = F.col("id")
    return spark.range(3000).select(
        k.cast("int").alias("norad_cat_id"),
        (k * 37 % 1801 / F.lit(10.0) - 90.0).alias("latitude_deg"),
        (k * 131 % 3600 / F.lit(10.0) - 180.0).alias("longitude_deg"),
    ).cache()


@pytest.fixture(scope="module")
def places(spark):
    where = [(90.0, 0.0), (-90.0, 45.0), (89.2, 179.9), (0.0, -180.0), (0.05, 179.95), (52.52, 13.40),
             (-33.9, 151.2), (-66.0, -179.7)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(where)], PLACES)


def _pairs(points, places):
    rows = [tuple(r) for r in places.collect()]
    listed = F.explode(F.array(*[
        F.struct(F.lit(i).alias("observer_id"), F.lit(a).alias("observer_latitude_deg"),
                 F.lit(b).alias("observer_longitude_deg")) for i, a, b in rows
    ]))
    return spatial._measured(points.withColumn("o", listed).select("*", "o.*").drop("o"))


def test_ranges_of_the_curve_hold_every_point_of_a_box(spark, points):
    from skyledger.functions import geo

    placed = [(r.latitude_deg, r.longitude_deg, r.c) for r in points.withColumn(
        "c", geo.geo_curve(F.col("latitude_deg"), F.col("longitude_deg"))).collect()]
    assert len({c for *_, c in placed}) > 2500
    for south, north, west, east in ((40, 60, 0, 30), (-90, -80, -180, 180), (-10, 10, 170, 200), (80, 90, -180, 180),
                                     (0, 0.1, 12, 12.1), (-20, 5, -200, -150)):
        ranges = geo.curve_ranges(south, north, west, east)
        assert len(ranges) <= 34
        within = lambda lon: any(west <= lon + t <= east for t in (-360, 0, 360))
        for lat, lon, c in placed:
            if south <= lat <= north and within(lon):
                assert any(a <= c <= b for a, b in ranges), (lat, lon, south, north, west, east)
        share = sum(b - a + 1 for a, b in ranges) / 4 ** geo.CURVE_BITS
        assert share <= 4 * (north - south + 2) * min(360, east - west + 4) / 64800


def test_known_distances(spark):
    rows = spark.createDataFrame(
        [(52.52, 13.40), (48.8566, 2.3522), (-52.52, -166.6), (0.0, 1.0)],
        "latitude_deg double, longitude_deg double",
    )
    here, paris, antipode, _ = [r.distance_km for r in spatial.distances_from(rows, 52.52, 13.40).collect()]
    assert here == 0.0 and paris == pytest.approx(879.6, abs=1.0)
    assert antipode == pytest.approx(20003.9, abs=40)
    equator = spatial.distances_from(rows, 0.0, 0.0).collect()[3].distance_km
    assert equator == pytest.approx(111.3195, abs=0.001)


def test_within_fifty_kilometres(spark):
    rows = spark.createDataFrame(
        [(1, 52.52, 13.40), (2, -33.9, 151.2)], "norad_cat_id int, latitude_deg double, longitude_deg double"
    )
    assert [r.norad_cat_id for r in spatial.within_radius(rows, 52.5, 13.5, 50.0).collect()] == [1]


@pytest.mark.parametrize("radius", [60.0, 900.0, 7000.0, 19000.0])
def test_cells_lose_no_pair(points, places, radius):
    want = _pairs(points, places).where(F.col("distance_km") <= radius)
    got = spatial.within_radius_of(points, places, radius)
    assert same_rows(want.select("norad_cat_id", "observer_id"), got.select("norad_cat_id", "observer_id"))


@pytest.mark.parametrize("k", [1, 10, 400, 5000])
def test_nearest_equals_brute_force(points, places, k):
    w = Window.partitionBy("observer_id").orderBy("distance_km", "norad_cat_id")
    want = _pairs(points, places).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    columns = ("observer_id", "norad_cat_id", "rank")
    assert same_rows(want.select(*columns), spatial.nearest_to(points, places, k).select(*columns))


def test_hot_cell(spark, places):
    crowd = spark.range(2000).select(
        F.col("id").cast("int").alias("norad_cat_id"),
        F.when(F.col("id") % 3 == 0, 52.5).otherwise(F.col("id") * 7 % 180 - 90.0).alias("latitude_deg"),
        F.when(F.col("id") % 3 == 0, 13.4).otherwise(F.col("id") * 11 % 360 - 180.0).alias("longitude_deg"),
    )
    w = Window.partitionBy("observer_id").orderBy("distance_km", "norad_cat_id")
    want = _pairs(crowd, places).withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    columns = ("observer_id", "norad_cat_id", "rank")
    assert same_rows(want.select(*columns), spatial.nearest_to(crowd, places, 20).select(*columns))


def test_single_place(points):
    got = [r.norad_cat_id for r in spatial.nearest(points, 52.52, 13.40, 5).collect()]
    want = [r.norad_cat_id for r in spatial.distances_from(points, 52.52, 13.40)
            .orderBy("distance_km", "norad_cat_id").limit(5).collect()]
    assert got == want
