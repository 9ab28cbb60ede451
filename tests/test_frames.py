import math

import pytest
from pyspark.sql import functions as F

from skyledger.functions import frames
from skyledger.operators.visibility import look_angles

POINTS = [
    (1.5, 77.25, 0.0), (47.0, -71.5, 0.25), (-22.75, 114.0, 615.0), (88.4, -33.0, 505.0),
    (-87.6, 171.75, 41000.0), (36.5, -180.0, 705.0), (-2.25, 95.5, 19100.0), (64.8, 25.5, 1340.0),
]


def test_gmst_at_j2000(spark):
    row = spark.range(1).select(F.degrees(frames.gmst_radians(F.lit(2451545.0))).alias("g")).first()
    assert row.g == pytest.approx(280.46061837, abs=1e-6)


@pytest.mark.parametrize("jd", [2451911.25, 2447893.5, 2455197.75, 2458849.5, 2466154.0])
def test_gmst_against_the_other_form_of_the_polynomial(spark, jd):
    # Degrees form published with the same theory: independent constants and arithmetic.
    t = (jd - 2451545.0) / 36525.0
    degrees = (280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * t * t
               - t**3 / 38710000.0)
    got = spark.range(1).select(F.degrees(frames.gmst_radians(F.lit(jd))).alias("g")).first().g
    assert abs((got - degrees + 180.0) % 360.0 - 180.0) < 1e-5
    assert 0.0 <= got < 360.0


def test_geodetic_round_trip(spark):
    rows = spark.createDataFrame(POINTS, "latitude_deg double, longitude_deg double, altitude_km double")
    ecef = frames.with_ecef_from_geodetic(rows)
    back = frames.with_geodetic_from_ecef(ecef, out=("lat", "lon", "alt"))
    for r in back.collect():
        assert r.lat == pytest.approx(r.latitude_deg, abs=1e-6)
        assert abs((r.lon - r.longitude_deg + 180) % 360 - 180) < 1e-6
        assert r.alt == pytest.approx(r.altitude_km, abs=1e-4)


def test_pole_and_geocentric_difference(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0, frames.WGS84_B_KM), (4500.0, 0.0, 4500.0)],
        "ecef_x_km double, ecef_y_km double, ecef_z_km double",
    )
    pole, slanted = frames.with_geodetic_from_ecef(rows).collect()
    assert pole.latitude_deg == pytest.approx(90.0) and pole.altitude_km == pytest.approx(0, abs=1e-6)
    assert 0.1 < slanted.latitude_deg - 45.0 < 0.25


def test_rotation_keeps_length_and_z(spark):
    rows = spark.createDataFrame(
        [(7000.0, -1200.0, 300.0)], "position_x_km double, position_y_km double, position_z_km double"
    )
    r = frames.with_ecef_from_teme(rows, F.lit(2452153.5)).first()
    assert math.hypot(r.ecef_x_km, r.ecef_y_km) == pytest.approx(math.hypot(7000, 1200))
    assert r.ecef_z_km == 300.0


def test_julian_split_is_exact(spark):
    ts = F.lit("2021-07-18T21:59:56.518368Z").cast("timestamp")
    day, fraction = frames.julian_day_and_fraction(ts)
    r = spark.range(1).select(day.alias("d"), fraction.alias("f")).first()
    assert r.d == 2459413.5
    assert r.f == pytest.approx((21 * 3600 + 59 * 60 + 56.518368) / 86400, abs=1e-15)


def _seen(spark, lat, lon, alt):
    rows = spark.createDataFrame(
        [(lat, lon, alt)], "latitude_deg double, longitude_deg double, altitude_km double"
    )
    return look_angles(rows, [(1, 52.52, 13.40, 0.0)]).first()


def test_overhead(spark):
    r = _seen(spark, 52.52, 13.40, 400.0)
    assert r.elevation_deg == pytest.approx(90.0, abs=1e-4)
    assert r.range_km == pytest.approx(400.0, abs=1e-6)


@pytest.mark.parametrize("bearing", [0, 37, 90, 144, 180, 233, 270, 359])
@pytest.mark.parametrize("here", [(-33.4, -70.7), (64.1, -21.9), (0.3, 179.6)])
def test_azimuth_is_the_bearing_of_the_ground_point(spark, here, bearing):
    """Points two degrees away on a sphere along a bearing, at 700 km."""
    lat, lon, b, arc = *map(math.radians, here), math.radians(bearing), math.radians(2.0)
    to = math.asin(math.sin(lat) * math.cos(arc) + math.cos(lat) * math.sin(arc) * math.cos(b))
    east = math.atan2(math.sin(b) * math.sin(arc) * math.cos(lat), math.cos(arc) - math.sin(lat) * math.sin(to))
    place = (math.degrees(to), (math.degrees(lon + east) + 180) % 360 - 180, 700.0)
    rows = spark.createDataFrame([place], "latitude_deg double, longitude_deg double, altitude_km double")
    r = look_angles(rows, [(1, *here, 0.0)]).first()
    assert abs((r.azimuth_deg - bearing + 180) % 360 - 180) < 0.5
    assert 0 <= r.azimuth_deg < 360 and 65 < r.elevation_deg < 75


def test_far_side_is_below_horizon(spark):
    assert _seen(spark, -52.52, -166.6, 400.0).elevation_deg < -80
