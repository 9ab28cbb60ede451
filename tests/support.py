from datetime import datetime, timezone

SF = "/root/testdata/sf0.001"
ELEMENTS = (
    "norad_cat_id int, object_name string, epoch timestamp, mean_motion double, "
    "eccentricity double, inclination double, ra_of_asc_node double, arg_of_pericenter double, "
    "mean_anomaly double, bstar double"
)
ISS_EPOCH = datetime(2021, 7, 18, 21, 59, 56, 518368, tzinfo=timezone.utc)
ISS = (25544, "ISS (ZARYA)", ISS_EPOCH, 15.48815520, 0.0003456, 51.6423, 194.0154, 92.8797,
       333.0031, 0.0)
GEO = (40000, "GEO", ISS_EPOCH, 1.0027, 0.0002, 3.75, 71.25, 210.5, 18.125, 0.0)


def same_rows(a, b) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
