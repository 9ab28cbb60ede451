"""Declared schemas, feed descriptors and fixed lookup values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LINEAGE_COLUMNS = ("ingest_ts", "ingestion_id", "source", "source_file", "target")
PARTITION_COLUMNS = ("ingest_date", "hour", "ingestion_id")

# Payload columns of the two feeds, in file order.
GP_PAYLOAD = (
    "object_name", "object_id", "epoch", "mean_motion", "eccentricity", "inclination",
    "ra_of_asc_node", "arg_of_pericenter", "mean_anomaly", "ephemeris_type",
    "classification_type", "norad_cat_id", "element_set_no", "rev_at_epoch", "bstar",
    "mean_motion_dot", "mean_motion_ddot",
)
SATCAT_PAYLOAD = (
    "object_name", "object_id", "norad_cat_id", "object_type", "ops_status_code", "owner",
    "launch_date", "launch_site", "decay_date", "period", "inclination", "apogee",
    "perigee", "rcs", "data_status_code", "orbit_center", "orbit_type",
)


@dataclass(frozen=True)
class Feed:
    """One raw feed: where it lands, what it carries, what makes a row unique."""

    name: str
    payload: tuple[str, ...]
    key: tuple[str, ...] = ("source", "source_file", "norad_cat_id")

    def __post_init__(self) -> None:
        columns = self.columns
        if len(set(columns)) != len(columns):
            raise ValueError(f"feed {self.name}: duplicate columns")
        missing = set(self.key) - set(columns)
        if missing:
            raise ValueError(f"feed {self.name}: key columns {sorted(missing)} are not carried")

    @property
    def columns(self) -> tuple[str, ...]:
        return LINEAGE_COLUMNS + self.payload

    @property
    def payload_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.payload])

    @property
    def schema(self) -> T.StructType:
        lineage = [
            T.StructField(c, T.TimestampType() if c == "ingest_ts" else T.StringType())
            for c in LINEAGE_COLUMNS
        ]
        return T.StructType(lineage + list(self.payload_schema.fields))


GP = Feed("gp", GP_PAYLOAD)
SATCAT = Feed("satcat", SATCAT_PAYLOAD)
FEEDS = (GP, SATCAT)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("ingested_at", T.StringType()),
        T.StructField("ingestion_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("etag", T.StringType()),
    ]
)

# Columns of a position, in the order they are stored.
POSITION_COLUMNS = (
    "norad_cat_id", "snapshot_ts", "epoch", "epoch_age_hours", "latitude_deg",
    "longitude_deg", "altitude_km", "position_x_km", "position_y_km", "position_z_km",
    "velocity_x_km_s", "velocity_y_km_s", "velocity_z_km_s",
)
POSITION_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.IntegerType() if c == "norad_cat_id"
            else T.TimestampType() if c in ("snapshot_ts", "epoch")
            else T.DoubleType(),
        )
        for c in POSITION_COLUMNS
    ]
)

# The dimension's columns that positions are shown with.
DIMENSION_COLUMNS = (
    "norad_cat_id", "object_name", "object_type", "orbit_regime", "owner", "launch_date",
    "launch_site",
)

# Hours after which a position counts as stale, per orbit regime.
STALENESS_HOURS = {"LEO": 48.0, "GEO/HEO": 96.0, "MEO": 168.0, "unknown": 48.0}
DEFAULT_STALENESS_HOURS = 48.0

# Object types of the catalogue feed.
OBJECT_TYPES = ("PAY", "R/B", "DEB", "UNK")
ORBIT_REGIMES = ("LEO", "MEO", "GEO/HEO", "unknown")

# Launch-site codes of the public catalogue and their place names.
LAUNCH_SITE_NAMES = {
    "AFETR": "Cape Canaveral",
    "AFWTR": "Vandenberg",
    "DLS": "Dombarovsky",
    "ERAS": "Eastern Range air launch",
    "FRGUI": "Kourou",
    "HGSTR": "Hammaguir",
    "JSC": "Jiuquan",
    "KODAK": "Kodiak",
    "KSCUT": "Uchinoura",
    "KYMSC": "Kapustin Yar",
    "NSC": "Naro",
    "PLMSC": "Plesetsk",
    "RLLB": "Mahia, New Zealand",
    "SCSLA": "South China Sea platform",
    "SEAL": "Sea Launch platform",
    "SEMLS": "Semnan",
    "SMTS": "Shahrud",
    "SNMLP": "San Marco platform",
    "SRILR": "Satish Dhawan",
    "SVOBO": "Svobodny",
    "TAISC": "Taiyuan",
    "TANSC": "Tanegashima",
    "TYMSC": "Baikonur",
    "VOSTO": "Vostochny",
    "WLPIS": "Wallops Island",
    "WRAS": "Western Range air launch",
    "WSC": "Wenchang",
    "XICLF": "Xichang",
    "YAVNE": "Palmachim",
    "YSLA": "Yellow Sea launch platform",
}

# Policies of the feeds.
#: Seconds a landed copy of each feed may be reused before it is fetched again.
FEED_TTL_SECONDS = {"gp": 2 * 3600, "satcat": 24 * 3600}
#: Bytes that may be fetched per UTC day.
DAILY_BYTE_BUDGET = 80 * 1024 * 1024
#: Freshness policy per feed: (warn, error) in hours.
FRESHNESS_HOURS = {"gp": (4.0, 12.0), "satcat": (24.0, 48.0)}
