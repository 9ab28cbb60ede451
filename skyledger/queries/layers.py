"""Staging, silver and gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import enrich, gold, silver, summaries
from skyledger.queries import base
from skyledger.queries.base import AT_SQL, LINEAGE, SATCAT_PLAIN, gp_plain, plain, query


@query("stg_gp", "stg_gp", f"SELECT * REPLACE ({gp_plain()}) FROM stg_gp")
def stg_gp(spark, sf):
    return plain(base.staged_gp(spark, sf))


@query("stg_satcat", "stg_satcat", f"SELECT * REPLACE ({SATCAT_PLAIN}) FROM stg_satcat")
def stg_satcat(spark, sf):
    return plain(base.staged_satcat(spark, sf))


@query("feeds_union", "raw_gp raw_satcat", f"""
SELECT 'gp' AS feed, {LINEAGE}, norad_cat_id FROM raw_gp
UNION ALL SELECT 'satcat', {LINEAGE}, norad_cat_id FROM raw_satcat""")
def feeds_union(spark, sf):
    shared = ("ingest_ts", "ingestion_id", "source", "source_file", "target", "norad_cat_id")
    gp = fx.raw_gp(spark, sf).select(F.lit("gp").alias("feed"), *shared)
    return gp.unionByName(fx.raw_satcat(spark, sf).select(F.lit("satcat").alias("feed"), *shared))


@query("dedup_earliest", "elset_first", f"SELECT * REPLACE ({gp_plain()}) FROM elset_first")
def dedup_earliest(spark, sf):
    return plain(silver.dedup_earliest(base.staged_gp(spark, sf)))


@query("scd2_intervals", "elset", "SELECT norad_cat_id, epoch, valid_from, valid_to, is_current FROM elset")
def scd2_intervals(spark, sf):
    return silver.with_validity(silver.dedup_earliest(base.staged_gp(spark, sf))).select(
        "norad_cat_id", "epoch", "valid_from", "valid_to", "is_current"
    )


@query("elset", "elset", f"SELECT * REPLACE ({gp_plain()}) FROM elset")
def elset(spark, sf):
    return plain(base.elset(spark, sf))


@query("filter_current", "elset", "SELECT norad_cat_id, epoch, source_file FROM elset WHERE is_current")
def filter_current(spark, sf):
    return gold.current_only(base.elset(spark, sf)).select("norad_cat_id", "epoch", "source_file")


@query("dedup_latest", "space_object", f"SELECT * REPLACE ({SATCAT_PLAIN}) FROM space_object")
def dedup_latest(spark, sf):
    return plain(base.space_object(spark, sf))


@query("dim_object", "dim_object", f"""
SELECT * REPLACE ({SATCAT_PLAIN}, cast(is_earth_orbiting AS VARCHAR) AS is_earth_orbiting) FROM dim_object""")
def dim_object(spark, sf):
    flags = {"is_earth_orbiting": F.col("is_earth_orbiting").cast("string")}
    return plain(base.dim(spark, sf).withColumns(flags))


@query("is_decayed", "dim_object", "SELECT norad_cat_id, is_decayed FROM dim_object")
def is_decayed(spark, sf):
    return base.space_object(spark, sf).select(
        "norad_cat_id", gold.is_decayed(F.col("decay_date")).alias("is_decayed")
    )


@query("is_earth_orbiting", "dim_object", "SELECT norad_cat_id, orbit_center, cast(is_earth_orbiting AS VARCHAR) AS is_earth_orbiting FROM dim_object")
def is_earth_orbiting(spark, sf):
    return base.space_object(spark, sf).select(
        "norad_cat_id", "orbit_center",
        gold.is_earth_orbiting(F.col("orbit_center")).cast("string").alias("is_earth_orbiting"),
    )


@query("orbit_regime", "dim_object", "SELECT orbit_regime, count(*) AS n_objects FROM dim_object GROUP BY orbit_regime")
def orbit_regime(spark, sf):
    regime = gold.orbit_regime(F.col("apogee_km")).alias("orbit_regime")
    return base.space_object(spark, sf).groupBy(regime).agg(F.count(F.lit(1)).alias("n_objects"))


@query("filter_gates", "dim_object", """
SELECT norad_cat_id, orbit_regime FROM dim_object WHERE NOT is_decayed AND is_earth_orbiting""")
def filter_gates(spark, sf):
    return gold.propagatable_objects(base.dim(spark, sf)).select("norad_cat_id", "orbit_regime")


@query("fact_propagatable", "fact", f"SELECT * REPLACE ({gp_plain()}) FROM fact")
def fact_propagatable(spark, sf):
    return plain(base.fact(spark, sf))


@query("scan_propagatable", "fact", "SELECT norad_cat_id, epoch FROM fact ORDER BY norad_cat_id")
def scan_propagatable(spark, sf):
    return gold.ordered_by_id(base.fact(spark, sf)).select("norad_cat_id", "epoch")


@query("order_by_id_limit", "fact", "SELECT norad_cat_id, epoch FROM fact ORDER BY norad_cat_id LIMIT 25")
def order_by_id_limit(spark, sf):
    return gold.ordered_by_id(base.fact(spark, sf), 25).select("norad_cat_id", "epoch")


@query("scan_dimension", "dim_object", """
SELECT norad_cat_id, object_name, object_type, orbit_regime, owner,
       cast(launch_date AS VARCHAR) AS launch_date, launch_site FROM dim_object""")
def scan_dimension(spark, sf):
    from skyledger.schemas import DIMENSION_COLUMNS

    return plain(base.dim(spark, sf).select(*DIMENSION_COLUMNS))


@query("orphan_keys", "elset dim_object", """
SELECT DISTINCT norad_cat_id FROM elset WHERE norad_cat_id NOT IN (SELECT norad_cat_id FROM dim_object)""")
def orphan_keys(spark, sf):
    return gold.orphan_keys(base.elset(spark, sf), base.dim(spark, sf))


@query("coverage_by_type", "dim_object fact", """
SELECT object_type, count(*) AS in_orbit, count(f.norad_cat_id) AS with_elset
FROM dim_object d LEFT JOIN fact f USING (norad_cat_id) WHERE NOT d.is_decayed GROUP BY object_type""")
def coverage_by_type(spark, sf):
    return gold.coverage_by_type(base.dim(spark, sf), base.fact(spark, sf))


PROBES = """(SELECT cast(o_custkey AS INTEGER) AS norad_cat_id, o_orderkey AS probe_id,
  o_orderdate + to_days(cast(o_orderkey % 400 AS INTEGER) - 200) AS at FROM orders)"""


@query("asof_elset", "elset", f"""
SELECT p.norad_cat_id, p.probe_id, p.at, e.epoch, e.valid_to
FROM {PROBES} p LEFT JOIN elset e ON p.norad_cat_id = e.norad_cat_id
  AND e.valid_from <= p.at AND (e.valid_to IS NULL OR p.at < e.valid_to)""")
def asof_elset(spark, sf):
    k = F.col("o_orderkey")
    probes = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("int").alias("norad_cat_id"),
        k.alias("probe_id"),
        (F.col("o_orderdate").cast("timestamp")
         + F.make_dt_interval((k % 400 - 200).cast("int"))).alias("at"),
    )
    return silver.asof_elset(probes, base.elset(spark, sf), measured=base.staged_gp(spark, sf))


# ---- Counts over the layers --------------------------------------------------------------

@query("count_distinct_landed", "raw_gp", """
SELECT count(*) AS n_rows, count(DISTINCT norad_cat_id) AS n_objects FROM raw_gp""")
def count_distinct_landed(spark, sf):
    return summaries.landed_counts(fx.raw_gp(spark, sf))


@query("count_filter_current", "elset", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_current) AS n_current FROM elset""")
def count_filter_current(spark, sf):
    return summaries.current_counts(base.elset(spark, sf))


@query("age_summary", "fact", f"""
SELECT count(*) FILTER (WHERE epoch < {AT_SQL} - INTERVAL 7 DAY) AS over_limit,
  round(avg((epoch_us({AT_SQL}) - epoch_us(epoch)) / 3.6e9), 4) + 0e0 AS avg_age_h FROM fact""")
def age_summary(spark, sf):
    return base.rounded(summaries.age_summary(base.fact(spark, sf), fx.snapshot_ts()))


@query("layer_counts", "raw_gp raw_satcat elset dim_object fact", """
SELECT (SELECT count(*) FROM raw_gp) AS raw_gp, (SELECT count(*) FROM raw_satcat) AS raw_satcat,
  (SELECT count(*) FROM elset) AS elset, (SELECT count(*) FROM dim_object) AS dim_object,
  (SELECT count(*) FROM fact) AS propagatable""")
def layer_counts(spark, sf):
    return summaries.layer_counts({
        "raw_gp": fx.raw_gp(spark, sf), "raw_satcat": fx.raw_satcat(spark, sf),
        "elset": base.elset(spark, sf), "dim_object": base.dim(spark, sf),
        "propagatable": base.fact(spark, sf),
    })


@query("group_having", "stg_gp", """
SELECT norad_cat_id, epoch, count(*) AS n FROM stg_gp GROUP BY norad_cat_id, epoch HAVING count(*) <> 1""")
def group_having(spark, sf):
    return summaries.groups_having(
        base.staged_gp(spark, sf), ["norad_cat_id", "epoch"], F.col("n") != 1
    )


@query("duplicate_names", "dim_object", """
SELECT object_name, count(DISTINCT norad_cat_id) AS n_objects FROM dim_object
WHERE object_name IS NOT NULL GROUP BY object_name HAVING count(DISTINCT norad_cat_id) > 1""")
def duplicate_names(spark, sf):
    return summaries.duplicate_names(base.dim(spark, sf))


@query("name_cardinality", "dim_object", """
SELECT count(DISTINCT object_name) AS n_names, count(DISTINCT norad_cat_id) AS n_objects FROM dim_object""")
def name_cardinality(spark, sf):
    return summaries.name_cardinality(base.dim(spark, sf))


@query("id_set_algebra", "elset dim_object", """
SELECT (SELECT count(*) FROM ({l} UNION {r})) AS n_union,
  (SELECT count(*) FROM ({l} INTERSECT {r})) AS n_both,
  (SELECT count(*) FROM ({l} EXCEPT {r})) AS n_left_only,
  (SELECT count(*) FROM ({r} EXCEPT {l})) AS n_right_only""".format(
    l="SELECT norad_cat_id FROM elset",
    r="SELECT norad_cat_id FROM dim_object",
))
def id_set_algebra(spark, sf):
    return summaries.id_algebra(base.elset(spark, sf), base.dim(spark, sf))


@query("rename_to_omm", "fact", """
SELECT object_name AS "OBJECT_NAME", object_id AS "OBJECT_ID",
  strftime(epoch, '%Y-%m-%dT%H:%M:%S.%f') AS "EPOCH",
  cast(mean_motion AS VARCHAR) AS "MEAN_MOTION", cast(eccentricity AS VARCHAR) AS "ECCENTRICITY",
  cast(inclination AS VARCHAR) AS "INCLINATION", cast(ra_of_asc_node AS VARCHAR) AS "RA_OF_ASC_NODE",
  cast(arg_of_pericenter AS VARCHAR) AS "ARG_OF_PERICENTER", cast(mean_anomaly AS VARCHAR) AS "MEAN_ANOMALY",
  cast(ephemeris_type AS VARCHAR) AS "EPHEMERIS_TYPE", classification_type AS "CLASSIFICATION_TYPE",
  cast(norad_cat_id AS VARCHAR) AS "NORAD_CAT_ID", cast(element_set_no AS VARCHAR) AS "ELEMENT_SET_NO",
  cast(rev_at_epoch AS VARCHAR) AS "REV_AT_EPOCH", cast(bstar AS VARCHAR) AS "BSTAR",
  cast(mean_motion_dot AS VARCHAR) AS "MEAN_MOTION_DOT", cast(mean_motion_ddot AS VARCHAR) AS "MEAN_MOTION_DDOT"
FROM fact""")
def rename_to_omm(spark, sf):
    from skyledger.sources.landing import to_omm

    return to_omm(base.fact(spark, sf))


@query("object_label", "dim_object", """
SELECT norad_cat_id, CASE WHEN object_name IS NULL THEN cast(norad_cat_id AS VARCHAR)
  ELSE object_name || ' · ' || cast(norad_cat_id AS VARCHAR) END AS label FROM dim_object""")
def object_label(spark, sf):
    label = enrich.object_label(F.col("object_name"), F.col("norad_cat_id"))
    return base.dim(spark, sf).select("norad_cat_id", label.alias("label"))


@query("launch_site_name", "dim_object", """
SELECT launch_site, CASE launch_site WHEN 'AFETR' THEN 'Cape Canaveral' WHEN 'TYMSC' THEN 'Baikonur'
    WHEN 'FRGUI' THEN 'Kourou' WHEN 'JSC' THEN 'Jiuquan' WHEN 'SRILR' THEN 'Satish Dhawan'
    WHEN 'PLMSC' THEN 'Plesetsk' ELSE launch_site END AS launch_site_name, count(*) AS n
FROM dim_object GROUP BY 1, 2""")
def launch_site_name(spark, sf):
    name = enrich.launch_site_name(F.col("launch_site")).alias("launch_site_name")
    return base.dim(spark, sf).groupBy("launch_site", name).agg(F.count(F.lit(1)).alias("n"))
