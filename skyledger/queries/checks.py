"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import checks as ops
from skyledger.plans import warehouse
from skyledger.queries import base
from skyledger.queries.base import AT_SQL, query, rounded

_CONTIGUITY = """SELECT later.norad_cat_id FROM (
  SELECT norad_cat_id, valid_from, lag(valid_to) OVER w AS ended, row_number() OVER w AS place
  FROM {source} WINDOW w AS (PARTITION BY norad_cat_id ORDER BY valid_from)) later
WHERE place > 1 AND ended IS DISTINCT FROM valid_from
UNION ALL SELECT norad_cat_id FROM {source} WHERE valid_to <= valid_from
UNION ALL SELECT norad_cat_id FROM {source} s WHERE valid_to IS NOT NULL AND valid_from =
  (SELECT max(valid_from) FROM {source} m WHERE m.norad_cat_id = s.norad_cat_id)"""
_REPEATED = "SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys} HAVING count(*) > 1"


def _row_check_sql() -> str:
    parts = [
        f"SELECT '{c.model}' AS model, '{c.name}' AS \"check\", '{c.column}' AS \"column\", "
        f"'{c.severity}' AS severity, count(*) FILTER (WHERE NOT ({c.expression})) AS failures FROM {c.model}"
        for c in ops.ROW_CHECKS
    ]
    parts += [
        f"SELECT '{model}', 'unique', '{','.join(keys)}', 'error', count(*) FROM "
        f"({_REPEATED.format(keys=', '.join(keys), source=model)})"
        for model, keys in ops.UNIQUE_KEYS
    ]
    parts += [
        "SELECT 'fact', 'relationship', 'norad_cat_id', 'error', count(*) FROM "
        "(SELECT DISTINCT norad_cat_id FROM fact) WHERE norad_cat_id NOT IN (SELECT norad_cat_id FROM dim_object)",
        "SELECT 'elset', 'one_current', 'norad_cat_id', 'error', count(*) FROM "
        "(SELECT norad_cat_id FROM elset WHERE is_current GROUP BY 1 HAVING count(*) <> 1)",
        f"SELECT 'elset', 'contiguous', 'valid_to', 'error', count(*) FROM ({_CONTIGUITY.format(source='elset')})",
    ]
    return "\nUNION ALL ".join(parts)


@query("run_checks", "raw_gp raw_satcat stg_gp stg_satcat elset space_object dim_object fact",
       _row_check_sql())
def run_checks(spark, sf):
    return ops.run_checks(warehouse.layers(fx.raw_gp(spark, sf), fx.raw_satcat(spark, sf)))


@query("check_not_null", "dim_object", """
SELECT norad_cat_id FROM dim_object WHERE is_earth_orbiting IS NULL""")
def check_not_null(spark, sf):
    check, = ops.not_null("dim_object", "is_earth_orbiting")
    return ops.violating_rows(base.dim(spark, sf), check).select("norad_cat_id")


@query("check_unique", "stg_satcat", _REPEATED.format(keys="norad_cat_id", source="stg_satcat"))
def check_unique(spark, sf):
    # The staged catalogue still holds one row per landing.
    return ops.repeated_keys(base.staged_satcat(spark, sf), ("norad_cat_id",))


@query("check_unique_combination", "stg_gp", _REPEATED.format(keys="norad_cat_id, epoch", source="stg_gp"))
def check_unique_combination(spark, sf):
    return ops.repeated_keys(base.staged_gp(spark, sf), ("norad_cat_id", "epoch"))


@query("check_accepted_values", "dim_object", """
SELECT norad_cat_id, orbit_regime FROM dim_object WHERE orbit_regime NOT IN ('LEO', 'MEO')""")
def check_accepted_values(spark, sf):
    check = ops.accepted_values("dim_object", "orbit_regime", ("LEO", "MEO"))
    return ops.violating_rows(base.dim(spark, sf), check).select("norad_cat_id", "orbit_regime")


@query("check_relationship", "elset dim_object", """
SELECT DISTINCT norad_cat_id FROM elset WHERE norad_cat_id NOT IN (SELECT norad_cat_id FROM dim_object)""")
def check_relationship(spark, sf):
    return ops.missing_parents(base.elset(spark, sf), base.dim(spark, sf))


@query("check_expression", "elset", """
SELECT norad_cat_id, epoch FROM elset WHERE NOT (inclination >= 0 AND inclination <= 90)""")
def check_expression(spark, sf):
    check = ops.in_range("elset", "inclination", "inclination >= 0 AND inclination <= 90")
    return ops.violating_rows(base.elset(spark, sf), check).select("norad_cat_id", "epoch")


@query("check_decay_consistency", "stg_satcat", """
SELECT norad_cat_id, source_file FROM (SELECT * REPLACE (
    CASE WHEN norad_cat_id % 10 = 0 THEN '+' ELSE ops_status_code END AS ops_status_code) FROM stg_satcat)
WHERE NOT ((ops_status_code = 'D') = (decay_date IS NOT NULL))""")
def check_decay_consistency(spark, sf):
    # Every tenth object claims to be alive, whether it has decayed or not.
    doubtful = base.staged_satcat(spark, sf).withColumn(
        "ops_status_code",
        F.when(F.col("norad_cat_id") % 10 == 0, "+").otherwise(F.col("ops_status_code")),
    )
    check = next(c for c in ops.ROW_CHECKS if c.column == "decay_date")
    return ops.violating_rows(doubtful, check).select("norad_cat_id", "source_file")


@query("check_one_current", "elset", """
SELECT norad_cat_id, count(*) AS current_row_count FROM elset
WHERE is_current OR norad_cat_id % 11 = 0 GROUP BY norad_cat_id HAVING count(*) <> 1""")
def check_one_current(spark, sf):
    # Every eleventh object has all its element sets marked as current.
    spoiled = base.elset(spark, sf).withColumn(
        "is_current", F.col("is_current") | (F.col("norad_cat_id") % 11 == 0)
    )
    return ops.many_current(spoiled)


# Some intervals end an hour late, and some current ones are closed at their start.
_SPOILED = """(SELECT * REPLACE (CASE WHEN rev_at_epoch % 7 = 0 THEN valid_to + to_hours(1)
  WHEN rev_at_epoch % 7 = 1 AND is_current THEN valid_from ELSE valid_to END AS valid_to) FROM elset)"""


@query("check_contiguity", "elset", f"""
SELECT a.norad_cat_id, a.valid_from, a.valid_to, min(b.valid_from) AS next_valid_from
FROM {_SPOILED} a LEFT JOIN elset b ON b.norad_cat_id = a.norad_cat_id AND b.valid_from > a.valid_from
GROUP BY ALL HAVING a.valid_to IS DISTINCT FROM min(b.valid_from) OR a.valid_to <= a.valid_from""")
def check_contiguity(spark, sf):
    turn = F.col("rev_at_epoch") % 7
    spoiled = base.elset(spark, sf).withColumn(
        "valid_to",
        F.when(turn == 0, F.col("valid_to") + F.make_interval(hours=F.lit(1)))
        .when((turn == 1) & F.col("is_current"), F.col("valid_from")).otherwise(F.col("valid_to")),
    )
    return ops.broken_intervals(spoiled)


def _freshness_sql(feed: str, view: str, warn: float, error: float) -> str:
    age = f"(epoch_us({AT_SQL}) - epoch_us(max(ingest_ts))) / 3.6e9"
    return (
        f"SELECT '{feed}' AS feed, max(ingest_ts) AS newest, round({age}, 4) + 0e0 AS age_hours, "
        f"CASE WHEN {age} > {error} THEN 'error' WHEN {age} > {warn} THEN 'warn' ELSE 'pass' END AS status FROM {view}"
    )


@query("check_freshness", "raw_gp raw_satcat",
       _freshness_sql("gp", "raw_gp", 4, 12) + " UNION ALL " + _freshness_sql("satcat", "raw_satcat", 24, 48))
def check_freshness(spark, sf):
    now = fx.snapshot_ts()
    return rounded(
        ops.freshness(fx.raw_gp(spark, sf), "gp", now).unionByName(
            ops.freshness(fx.raw_satcat(spark, sf), "satcat", now)
        )
    )


@query("check_decay_coupling", "raw_gp raw_satcat", """
SELECT g AS gp_newest, s AS satcat_newest, g > s AS decay_gate_may_be_stale
FROM (SELECT max(ingest_ts) AS g FROM raw_gp), (SELECT max(ingest_ts) AS s FROM raw_satcat)""")
def check_decay_coupling(spark, sf):
    return ops.decay_coupling(fx.raw_gp(spark, sf), fx.raw_satcat(spark, sf))


@query("check_schema_order", "raw_gp raw_satcat", """
SELECT 'gp' AS feed, row_number() OVER () AS place, column_name AS "column", count AS n_filled
FROM (SELECT * FROM (SELECT count(COLUMNS(*)) FROM raw_gp) UNPIVOT INCLUDE NULLS (count FOR column_name IN (COLUMNS(*))))
UNION ALL
SELECT 'satcat', row_number() OVER (), column_name, count
FROM (SELECT * FROM (SELECT count(COLUMNS(*)) FROM raw_satcat) UNPIVOT INCLUDE NULLS (count FOR column_name IN (COLUMNS(*))))""")
def check_schema_order(spark, sf):
    """Both feeds have their declared columns in order; and how many rows fill each of them."""
    from skyledger.schemas import GP, SATCAT

    out = None
    for feed, rows in ((GP, fx.raw_gp(spark, sf)), (SATCAT, fx.raw_satcat(spark, sf))):
        ops.require_columns(rows, feed)
        counts = rows.agg(F.array(*[
            F.struct(F.lit(i).cast("long").alias("place"), F.lit(c).alias("column"), F.count(c).alias("n_filled"))
            for i, c in enumerate(rows.columns, 1)]).alias("each"))
        one = counts.select(F.lit(feed.name).alias("feed"), F.inline("each"))
        out = one if out is None else out.unionByName(one)
    return out


@query("check_above_ground", "positions fact", """
SELECT norad_cat_id FROM positions JOIN fact USING (norad_cat_id)
WHERE altitude_km <= 0 OR abs(latitude_deg) > 90
  OR abs(latitude_deg) > least(cast(inclination AS DOUBLE), 180 - cast(inclination AS DOUBLE)) - 5.0""")
def check_above_ground(spark, sf):
    # A stricter reach than the check's own, so that rows are found.
    return ops.below_ground(
        base.positions(spark, sf), base.fact(spark, sf), slack_deg=-5.0
    ).select("norad_cat_id")
