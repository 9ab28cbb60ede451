"""Data-quality checks as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.ordered import OrderedGroups
from skyledger.schemas import FRESHNESS_HOURS, OBJECT_TYPES, ORBIT_REGIMES, Feed


class CheckFailure(RuntimeError):
    """At least one check of error severity found violations."""


@dataclass(frozen=True)
class RowCheck:
    """A condition every row has to meet; a NULL outcome is not a failure."""

    model: str
    name: str
    column: str
    expression: str
    severity: str = "error"

    @property
    def violated(self) -> Column:
        return F.coalesce(~F.expr(self.expression), F.lit(False))


def not_null(model: str, *columns: str) -> list[RowCheck]:
    return [RowCheck(model, "not_null", c, f"{c} IS NOT NULL") for c in columns]


def accepted_values(model: str, column: str, values: tuple[str, ...]) -> RowCheck:
    listed = ", ".join(f"'{v}'" for v in values)
    return RowCheck(model, "accepted_values", column, f"{column} IN ({listed})")


def in_range(model: str, column: str, condition: str) -> RowCheck:
    return RowCheck(model, "expression", column, condition)


ROW_CHECKS: tuple[RowCheck, ...] = (
    *not_null("raw_gp", "norad_cat_id", "epoch", "source_file"),
    *not_null("raw_satcat", "norad_cat_id", "object_type", "source_file"),
    *not_null("stg_gp", "norad_cat_id", "epoch", "ingest_ts"),
    *not_null("stg_satcat", "norad_cat_id", "object_type", "ingest_ts"),
    *not_null("space_object", "norad_cat_id", "object_type", "ingest_ts"),
    RowCheck("space_object", "expression", "decay_date",
             "(ops_status_code = 'D') = (decay_date IS NOT NULL)"),
    *not_null("elset", "norad_cat_id", "epoch", "valid_from", "is_current", "eccentricity",
              "inclination", "mean_motion"),
    in_range("elset", "eccentricity", "eccentricity >= 0 AND eccentricity < 1"),
    in_range("elset", "inclination", "inclination >= 0 AND inclination <= 180"),
    in_range("elset", "ra_of_asc_node", "ra_of_asc_node >= 0 AND ra_of_asc_node < 360"),
    in_range("elset", "arg_of_pericenter", "arg_of_pericenter >= 0 AND arg_of_pericenter < 360"),
    in_range("elset", "mean_anomaly", "mean_anomaly >= 0 AND mean_anomaly < 360"),
    in_range("elset", "mean_motion", "mean_motion > 0 AND mean_motion < 20"),
    *not_null("dim_object", "norad_cat_id", "object_type", "orbit_regime", "is_decayed",
              "is_earth_orbiting", "ingest_ts"),
    accepted_values("dim_object", "object_type", OBJECT_TYPES),
    accepted_values("dim_object", "orbit_regime", ORBIT_REGIMES),
    *not_null("fact", "norad_cat_id", "epoch", "mean_motion", "eccentricity"),
)

UNIQUE_KEYS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("space_object", ("norad_cat_id",)),
    ("elset", ("norad_cat_id", "epoch")),
    ("dim_object", ("norad_cat_id",)),
    ("fact", ("norad_cat_id",)),
)

_RESULT = ("model", "check", "column", "severity", "failures")
_RESULT_SCHEMA = "model string, check string, column string, severity string, failures long"


def row_checks_of(model: str) -> list[RowCheck]:
    return [c for c in ROW_CHECKS if c.model == model]


class Watched:
    """Row checks of a table, counted while it is written or read for something else."""

    def __init__(self, model: str) -> None:
        self.checks, self.counts = row_checks_of(model), Observation()

    def over(self, df: DataFrame) -> DataFrame:
        """The rows, unchanged; their violations are counted as they pass."""
        return df.observe(self.counts, *_counts(self.checks))

    def results(self, spark: SparkSession) -> DataFrame:
        """Violation counts, once the rows have passed."""
        found = self.counts.get
        rows = [(c.model, c.name, c.column, c.severity, found[f"_{i}"]) for i, c in enumerate(self.checks)]
        return spark.createDataFrame(rows, _RESULT_SCHEMA)


def _counts(checks: list[RowCheck]) -> list[Column]:
    return [F.count_if(c.violated).alias(f"_{i}") for i, c in enumerate(checks)]


def row_check_counts(df: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """Violations of all row checks of one table, in a single aggregation over it."""
    counts = df.agg(*_counts(checks))
    rows = [
        F.struct(
            F.lit(c.model).alias("model"), F.lit(c.name).alias("check"),
            F.lit(c.column).alias("column"), F.lit(c.severity).alias("severity"),
            F.col(f"_{i}").alias("failures"),
        )
        for i, c in enumerate(checks)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def violating_rows(df: DataFrame, check: RowCheck) -> DataFrame:
    """The rows that break a check."""
    return df.where(check.violated)


def repeated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys held by more than one row; keys with a NULL do not count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, key: str = "norad_cat_id") -> DataFrame:
    """Keys of the child table that the parent does not hold."""
    return child.where(F.col(key).isNotNull()).select(key).distinct().join(
        parent.select(key), key, "left_anti"
    )


def many_current(elsets: DataFrame) -> DataFrame:
    """Objects with a number of current element sets other than one."""
    return elsets.where("is_current").groupBy("norad_cat_id").agg(
        F.count(F.lit(1)).alias("current_row_count")
    ).where("current_row_count <> 1")


def broken_intervals(elsets: DataFrame) -> DataFrame:
    """Intervals that do not end where the object's next one starts, or run backwards."""
    intervals = elsets.select("norad_cat_id", "valid_from", "valid_to")
    groups = OrderedGroups(
        intervals, ["norad_cat_id"], ["valid_from"]
    ).neighbours(following={"next_valid_from": "valid_from"})
    return groups.result().where(
        ~F.col("valid_to").eqNullSafe(F.col("next_valid_from"))
        | (F.col("valid_to") <= F.col("valid_from"))
    )


def history_counts(elsets: DataFrame) -> DataFrame:
    """Violations of the three checks on an object's history, behind one exchange on the object.

    Repeated (object, epoch), several current rows, and intervals that do not meet: a row and its
    neighbours in time decide all of them.
    """
    rows = elsets.select("norad_cat_id", "epoch", "valid_from", "valid_to", "is_current")
    groups = OrderedGroups(rows, ["norad_cat_id"], ["valid_from", "epoch"]).neighbours(
        previous={"_epoch_before": "epoch"}, following={"_epoch_after": "epoch", "_next_from": "valid_from"})
    known = F.col("norad_cat_id").isNotNull()
    repeats = known & (F.col("epoch") == F.col("_epoch_after")) & ~F.coalesce(
        F.col("epoch") == F.col("_epoch_before"), F.lit(False))
    broken = ~F.col("valid_to").eqNullSafe(F.col("_next_from")) | (F.col("valid_to") <= F.col("valid_from"))
    total = groups.result().groupBy("norad_cat_id").agg(
        F.count_if(repeats).alias("repeats"), F.count_if(F.coalesce(broken, F.lit(False))).alias("broken"),
        F.count_if("is_current").alias("current"),
    ).agg(F.sum("repeats").alias("repeats"), F.sum("broken").alias("broken"), F.count_if(F.col("current") > 1).alias("current"))
    each = [("unique", "norad_cat_id,epoch", "repeats"), ("one_current", "norad_cat_id", "current"),
            ("contiguous", "valid_to", "broken")]
    return total.select(F.inline(F.array(*[
        F.struct(F.lit("elset").alias("model"), F.lit(name).alias("check"), F.lit(column).alias("column"),
                 F.lit("error").alias("severity"), F.coalesce(F.col(count), F.lit(0)).alias("failures"))
        for name, column, count in each])))


def feed_results(raw_gp: DataFrame, raw_satcat: DataFrame, now: Column) -> DataFrame:
    """Freshness of both feeds and their coupling, as results that `require_passed` can refuse."""
    aged = freshness(raw_gp, "gp", now).unionByName(freshness(raw_satcat, "satcat", now)).select(
        F.concat(F.lit("raw_"), "feed").alias("model"), F.lit("freshness").alias("check"),
        F.lit("ingest_ts").alias("column"), F.when(F.col("status") == "error", "error").otherwise("warn").alias("severity"),
        (F.col("status") != "pass").cast("long").alias("failures"))
    coupled = decay_coupling(raw_gp, raw_satcat).select(
        F.lit("raw_satcat").alias("model"), F.lit("coupling").alias("check"), F.lit("ingest_ts").alias("column"),
        F.lit("warn").alias("severity"),
        F.coalesce(F.col("decay_gate_may_be_stale"), F.lit(True)).cast("long").alias("failures"))
    return aged.unionByName(coupled)


def _counted(df: DataFrame, model: str, check: str, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(model).alias("model"), F.lit(check).alias("check"), F.lit(column).alias("column"),
        F.lit("error").alias("severity"), "failures",
    )


def freshness(table: DataFrame, feed: str, now: Column) -> DataFrame:
    """Age of a feed's newest row, and the severity its policy assigns to it."""
    warn, error = FRESHNESS_HOURS[feed]
    age = (F.unix_micros(now) - F.unix_micros("newest")) / F.lit(3.6e9)
    return table.agg(F.max("ingest_ts").alias("newest")).select(
        F.lit(feed).alias("feed"), "newest", age.alias("age_hours"),
        F.when(F.col("newest").isNull() | (age > error), "error").when(age > warn, "warn")
        .otherwise("pass").alias("status"),
    )


def decay_coupling(gp: DataFrame, satcat: DataFrame) -> DataFrame:
    """Is the catalogue older than the element sets, so that decays may be missing?"""
    newest = gp.agg(F.max("ingest_ts").alias("gp_newest")).withColumn("_one", F.lit(1)).join(
        satcat.agg(F.max("ingest_ts").alias("satcat_newest")).withColumn("_one", F.lit(1)), "_one"
    )
    return newest.select(
        "gp_newest", "satcat_newest",
        (F.col("gp_newest") > F.col("satcat_newest")).alias("decay_gate_may_be_stale"),
    )


def below_ground(positions: DataFrame, inclinations: DataFrame, slack_deg: float = 0.26) -> DataFrame:
    """Positions no orbit can have: under the surface, or beyond the inclination's reach."""
    reach = inclinations.select(
        "norad_cat_id",
        F.least(F.col("inclination").cast("double"), 180.0 - F.col("inclination").cast("double"))
        .alias("_reach"),
    )
    return positions.join(reach, "norad_cat_id", "left").where(
        (F.col("altitude_km") <= 0)
        | (F.abs("latitude_deg") > 90)
        | (F.abs("latitude_deg") > F.col("_reach") + slack_deg)
    ).drop("_reach")


def require_columns(df: DataFrame, feed: Feed) -> None:
    """Fail unless a table has the feed's columns, in order."""
    if tuple(df.columns) != feed.columns:
        raise CheckFailure(f"{feed.name}: expected {feed.columns}, found {tuple(df.columns)}")


def run_checks(tables: Mapping[str, DataFrame], watched: Sequence[DataFrame] = ()) -> DataFrame:
    """Violation counts of every check whose tables are given.

    `watched` are results of row checks that were counted before; their tables are not read for
    these again.
    """
    results = list(watched)
    for model, df in tables.items():
        checks = row_checks_of(model)
        if checks and not watched:
            results.append(row_check_counts(df, checks))
    for model, keys in UNIQUE_KEYS:
        if model in tables and model != "elset":
            results.append(
                _counted(repeated_keys(tables[model], keys), model, "unique", ",".join(keys))
            )
    if "fact" in tables and "dim_object" in tables:
        orphans = missing_parents(tables["fact"], tables["dim_object"])
        results.append(_counted(orphans, "fact", "relationship", "norad_cat_id"))
    if "elset" in tables:
        results.append(history_counts(tables["elset"]))
    merged = results[0]
    for other in results[1:]:
        merged = merged.unionByName(other)
    return merged.select(*_RESULT)


def require_passed(results: DataFrame) -> None:
    """Fail if a check of error severity has violations; nothing downstream may run then."""
    failed = results.where("severity = 'error' AND failures > 0").collect()
    if failed:
        raise CheckFailure(
            "; ".join(f"{r.model}.{r.column} {r.check}: {r.failures}" for r in failed)
        )
