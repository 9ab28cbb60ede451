"""The build: bronze tables to silver and gold, checked before it is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import checks, gold, silver
from skyledger.operators.enrich import with_display_attributes
from skyledger.operators.propagate import instant, propagate
from skyledger.schemas import GP, SATCAT
from skyledger.sources.published import new_run, newest_run, publish

#: Written once per build. Staging is recomputed where it is read, and the fact is always
#: composed from the two tables it joins, so it cannot be older than either.
MATERIALISED = ("elset", "space_object", "dim_object")


def layers(raw_gp: DataFrame, raw_satcat: DataFrame) -> dict[str, DataFrame]:
    """Every layer as a lazy DataFrame."""
    stg_gp, stg_satcat = silver.stage_gp(raw_gp), silver.stage_satcat(raw_satcat)
    elset, space_object = silver.elset(stg_gp), silver.space_object(stg_satcat)
    dim = gold.dim_object(space_object)
    return {
        "raw_gp": raw_gp, "raw_satcat": raw_satcat, "stg_gp": stg_gp, "stg_satcat": stg_satcat,
        "elset": elset, "space_object": space_object, "dim_object": dim,
        "fact": gold.fact_propagatable(elset, dim),
    }


def _folder(root: str, run: str, name: str) -> str:
    return f"{root}/{run}/{'gold' if name == 'dim_object' else 'silver'}/{name}"


def build(
    spark: SparkSession, raw_gp: DataFrame, raw_satcat: DataFrame, root: str, now=None
) -> dict[str, DataFrame]:
    """Write silver, check it, then write and check gold; returns the written layers.

    A build has a folder of its own and is published with one marker after the last check. A
    failed check or an interruption leaves the version before it readable. Row checks are counted
    while rows pass on their way into a table, raw and staged ones included. With `now` the feeds
    have to be fresh at that instant, too.
    """
    run = new_run()
    checks.require_columns(raw_gp, GP)
    checks.require_columns(raw_satcat, SATCAT)
    if now is not None:
        checks.require_passed(checks.feed_results(raw_gp, raw_satcat, instant(now)))
    tables = {"raw_gp": raw_gp, "raw_satcat": raw_satcat}
    tables["stg_gp"], tables["stg_satcat"] = silver.stage_gp(raw_gp), silver.stage_satcat(raw_satcat)
    seen = {n: checks.Watched(n) for n in ("raw_gp", "raw_satcat", "stg_gp", "stg_satcat", *MATERIALISED)}

    def store(name: str, df: DataFrame) -> DataFrame:
        path = _folder(root, run, name)
        seen[name].over(df).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def results(*names: str) -> list[DataFrame]:
        return [seen[n].results(spark) for n in names]

    staged_gp = seen["stg_gp"].over(silver.stage_gp(seen["raw_gp"].over(raw_gp)))
    staged_satcat = seen["stg_satcat"].over(silver.stage_satcat(seen["raw_satcat"].over(raw_satcat)))
    tables["elset"] = store("elset", silver.elset(staged_gp, measured=tables["stg_gp"]))
    tables["space_object"] = store("space_object", silver.space_object(staged_satcat))
    silver_tables = {n: tables[n] for n in ("elset", "space_object")}
    checks.require_passed(checks.run_checks(
        silver_tables, results("raw_gp", "raw_satcat", "stg_gp", "stg_satcat", "elset", "space_object")))
    tables["dim_object"] = store("dim_object", gold.dim_object(tables["space_object"]))
    tables["fact"] = gold.fact_propagatable(tables["elset"], tables["dim_object"])
    served = {n: tables[n] for n in ("dim_object", "fact")}
    fact_rows = checks.row_check_counts(tables["fact"], checks.row_checks_of("fact"))
    checks.require_passed(checks.run_checks(served, [*results("dim_object"), fact_rows]))
    publish(spark, root, run)
    return tables


def read_built(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The layers of the published build; none if there is no such build."""
    _, run = newest_run(spark, root)
    if run is None:
        return {}
    tables = {n: spark.read.parquet(_folder(root, run, n)) for n in MATERIALISED}
    return tables | {"fact": gold.fact_propagatable(tables["elset"], tables["dim_object"])}


def sky_now(
    fact: DataFrame, dim: DataFrame, at, *, kernel: str = "j2", objects=None
) -> DataFrame:
    """Positions of the catalogue at one instant with everything a display needs.

    `objects` is an optional predicate on catalogue columns. It is applied before the
    propagation, because the optimizer does not move a filter through the kernel.
    """
    chosen = dim if objects is None else dim.where(objects)
    if objects is not None:
        fact = fact.join(chosen.select("norad_cat_id"), "norad_cat_id", "left_semi")
    return with_display_attributes(propagate(fact, at, kernel=kernel), chosen)


def _sky_folder(spark: SparkSession, at, root: str, kernel: str) -> str:
    micros = spark.range(1).select(F.unix_micros(instant(at))).first()[0]
    return f"{root}/kernel={kernel}/at={micros}"


def _store_sky(sky: DataFrame, folder: str) -> DataFrame:
    spark, run = sky.sparkSession, new_run()
    sky.write.parquet(f"{folder}/{run}")
    publish(spark, folder, run)
    return spark.read.schema(sky.schema).parquet(f"{folder}/{run}")


def stored_sky(fact: DataFrame, dim: DataFrame, at, root: str, *, kernel: str = "j2") -> DataFrame:
    """The whole sky at one instant, computed once and read from then on.

    Filters on the result are ordinary filters on a stored table, so questions about one instant
    don't propagate the catalogue again. `refresh_sky` brings it up to a new catalogue.
    """
    spark = fact.sparkSession
    folder = _sky_folder(spark, at, root, kernel)
    _, run = newest_run(spark, folder)
    if run is None:
        return _store_sky(sky_now(fact, dim, at, kernel=kernel), folder)
    return spark.read.parquet(f"{folder}/{run}")


def changed_elsets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a fact whose object had another element set in force before, or none."""
    elements = [c for c in silver.GP_TYPES if c in after.columns]
    same = lambda df: df.select("norad_cat_id", F.xxhash64(*elements).alias("_in_force"))
    stamped = after.withColumn("_in_force", F.xxhash64(*elements))
    return stamped.join(same(before), ["norad_cat_id", "_in_force"], "left_anti").select(*after.columns)


def refresh_sky(
    before: DataFrame, fact: DataFrame, dim: DataFrame, at, root: str, *, kernel: str = "j2"
) -> DataFrame:
    """Bring a stored sky from the fact `before` to a new one.

    Only objects whose element set in force has changed are propagated. The positions of the others
    stay, those of objects no longer in the fact go; attributes are those of `dim`, as a whole.
    """
    spark = fact.sparkSession
    stored = stored_sky(before, dim, at, root, kernel=kernel)
    changed = changed_elsets(before, fact)
    unchanged = fact.select("norad_cat_id").join(changed.select("norad_cat_id"), "norad_cat_id", "left_anti")
    fresh = propagate(changed, at, kernel=kernel)
    kept = stored.select(*fresh.columns).join(unchanged, "norad_cat_id", "left_semi")
    sky = with_display_attributes(kept.unionByName(fresh), dim)
    return _store_sky(sky, _sky_folder(spark, at, root, kernel))
