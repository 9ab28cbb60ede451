"""Counts and summaries over the layers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def landed_counts(raw: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Rows and distinct objects of a bronze table."""
    distinct = (
        F.approx_count_distinct("norad_cat_id") if approximate else F.countDistinct("norad_cat_id")
    )
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_objects"))


def current_counts(elsets: DataFrame) -> DataFrame:
    """All element sets and the current ones."""
    return elsets.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_current").alias("n_current")
    )


def altitude_extent(positions: DataFrame) -> DataFrame:
    exact = [f(F.col("altitude_km")).cast("decimal(20,6)") for f in (F.min, F.max)]
    return positions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(exact[0], 1).alias("min_alt"),
        F.round(exact[1], 1).alias("max_alt"),
    )


def age_summary(fact: DataFrame, now: Column, *, days: int = 7) -> DataFrame:
    """How many element sets are older than some days, and the mean age in hours."""
    hours = (F.unix_micros(now) - F.unix_micros("epoch")) / F.lit(3.6e9)
    return fact.agg(
        F.count_if(F.col("epoch") < now - F.make_dt_interval(F.lit(days))).alias("over_limit"),
        F.avg(hours).alias("avg_age_h"),
    )


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the row count of every layer."""
    counts = None
    for name, df in layers.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("layer") == n, F.col("n"))).alias(n) for n in layers])


def groups_having(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Groups whose row count `n` satisfies a condition."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(condition)


def dashboard_metrics(frame: DataFrame, shown: Column) -> DataFrame:
    """Rows, rows a filter leaves, and stale rows among those, in one pass."""
    return frame.agg(
        F.count_if(shown).alias("n_shown"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(shown & F.col("is_stale")).alias("n_stale"),
    )


def max_altitude(frame: DataFrame) -> DataFrame:
    return frame.agg(F.max("altitude_km").alias("max_altitude_km"))


def distinct_options(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values per column, sorted: the choices a filter offers."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("option")) for c in columns])
    )
    return (
        frame.select(pairs.alias("p")).select("p.*")
        .where(F.col("option").isNotNull()).distinct().orderBy("name", "option")
    )


def regime_age_table(frame: DataFrame, *, limit_hours: float = 48.0) -> DataFrame:
    """Per regime: objects, mean age, and how many are older than the limit."""
    old = F.col("epoch_age_hours") > limit_hours
    return frame.groupBy("orbit_regime").agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.avg("epoch_age_hours").alias("avg_age_h"),
        F.count_if(old).alias("n_old"),
        (F.count_if(old) * F.lit(100.0) / F.count(F.lit(1))).alias("pct_old"),
    )


def duplicate_names(frame: DataFrame) -> DataFrame:
    """Names carried by more than one object."""
    return (
        frame.where(F.col("object_name").isNotNull())
        .groupBy("object_name")
        .agg(F.countDistinct("norad_cat_id").alias("n_objects"))
        .where("n_objects > 1")
    )


def name_cardinality(frame: DataFrame) -> DataFrame:
    """Distinct names against distinct objects."""
    return frame.agg(
        F.countDistinct("object_name").alias("n_names"),
        F.countDistinct("norad_cat_id").alias("n_objects"),
    )


def decline_counts(propagated: DataFrame) -> DataFrame:
    """Propagation outcomes by error code; 0 is success."""
    return propagated.groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def declined_instants(samples: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """Samples missing from each series."""
    return samples.groupBy(*keys).agg(
        (F.max(expected) - F.count_if(F.col("error_code") == 0)).alias("n_declined")
    )


def id_algebra(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of union, intersection and difference of two id sets, over bitmaps of 32,768 ids.

    Each side's ids become one bitmap for each range that has any, built before the shuffle, so
    what moves is bits and not rows. NULL is an id of its own, as it is in SQL's set operations.
    """
    ids = id_bitmaps(left).select(F.lit("l").alias("side"), "bucket", "ids").unionByName(
        id_bitmaps(right).select(F.lit("r").alias("side"), "bucket", "ids"))
    one_side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.bitmap_count("ids"))), F.lit(0))
    buckets = ids.groupBy("bucket").agg(
        one_side("l").alias("l"), one_side("r").alias("r"), F.bitmap_count(F.bitmap_or_agg("ids")).alias("u"))
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in "lru"}
    return buckets.agg(
        total["u"].alias("n_union"),
        (total["l"] + total["r"] - total["u"]).alias("n_both"),
        (total["u"] - total["r"]).alias("n_left_only"),
        (total["u"] - total["l"]).alias("n_right_only"),
    )


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """(bucket, ids): the distinct ids of a table as bitmaps, one for each range of 32,768."""
    bucket = F.coalesce(F.bitmap_bucket_number(F.col("norad_cat_id").cast("long")), F.lit(_NULL_BUCKET))
    place = F.coalesce(F.bitmap_bit_position(F.col("norad_cat_id").cast("long")), F.lit(0).cast("long"))
    return rows.select(bucket.alias("bucket"), place.alias("place")).groupBy("bucket").agg(
        F.bitmap_construct_agg("place").alias("ids"))


#: The range that stands for ids that are NULL.
_NULL_BUCKET = -(1 << 62)
