"""Mixing sources to target token weights by entropy balancing.

Every source gets a target number of words. Rates of its documents are those nearest to taking
each document once, in relative entropy over the range 0 to 2, that meet the target: a logistic
tilt 2 / (1 + exp(-lambda * size / mean size)). The dual is convex with one multiplier for each
source, found by Newton steps on distributed sums over a histogram of sizes. Rates are then
rounded into copies: documents of one source and size share a rate, whole copies are dealt out to
these strata from the longest text down, carrying the rounding error on, and inside a stratum by
a hash of doc_id. Reruns give the same mix.

Null text has size 0 and is taken 0 words. Null source is a source of its own, the last one. Equal
sizes are told apart by the hash, repeated rows are dealt out row by row. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import HOT_SHARE, WORD, stored

#: Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_RATIO = 1.5
MAX_COPIES = 2.0

TOLERANCE = 1e-9
MAX_STEPS = 60
#: Rows of one stratum that are ordered in one task; larger strata are split by a hash.
STRATUM_ROWS = 10_000
#: Multiplier that stands for "every document at the highest rate".
FULL = 1e300


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = TOTAL_RATIO,
            cap: float = MAX_COPIES) -> DataFrame:
    """From (source, source_size), the target of each source: weighted shares of the total, capped.

    The level at which capped and uncapped sources add up is found by ordering sources by the
    level at which each of them is full. The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    full = F.col("source_size") * cap
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("full_at", full / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * ratio)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
                    / F.sum("weight").over(after))
        # The first source that the level does not fill fixes the level of all.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"),
                                          F.struct("full_at", "level"))).over(everything)["level"])
        .withColumn("target", F.least(full, F.coalesce("level", F.lit(math.inf)) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), multiplier * (size / mean)))
    return F.when(multiplier >= FULL, F.lit(cap)).otherwise(F.lit(cap) / (1.0 + F.exp(-tilt)))


def _fixed_sum(term: Column) -> Column:
    """A sum whose digits do not depend on the order in which tasks add."""
    return F.sum(term.cast("decimal(38,12)")).cast("double")


def solve(histogram: DataFrame, goals: DataFrame, cap: float = MAX_COPIES) -> DataFrame:
    """Add the multiplier of each source: safeguarded Newton steps on the dual's gradient.

    `histogram` has (source, size, n), `goals` (source, source_size, target, mean_size). Each step
    is one distributed sum, of which the driver learns whether it was the last. Raises if MAX_STEPS do
    not suffice.
    """
    state = stored(
        goals.withColumn("multiplier", F.when(F.col("target") >= F.col("source_size") * cap, F.lit(FULL)).otherwise(F.lit(0.0)))
        .withColumn("low", F.lit(-math.inf)).withColumn("high", F.lit(math.inf)),
        "mix-state",
    )
    columns = state.columns
    for _ in range(MAX_STEPS):
        same = F.col("h.source").eqNullSafe(F.col("s.source"))
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean_size"), cap)
        slope = rate * (1.0 - rate / cap) * F.col("size") / F.col("mean_size")
        sums = (
            histogram.alias("h").join(state.alias("s"), same)
            .groupBy(*[F.col(f"s.{c}") for c in columns])
            .agg(_fixed_sum(F.col("n") * F.col("size") * rate).alias("value"),
                 _fixed_sum(F.col("n") * F.col("size") * slope).alias("slope"))
        )
        error = F.col("value") - F.col("target")
        low = F.when(error < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("multiplier")).otherwise(F.col("high"))
        reach = F.lit(2.0) * F.abs("multiplier") + 1.0
        newton = F.col("multiplier") - F.greatest(-reach, F.least(
            reach, F.when(F.col("slope") > 0, error / F.col("slope")).otherwise(F.signum(error) * reach)))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        done = (F.col("multiplier") >= FULL) | (F.abs(error) <= TOLERANCE * F.greatest(F.col("source_size"), F.lit(1)))
        moved = stored(
            sums.withColumn("low", low).withColumn("high", high).withColumn("done", done)
            .withColumn("multiplier", F.when(done, F.col("multiplier")).otherwise(step)),
            "mix-state",
        )
        state = moved.select(*columns)
        if moved.filter("not done").isEmpty():
            return state
    raise RuntimeError(f"multipliers are not found after {MAX_STEPS} steps")


def plan_mix(rows: DataFrame, weights=WEIGHTS, ratio: float = TOTAL_RATIO,
             cap: float = MAX_COPIES) -> tuple[DataFrame, DataFrame]:
    """Strata with their copies, and the hot strata that are split, from (doc_id, source, size).

    `rows` is read twice, so it should be stored.
    """
    histogram = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    per_source = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = targets(per_source, weights, ratio, cap).alias("g").join(
        per_source.select(F.col("source").alias("of"), "docs"), F.col("source").eqNullSafe(F.col("of"))
    ).select("source", "source_size", "target",
             F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")).alias("mean_size"))
    state = solve(histogram, goals, cap)
    total = histogram.agg(F.sum("n")).first()[0] or 0
    # Fewer than 1 / HOT_SHARE strata can be that large.
    hot = histogram.filter(F.col("n") > max(STRATUM_ROWS, int(total * HOT_SHARE))).select(
        F.col("source").alias("hot_source"), F.col("size").alias("hot_size"),
        F.ceil(F.col("n") / STRATUM_ROWS).cast("int").alias("parts"))
    counted = (
        with_part(rows, hot).groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
        .alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        .withColumn("rate", _rate(F.col("multiplier"), F.col("size"), F.col("mean_size"), cap))
    )
    longest_first = Window.partitionBy("c.source").orderBy(F.desc("size"), "part")
    upto = F.sum(F.col("n") * F.col("rate")).over(longest_first.rowsBetween(Window.unboundedPreceding, 0))
    strata = (
        counted.withColumn("upto", F.round(upto))
        .withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(longest_first), F.lit(0.0)))
        .withColumn("copies", F.least(F.col("n") * cap, F.greatest(F.lit(0.0), F.col("copies"))).cast("long"))
        .select(F.col("c.source").alias("of"), F.col("size").alias("of_size"), F.col("part").alias("of_part"),
                "source_size", "target", "n", "copies")
    )
    return stored(strata, "mix-strata"), hot


def with_part(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Split the rows of hot strata by a hash of doc_id."""
    same = F.col("source").eqNullSafe(F.col("hot_source")) & (F.col("size") == F.col("hot_size"))
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), same, "left").withColumn("part", part).drop("hot_source", "hot_size", "parts")


def deal(rows: DataFrame, strata: DataFrame, hot: DataFrame) -> DataFrame:
    """Add source_size, target and copies to rows with (doc_id, source, size)."""
    same = (
        F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
        & (F.col("part") == F.col("of_part"))
    )
    order = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id")
    whole = F.floor(F.col("copies") / F.col("n"))
    one_more = F.row_number().over(order) <= F.col("copies") - whole * F.col("n")
    return (
        with_part(rows, hot).join(strata, same)
        .withColumn("copies", (whole + one_more.cast("long")).cast("long"))
        .drop("of", "of_size", "of_part", "n", "part")
    )


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       size_of(F.col(text)).alias("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        **goals) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    rows = stored(_slim(docs, doc_id, text, source), "mix-rows")
    dealt = deal(rows, *plan_mix(rows, **goals))
    return dealt.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          **goals) -> DataFrame:
    """The mix itself: every document's row as often as it is taken, with all its columns."""
    strata, hot = plan_mix(stored(_slim(docs, doc_id, text, source), "mix-rows"), **goals)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       size_of(F.col(text)).alias("size"))
    dealt = deal(rows, strata, hot).filter("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
