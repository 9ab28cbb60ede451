"""Propagation of element sets to one instant or a grid of instants."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import frames, orbit, sgp4
from skyledger.schemas import POSITION_COLUMNS

KERNELS = ("j2", "sgp4")
#: Samples the kernel takes at once; its arrays then stay in the cache.
_BATCH_SAMPLES = 16_384

SAMPLE_COLUMNS = ("sample_idx", "sample_rank", "n_survived", "error_code", "kernel_used")


def instant(at: str | datetime | Column) -> Column:
    """An instant as a timestamp column. A datetime or text without a zone is refused."""
    if isinstance(at, Column):
        return at
    if isinstance(at, datetime):
        if at.tzinfo is None:
            raise ValueError("an instant needs a time zone")
        at = at.isoformat()
    elif not re.search(r"(Z|[+-]\d{2}:?\d{2})$", at.strip()):
        raise ValueError(f"an instant needs a time zone: {at!r}")
    return F.lit(at).cast("timestamp")


def _j2_samples(elsets, carry, samples, seconds_at, velocity) -> DataFrame:
    objects = orbit.with_orbit_constants(elsets)
    if samples == 1:
        grid = objects.withColumn("sample_idx", F.lit(0))
    else:
        grid = objects.withColumn(
            "sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
        )
    grid = grid.withColumns(
        {
            "sample_rank": F.col("sample_idx"),
            "n_survived": F.when(F.col("error_code") == 0, samples).otherwise(0),
            "kernel_used": F.lit("j2"),
        }
    )
    moved = orbit.with_j2_state(grid, seconds_at(F.col("sample_idx")), velocity)
    state = orbit.STATE_COLUMNS if velocity else orbit.STATE_COLUMNS[:3]
    return moved.select(*carry, *SAMPLE_COLUMNS, *state)


def _sgp4_samples(elsets, carry, samples, seconds_at, velocity, keep=None) -> DataFrame:
    elements = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in sgp4.ELEMENT_COLUMNS
    }
    first, second = seconds_at(F.lit(0)), seconds_at(F.lit(1))
    source = elsets.select(
        *carry,
        *[c.alias(f"_el_{n}") for n, c in elements.items()],
        (first / F.lit(60.0)).alias("_start"),
        ((second - first) / F.lit(60.0)).alias("_step"),
    )
    state = orbit.STATE_COLUMNS if velocity else orbit.STATE_COLUMNS[:3]
    fields = [source.schema[c] for c in carry]
    fields += [T.StructField(c, T.IntegerType()) for c in SAMPLE_COLUMNS[:4]]
    fields += [T.StructField(c, T.DoubleType()) for c in state]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = max(1, _BATCH_SAMPLES // samples)
        for batch in batches:
            for low in range(0, batch.num_rows, per):
                part = batch.slice(low, per)
                column = {
                    n: part.column(n).to_numpy(zero_copy_only=False)
                    for n in part.schema.names if n.startswith("_")
                }
                minutes = column["_start"][:, None] + column["_step"][:, None] * np.arange(samples)
                error, position, velocities = sgp4.states(
                    {c: column[f"_el_{c}"] for c in sgp4.ELEMENT_COLUMNS}, minutes
                )
                good = error == 0
                survived = good.sum(axis=1, dtype=np.int32)
                values = [
                    np.tile(np.arange(samples, dtype=np.int32), part.num_rows),
                    (np.cumsum(good, axis=1, dtype=np.int32) - 1).ravel(),
                    np.repeat(survived, samples),
                    error.ravel(),
                ]
                vectors = [position] + ([velocities] if velocity else [])
                values += [v[..., axis].ravel() for v in vectors for axis in range(3)]
                rows = np.repeat(np.arange(part.num_rows), samples)
                if keep is not None:
                    wanted = np.flatnonzero(good & keep(position))
                    rows, values = rows[wanted], [v[wanted] for v in values]
                kept = part.select(list(carry)).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *[pa.array(v) for v in values]],
                    names=[*carry, *SAMPLE_COLUMNS[:4], *state],
                )

    moved = source.mapInArrow(kernel, T.StructType(fields))
    clean = {c: F.when(F.col("error_code") == 0, F.col(c)) for c in state}
    return moved.withColumns(clean).select(
        *carry, *SAMPLE_COLUMNS[:4], F.lit("sgp4").alias("kernel_used"), *state
    )


def sample_states(
    elsets: DataFrame,
    seconds_at,
    *,
    samples: int = 1,
    kernel: str = "j2",
    carry: Sequence[str] = ("norad_cat_id",),
    velocity: bool = True,
    keep: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """TEME states of every element set at `samples` instants.

    `seconds_at(idx)` is the Column of seconds since epoch of sample `idx`, linear in it.
    Rows the theory declines stay, with a non-zero `error_code` and NULL states;
    `sample_rank` counts the surviving samples of a series and `n_survived` is their number.
    The grid is generated per object inside a task: only element sets, never samples, are
    shuffled. `kernel="sgp4"` sends deep-space objects to the J2 kernel, which
    `kernel_used` records. `keep` says of SGP4 positions (objects, samples, 3) which surviving
    samples to put out; ranks and counts are of all.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}, expected one of {KERNELS}")
    if samples < 1:
        raise ValueError("at least one sample is needed")
    carry = list(carry)
    if kernel == "j2":
        return _j2_samples(elsets, carry, samples, seconds_at, velocity)
    near, deep = elsets.where(~is_deep()), elsets.where(is_deep())
    return _sgp4_samples(near, carry, samples, seconds_at, velocity, keep).unionByName(
        _j2_samples(deep, carry, samples, seconds_at, velocity)
    )


def is_deep() -> Column:
    """Is an object's period too long for SGP4 without its deep-space extension?"""
    return F.coalesce(orbit.period_minutes(F.col("mean_motion")), F.lit(0.0)) >= sgp4.DEEP_SPACE_MINUTES


#: Samples that a task sorts, at about 200 bytes each.
SAMPLES_IN_TASK = 250_000


def spread(elsets: DataFrame, samples: int, counted: bool = False) -> DataFrame:
    """Element sets hashed on the object id over enough tasks for their samples.

    The number is explicit: it is set by what the rows will grow to, while adaptive
    execution would merge the small element sets into a task or two before they grow.
    Where all samples are sorted, element sets are `counted` first, so that a task gets no more
    than it can hold however many there are.
    """
    spark = elsets.sparkSession
    base = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    tasks = base * (1 + samples // 4000)
    if counted:
        tasks = max(tasks, -(-elsets.count() * samples // SAMPLES_IN_TASK))
    return elsets.repartition(tasks, "norad_cat_id")


def seconds_since_epoch(at: Column) -> Column:
    return (F.unix_micros(at) - F.unix_micros("epoch")) / F.lit(1e6)


def propagate_all(
    elsets: DataFrame,
    start: str | datetime | Column,
    *,
    samples: int = 1,
    step_seconds: int = 0,
    kernel: str = "j2",
) -> DataFrame:
    """Positions on a regular grid, declined rows included (NULL coordinates)."""
    if samples > 1 and step_seconds <= 0:
        raise ValueError("the step must be positive")
    at = instant(start)
    moved = sample_states(
        spread(elsets, samples) if samples > 1 else elsets,
        lambda i: seconds_since_epoch(at) + i * F.lit(float(step_seconds)),
        samples=samples, kernel=kernel, carry=("norad_cat_id", "epoch"),
    ).withColumn(
        "snapshot_ts",
        at if samples == 1
        else F.timestamp_micros(F.unix_micros(at) + F.col("sample_idx") * F.lit(step_seconds * 1_000_000).cast("long")),
    )
    located = frames.with_geodetic_from_teme(moved, frames.julian_date(F.col("snapshot_ts")))
    return located.withColumn("epoch_age_hours", orbit.age_hours(F.col("snapshot_ts"), F.col("epoch")))


def propagate(
    elsets: DataFrame, at: str | datetime | Column, *, kernel: str = "j2"
) -> DataFrame:
    """Positions of all element sets at one instant; declined ones are left out."""
    rows = propagate_all(elsets, at, kernel=kernel).where("error_code = 0")
    return rows.select(*POSITION_COLUMNS, "kernel_used")


def propagate_grid(
    elsets: DataFrame,
    start: str | datetime | Column,
    *,
    samples: int,
    step_seconds: int,
    kernel: str = "j2",
) -> DataFrame:
    """Positions of all element sets at every instant of a regular grid."""
    rows = propagate_all(
        elsets, start, samples=samples, step_seconds=step_seconds, kernel=kernel
    ).where("error_code = 0")
    return rows.select(*POSITION_COLUMNS, "sample_idx", "kernel_used")
