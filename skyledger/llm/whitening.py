"""Whitening of embedding vectors: rows projected on the principal components, at unit variance.

An entry c becomes the integer floor(64 c) + 1000000. The fit list is each distinct integer vector once;
a vector that many rows have is combined before the shuffle. Its count n and its sums S are exact
integers, so n x - S, the centred row times n, is exact as well. Every task reduces its centred rows to a
triangular factor, a block at a time; factors are stacked and reduced again in groups until one
remains, which has the fit list's covariance in it whatever the number of rows. `bidiagonal` turns it
into components: Householder bidiagonal form, dqds, twisted factorisations.

Rows whose vector is null, empty, or holds a null, NaN or infinite entry are left out, and so are those of
another length than most rows have (of lengths as frequent, the smallest counts). Components whose
singular value is lost in rounding against the first are not returned, so a fit list of one vector gives
no row. Repeated rows and null ids are answered like others. An empty table gives an empty result.
An entry or a deviation beyond 64 bits is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.bidiagonal import right_singular
from skyledger.llm.common import give_back, stored

SCALE, OFFSET = 64, 1_000_000
#: Components returned.
MOST = 16
#: Rows of a block in a task, and factors that one task of a reduction stacks.
BLOCK = 4096
FAN_IN = 32


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Stored (vec_id, x) of the rows that can be used; x is the vector of integers."""
    entry = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col(vec_id).alias("vec_id"), entry.alias("c")).filter(F.coalesce(fine, F.lit(False)) & (F.size("c") > 0))
    lengths = rows.groupBy(F.size("c").alias("dims")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), "dims").first()
    dims = usual["dims"] if usual else 0
    whole = F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return stored(rows.filter(F.size("c") == dims).select("vec_id", whole.alias("x")), "whitening-rows")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """n and S of the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                most = float(np.abs(x).max())
                if most * len(x) >= 2.0**62:
                    raise OverflowError("entries are too large for sums of 64 bits")
                part = x.sum(axis=0)
                count, total = count + len(x), part if total is None else total + part
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([count], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "s"])

    parts = fit.select("x").mapInArrow(run, "n bigint, s array<bigint>")
    n = parts.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    rows = sorted(n.collect())  # one row for each dimension
    return (rows[0]["n"], np.array([r["s"] for r in rows], np.int64)) if rows else (0, np.zeros(0, np.int64))


def _exact(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S in integers."""
    if float(np.abs(x).max(initial=0)) * n >= 2.0**62:
        raise OverflowError("n x - S does not fit in 64 bits")
    return n * x - s


def _factor(fit: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """The triangular factor of all centred rows of the fit list."""
    d = len(s)

    def stacked(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.concatenate((r, block)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])
        give_back()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    x = _matrix(batch.column(0).slice(a, BLOCK))
                    yield _exact(x, n, s).astype(np.float64) / n
        yield from stacked(blocks())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stacked(np.array(r).reshape(-1, d) for batch in batches for r in batch.column(0).to_pylist())

    factors = stored(fit.select("x").mapInArrow(first, "r array<double>"), "whitening-factors")
    left = factors.count()
    while left > FAN_IN:
        # One factor stays for each group of about FAN_IN.
        factors = stored(factors.repartition(-(-left // FAN_IN)).mapInArrow(again, "r array<double>"), "whitening-factors")
        left = factors.count()
    r = np.concatenate([np.zeros((0, d)), *[np.array(x["r"]).reshape(-1, d) for x in factors.collect()]])
    return np.linalg.qr(np.concatenate((r, np.zeros((d, d)))), mode="r")


def _identity_error(fit: DataFrame, n: int, s: np.ndarray, onto: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_exact(_matrix(batch.column(0)), n, s).astype(np.float64) / n) @ onto
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["t"])

    parts = fit.select("x").mapInArrow(run, "t array<double>").select(F.posexplode("t"))
    rows = sorted(parts.groupBy("pos").agg(F.sum("col").alias("t")).collect())  # (k + 1) * k numbers
    total = np.array([r["t"] for r in rows]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = MOST) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    rows = integer_vectors(table, vec_id, embedding)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, s = _sums(fit)
    values, directions = right_singular(_factor(fit, n, s)) if n else (np.zeros(0), np.zeros((0, 0)))
    total = float(np.sum(values**2))
    k = min(most, len(values))
    root = np.sqrt(float(n))
    onto = directions[:, :k] / (values[:k] / root) if k else np.zeros((len(s), 0))
    explained = values[:k] ** 2 / total if k else np.zeros(0)
    error = _identity_error(fit, n, s, onto) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows if k else 0, BLOCK):
                batch = whole.slice(a, BLOCK)
                centred = _exact(_matrix(batch.column(1)), n, s)
                if float(np.abs(centred).max()) ** 2 * len(s) >= 2.0**63:
                    raise OverflowError("a deviation does not fit in 64 bits")
                w = (centred.astype(np.float64) / n) @ onto
                m = batch.num_rows
                owner = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat((centred * centred).sum(axis=1), k)),
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
             "identity_error double")
