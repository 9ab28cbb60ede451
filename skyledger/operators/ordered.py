"""Neighbour values and running totals over ordered groups of any size.

A window function sorts each group inside one task, however large the group is. Here a group that
holds more than a share of all rows is cut into pieces of about that share along its order. The
borders are quantiles of the order column, from a summary that tasks merge, so pieces are even
wherever the rows lie. Windows run inside (group, piece). What has to cross a piece's edge is one
row for each piece; a window over those few rows finds it, and a join with them brings it back.
All other groups, and so most tables as a whole, stay in one piece: one scan, one exchange, one
window.

To know large groups, their keys are counted when the frame is built. Only the largest count and
the borders reach the driver; groups above a share of 1 / PIECES are fewer than PIECES.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group with more than this part of all rows is cut into pieces of about that many rows; as
#: many pieces as a large cluster has tasks. Groups of up to ROWS_IN_PIECE stay whole anyway.
PIECES = 5000
ROWS_IN_PIECE = 100_000

_BLOCK, _CUT = "_block", "_cut"


def _number(df: DataFrame, column: str) -> Column:
    """The order column as a number; times in microseconds."""
    if df.schema[column].dataType.typeName().startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return same


def borders(measured: DataFrame, keys: Sequence[str], order: str) -> DataFrame | None:
    """(keys, _borders) of the groups that are cut, at most PIECES numbers in all; None if none is."""
    rows = measured.select(*keys, _number(measured, order).alias("_at"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(ROWS_IN_PIECE, (total or 0) // PIECES)
    if not largest or largest <= limit:
        return None
    most = -(-largest // limit)
    large = counts.where(F.col("_n") > limit)
    found = (
        rows.alias("r").join(F.broadcast(large).alias("l"), _same(keys, "r", "l"))
        .select(*[F.col(f"r.`{k}`") for k in keys], "_at", "_n")
        .groupBy(*keys, "_n").agg(F.percentile_approx("_at", [i / most for i in range(1, most)], 10 * most).alias("_all"))
    )
    # Every so many of the finest borders, so that a piece has about `limit` rows.
    each = F.greatest(F.lit(1), F.floor(F.lit(float(most * limit)) / F.col("_n"))).cast("int")
    thinned = F.filter("_all", lambda _, i: (i + 1) % each == 0)
    cut = found.select(*keys, F.array_distinct(thinned).alias("_borders"))
    return measured.sparkSession.createDataFrame(cut.collect(), cut.schema)


class OrderedGroups:
    """Ordered groups of a DataFrame, with columns added step by step to `frame`."""

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
        measured: DataFrame | None = None, bounded: bool = False,
    ) -> None:
        """`measured` has the keys and the first order column of the rows, or of somewhat more, and
        is cheaper to read than `df`. `bounded` states that the caller's parameters bound a group."""
        self.keys, self.order = list(keys), list(order)
        large = None if bounded else borders(df if measured is None else measured, self.keys, self.order[0])
        self.cut = large is not None
        if self.cut:
            place = F.size(F.filter("_borders", lambda b: b <= _number(df, self.order[0])))
            df = df.alias("f").join(F.broadcast(large).alias("l"), _same(self.keys, "f", "l"), "left").select(
                "f.*", "_borders"
            ).withColumns({
                _CUT: F.col("_borders").isNotNull(),
                _BLOCK: F.when(F.col("_borders").isNull() | F.col(self.order[0]).isNull(), 0).otherwise(place),
            }).drop("_borders")
        self.frame = df

    @property
    def _pieces(self) -> list[str]:
        return self.keys + ([_BLOCK] if self.cut else [])

    @property
    def _window(self):
        return Window.partitionBy(*self._pieces).orderBy(*self.order)

    @property
    def _so_far(self):
        return self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def _before(self):
        return (
            Window.partitionBy(*self.keys).orderBy(_BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def _with_edges(
        self,
        inner: Mapping[str, Column],
        aggregates: Sequence[Column],
        carried: Mapping[str, Column],
    ) -> None:
        """Add `inner`, and what reaches each piece from the other pieces of its group.

        Only groups that are cut have edges, fewer than 2 * PIECES rows in all.
        """
        pieces = self.frame.where(_CUT).groupBy(*self._pieces).agg(*aggregates)
        edges = pieces.select(*self._pieces, *[c.alias(n) for n, c in carried.items()])
        self.frame = self.frame.withColumns(inner).alias("f").join(
            F.broadcast(edges).alias("e"), _same(self._pieces, "f", "e"), "left"
        ).select("f.*", *[f"e.{n}" for n in carried])

    def neighbours(
        self,
        previous: Mapping[str, str] | None = None,
        following: Mapping[str, str] | None = None,
    ) -> OrderedGroups:
        """Add the value of a column in the row before or after: {new column: column}."""
        wanted = {
            "_prev": (previous or {}, F.lag, F.max_by),
            "_next": (following or {}, F.lead, F.min_by),
        }
        wanted = {k: v for k, v in wanted.items() if v[0]}
        inner = {
            name: step(_packed(columns)).over(self._window)
            for name, (columns, step, _) in wanted.items()
        }
        if self.cut:
            rank = F.struct(*self.order)
            across = Window.partitionBy(*self.keys).orderBy(_BLOCK)
            self._with_edges(
                inner,
                [end(_packed(cols), rank).alias(f"{n}_end") for n, (cols, _, end) in wanted.items()],
                {f"{n}_edge": step(f"{n}_end").over(across) for n, (_, step, _) in wanted.items()},
            )
            self.frame = self.frame.withColumns(
                {n: F.coalesce(F.col(n), F.col(f"{n}_edge")) for n in wanted}
            ).drop(*[f"{n}_edge" for n in wanted])
        else:
            self.frame = self.frame.withColumns(inner)
        self.frame = self.frame.withColumns(
            {
                out: F.col(f"{n}.{column}")
                for n, (columns, *_) in wanted.items()
                for out, column in columns.items()
            }
        ).drop(*wanted)
        return self

    def running_sums(self, sums: Mapping[str, Column]) -> OrderedGroups:
        """Add inclusive running sums: {new column: summed expression}."""
        self.frame = self.frame.withColumns({f"_{n}_term": e for n, e in sums.items()})
        inner = {n: F.sum(f"_{n}_term").over(self._so_far) for n in sums}
        if self.cut:
            self._with_edges(
                inner,
                [F.sum(f"_{n}_term").alias(f"_{n}_all") for n in sums],
                {f"_{n}_before": F.sum(f"_{n}_all").over(self._before) for n in sums},
            )
            inner = {
                n: F.when(F.col(f"_{n}_before").isNull(), F.col(n)).otherwise(
                    F.coalesce(F.col(n) + F.col(f"_{n}_before"), F.col(f"_{n}_before"))
                )
                for n in sums
            }
        self.frame = self.frame.withColumns(inner).drop(
            *[f"_{n}_term" for n in sums], *[f"_{n}_before" for n in sums]
        )
        return self

    def fill_forward(self, out: str, column: str) -> OrderedGroups:
        """Add the latest non-null value of a column up to and including this row."""
        inner = {out: F.last(column, ignorenulls=True).over(self._so_far)}
        if self.cut:
            rank = F.when(F.col(column).isNotNull(), F.struct(*self.order))
            self._with_edges(
                inner,
                [F.max_by(column, rank).alias("_last")],
                {"_carried": F.last("_last", ignorenulls=True).over(self._before)},
            )
            self.frame = self.frame.withColumn(
                out, F.coalesce(F.col(out), F.col("_carried"))
            ).drop("_carried")
        else:
            self.frame = self.frame.withColumns(inner)
        return self

    def result(self) -> DataFrame:
        return self.frame.drop(_BLOCK, _CUT)


def _packed(columns: Mapping[str, str]) -> Column:
    return F.struct(*dict.fromkeys(columns.values()))
