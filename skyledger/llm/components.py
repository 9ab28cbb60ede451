"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored

#: Star steps halve the depth of trees, so the number of rounds is logarithmic in the longest path.
MAX_ROUNDS = 60


def _with_smallest(neighbours: DataFrame) -> DataFrame:
    """Add to each (u, v) the smallest of u and its neighbours. Combined before the shuffle."""
    smallest = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return neighbours.join(smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _with_smallest(both).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _with_smallest(down)
    own = found.select(F.col("m").alias("a"), F.col("u").alias("b"))
    others = found.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return own.union(others).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and the sum of their hashes, which tell whether a round changed any."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def connect(edges: DataFrame) -> DataFrame:
    """Stored (id, component) of every node of (a, b): the smallest id that edges lead to.

    Raises if MAX_ROUNDS do not suffice, rather than return parts of components.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    once = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return stored(once.union(roots), "components")
