"""A trie of conversations by van Emde Boas recursion: nodes are distinct sequences of first turns.

A sequence is cut at half depth, its upper half and its lower half are cut again, and so on down to
LEAF turns. All pieces of one height are treated in parallel, whatever their conversation and depth:

* Going up, prefixes get names. A piece of LEAF turns names each of its prefixes by a digest of its
  turns. A piece twice as high names a prefix that ends in its lower half by the name of the upper
  half, the cut prefix, and the name within the lower half. After log2(depth / LEAF) steps a name
  stands for everything from the root.
* Equal names are one node: members are counted, parents found at the name one turn before.
* Totals go upward the same way. First each node sums what lies below it within its piece of LEAF
  turns. Then, for pieces of twice the height, the totals of the lower forests' roots are grafted
  upon the nodes above them in the upper trie: each root sends its total along the path of its
  smallest member, no more rows than that path has, and the nodes add up what arrives.

A conversation of any length is never in one task: what meets there has LEAF rows. Names are
128-bit digests. A node is stored with its smallest member, which makes (member, depth) its key, so
nothing is joined by names that many conversations have, but for parents of many children.

Turns are ordered by turn, null first; ties by role, then text, so that repeated rows are turns of
their own, next to each other. A null role or text is empty. Rows with a null conv_id belong to no
conversation. An empty table has no node, not even a root. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import WORD, stored
from skyledger.operators.ordered import OrderedGroups

#: Turns in the smallest piece; what one window of a task holds of a conversation.
LEAF = 8
_SHIFT = LEAF.bit_length() - 1
#: Conversations come in groups of so many; a group shares the first turns of its first one.
GROUP, SHARED = 20, 4
#: Ids of one node's ending conversations are joined in runs of so many consecutive numbers.
RUN_BITS = 12


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """(conv_id, pos, letter, words): the turns of each conversation, numbered from 0."""
    read = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The length of the role keeps role and text apart.
    letter = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = read.select("conv_id", F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", letter.alias("letter"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), "text")
    groups = OrderedGroups(rows, ["conv_id"], ["turn", "role", "text"])
    groups.running_sums({"pos": F.lit(1)})
    return groups.result().select("conv_id", (F.col("pos") - 1).alias("pos"), "letter", "words")


def rebuilt(of_turns: DataFrame) -> DataFrame:
    """(conv_id, i, letter, words): each conversation with the first turns of its group's first one
    in front; i counts from 1. The root, i = 0, is there for every conversation."""
    ids = of_turns.filter("pos = 0").select("conv_id").withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP,
        "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("long"),
    })
    # At most SHARED - 1 turns of a base, and at most twice GROUP conversations to a base.
    heads = of_turns.filter(F.col("pos") < SHARED - 1).join(
        ids.select(F.col("base").alias("conv_id")).distinct(), "conv_id").withColumnRenamed("conv_id", "base")
    given = ids.join(heads, "base").filter("pos < h").select("conv_id", "pos", "letter", "words")
    have = ids.join(
        given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("have")), "conv_id", "left",
    ).select("conv_id", "h", F.coalesce("have", F.lit(0)).alias("have"))
    own = of_turns.join(have, "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("have")).alias("pos"), "letter", "words")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit(b"").alias("letter"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(given.unionByName(own).select("conv_id", (F.col("pos") + 1).alias("i"), "letter", "words"))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _piece(height: int) -> Column:
    """Number of the piece of LEAF * 2 ** height depths that a row lies in."""
    return F.shiftright("i", _SHIFT + height)


def _lower(height: int) -> Column:
    return (_piece(height) % 2) == 1


def named(rows: DataFrame) -> DataFrame:
    """Stored rows with `name`, the identity of the first i turns, and `last`, the greatest i."""
    last = rows.groupBy("conv_id").agg(F.max("i").alias("last"))
    leaf = Window.partitionBy("conv_id", "piece").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    now = stored(
        rows.join(last, "conv_id").withColumn("piece", _piece(0))
        .withColumn("name", F.unhex(F.md5(F.array_join(F.transform(F.collect_list("letter").over(leaf), F.hex), ","))))
        .drop("piece", "letter"),
        "trie-names",
    )
    longest, height, done = now.agg(F.max("last")).first()[0] or 0, 0, []
    while LEAF << height <= longest:
        # Only conversations that reach a lower half go on.
        done.append(now.filter(F.col("last") < LEAF << height))
        going = now.filter(F.col("last") >= LEAF << height)
        above = _piece(height + 1).alias("above")
        cut = going.filter(~_lower(height) & (F.pmod(F.col("i") + 1, F.lit(LEAF << height)) == 0)).select(
            "conv_id", above, F.col("name").alias("cut"))
        lower = going.filter(_lower(height)).withColumn("above", above).join(cut, ["conv_id", "above"])
        lower = lower.withColumn("name", _digest("cut", "name")).drop("cut", "above")
        now = stored(going.filter(~_lower(height)).unionByName(lower), "trie-names")
        height += 1
    for part in done:
        now = now.unionByName(part)
    return now


def _sum_upward(rows: DataFrame, nodes: DataFrame, values: list[str], longest: int) -> DataFrame:
    """(name, *values): for each node the sums over its subtree. `nodes` has (conv_id, i, *values)."""
    below = Window.partitionBy("conv_id", "piece").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    valued = rows.join(nodes.select("conv_id", "i", *values), ["conv_id", "i"], "left").fillna(0, values)
    now = stored(
        valued.withColumn("piece", _piece(0)).withColumns({v: F.sum(v).over(below) for v in values})
        .groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("i").alias("i"), *[F.sum(v).alias(v) for v in values]),
        "trie-sums",
    )
    height = 0
    while LEAF << height <= longest:
        # Roots of the lower forests: the first depth of every lower half.
        roots = now.filter(_lower(height) & (F.pmod("i", F.lit(LEAF << height)) == 0)).select(
            "conv_id", _piece(height + 1).alias("above"), *[F.col(v).alias(f"more_{v}") for v in values])
        path = rows.filter((F.col("last") >= LEAF << height) & ~_lower(height)).select(
            "conv_id", "name", _piece(height + 1).alias("above"))
        grafts = path.join(roots, ["conv_id", "above"]).groupBy("name").agg(
            *[F.sum(f"more_{v}").alias(f"more_{v}") for v in values])
        now = stored(
            now.join(grafts, "name", "left")
            .select("name", "conv_id", "i", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]),
            "trie-sums",
        )
        height += 1
    return now.select("name", *values)


def _ends(rows: DataFrame) -> DataFrame:
    """(name, ends_sha256): digest of the ids of the conversations that end at a node.

    Runs of ids are joined in parallel; the digest of a node takes them in order, one at a time.
    """
    runs = (
        rows.filter("i = last").withColumn("run", F.shiftright("conv_id", RUN_BITS)).groupBy("name", "run")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = state = None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == name:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    return (
        runs.repartition("name").sortWithinPartitions("name", "run").select("name", "ids")
        .mapInArrow(run, "name binary, ends_sha256 string")
    )


def trie(rows: DataFrame) -> DataFrame:
    """One row per node of sequences (conv_id, i, letter, words), i from 0 for the root.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    rows = named(rows)
    nodes = stored(
        rows.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("i").alias("i"), F.first("words").alias("words"),
                                 F.count(F.lit(1)).alias("n_convs")),
        "trie-nodes",
    )
    # A node's parent lies on the path of its smallest member, one turn before.
    before = rows.select("conv_id", (F.col("i") + 1).alias("i"), F.col("name").alias("parent"))
    child = stored(nodes.select("name", "conv_id", "i").join(before, ["conv_id", "i"]).select("name", "parent"), "trie-children")
    counted = child.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    parents = child.join(nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    shaped = stored(
        nodes.join(counted, F.col("name") == F.col("parent"), "left").drop("parent")
        .fillna(0, ["n_children"]).join(parents.drop("parent"), "name", "left")
        .withColumns({
            "n_leaves": (F.col("n_children") == 0).cast("long"),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
        }),
        "trie-shaped",
    )
    longest = rows.agg(F.max("last")).first()[0] or 0
    totals = _sum_upward(rows, shaped, ["n_leaves", "saved_tokens"], longest)
    return (
        shaped.drop("n_leaves", "saved_tokens").join(totals, "name").join(_ends(rows), "name", "left")
        .select("conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(stored(rebuilt(stored(turns(conversations, **columns), "trie-turns")), "trie-rows"))
