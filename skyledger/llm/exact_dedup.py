"""Exact deduplication by an extendible-hash index on shared files. DataFrame operations only.

Texts are equal when identical after deleting white space. Each distinct text is an entry of the
index, which lies on the shared file system: a directory leads from the leading bits of a 64-bit
hash to a bucket. It doubles until no bucket holds more than `capacity` hashes, and a bucket splits
only where it is overfull. Rows go to the bucket of their hash; there owner tasks, each with whole
buckets, compare the bytes of texts of one hash. Texts that differ form a chain behind the hash.

A row is answered by probing its bucket for its hash. Where the chain has one entry, every text of
the hash has been found equal to it by bytes; along a longer chain the digest of the entry decides.

Copies are combined before the shuffle, so a text that makes up a third of all rows costs one row
per map task. Null text counts as empty; a null doc_id comes after all others; of repeated rows
(same doc_id and text) exactly one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import SEPARATORS, join_counted, stored

#: Hashes of a bucket before it splits. The directory has some slots for each bucket.
CAPACITY = 50_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SEPARATORS, "")


def _slot(h: Column, depth: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Global depth and (slot, bucket, local depth) of every slot, from entries per finest slot."""
    buckets: list[tuple[int, int]] = []
    open_buckets = [(0, 0, counts)]
    while open_buckets:
        prefix, depth, inside = open_buckets.pop()
        if depth == max_depth or sum(inside.values()) <= capacity:
            buckets.append((prefix, depth))
            continue
        for bit in (1, 0):
            half = {k: n for k, n in inside.items() if (k >> (max_depth - depth - 1)) & 1 == bit}
            open_buckets.append((prefix * 2 + bit, depth + 1, half))
    deepest = max(depth for _, depth in buckets)
    slots = []
    for bucket, (prefix, depth) in enumerate(buckets):
        spread = deepest - depth
        slots += [((prefix << spread) + i, bucket, depth) for i in range(1 << spread)]
    return deepest, slots


def _hash(clean: Column) -> Column:
    return F.xxhash64(clean)


def build_directory(hashes: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """Global depth and (slot, bucket) of an index for distinct hashes h, a stored table."""
    depth = max(0, math.ceil(math.log2(max(1, hashes.count()) / capacity)) + 2)
    while True:
        counted = hashes.groupBy(_slot(F.col("h"), depth).alias("slot")).count()
        counts = {r["slot"]: r["count"] for r in counted.collect()}  # a few rows for each bucket
        if max(counts.values(), default=0) <= capacity or depth >= 30:
            break
        depth += 2
    depth, slots = directory(counts, capacity, depth)
    rows = [(slot, bucket) for slot, bucket, _ in slots]
    return depth, hashes.sparkSession.createDataFrame(rows, "slot int, bucket int")


def _in_buckets(rows: DataFrame, found: tuple[int, DataFrame]) -> DataFrame:
    """Rows with the bucket that the directory leads to. The driver has built the directory, a few
    slots for each bucket, so it goes to the rows."""
    depth, slots = found
    return rows.withColumn("slot", _slot(F.col("h"), depth)).join(F.broadcast(slots), "slot").drop("slot")


def build_index(docs: DataFrame, found: tuple[int, DataFrame], doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The index, stored: bucket, h, chain, chain_length, text_sha256, keep_id, group_size."""
    clean = normalised(F.col(text))
    order = F.struct(
        (-F.coalesce(F.length(text), F.lit(0))).alias("longer"),
        F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"),
    )
    # Grouping by the text itself compares bytes, within its bucket and hash.
    entries = (
        _in_buckets(docs.select(_hash(clean).alias("h"), clean.alias("clean"), order.alias("o")), found)
        .groupBy("bucket", "h", "clean").agg(F.min("o").alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "h", F.sha2("clean", 256).alias("text_sha256"), F.col("best.id").alias("keep_id"), "group_size")
    )
    behind = Window.partitionBy("bucket", "h")
    owned = entries.repartition("bucket").withColumns({
        "chain": F.row_number().over(behind.orderBy("text_sha256")) - 1,
        "chain_length": F.count(F.lit(1)).over(behind),
    })
    return stored(owned.sortWithinPartitions("bucket", "h", "chain"), "dedup-index")


def _probed(rows: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """Rows (bucket, h, text_sha256, ...) with keep_id and group_size of their entry."""
    sought = ["keep_id", "group_size"]
    alone = index.filter("chain_length = 1").select("bucket", "h", *sought)
    chained = index.filter("chain_length > 1").select("bucket", "h", F.col("text_sha256").alias("entry"), *sought)
    first = join_counted(rows, alone, ["bucket", "h"], "group_size", total)
    along = rows.join(chained, ["bucket", "h"]).filter("text_sha256 = entry").drop("entry")
    return first.unionByName(along)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    clean = normalised(F.col(text))
    keys = stored(
        docs.select(F.col(doc_id).alias("doc_id"), _hash(clean).alias("h"), F.sha2(clean, 256).alias("text_sha256")),
        "dedup-keys",
    )
    found = build_directory(stored(keys.select("h").distinct(), "dedup-hashes"), capacity)
    index = build_index(docs, found, doc_id, text)
    answered = _probed(_in_buckets(keys, found), index, keys.count())
    again = F.row_number().over(Window.partitionBy("doc_id", "h", "text_sha256").orderBy("h"))
    return answered.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns."""
    clean = normalised(F.col(text))
    hashes = stored(docs.select(_hash(clean).alias("h")).distinct(), "dedup-hashes")
    found = build_directory(hashes, capacity)
    winners = build_index(docs, found, doc_id, text).select(
        F.col("bucket").alias("b"), F.col("h").alias("g"), "chain_length", F.col("text_sha256").alias("entry"), "keep_id")
    rows = _in_buckets(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _hash(clean).alias("h"),
                    F.sha2(clean, 256).alias("text_sha256"), F.col(doc_id).alias("id")), found)
    # The row of an entry has its id; along a chain the digest tells entries apart.
    same = (
        (F.col("bucket") == F.col("b")) & (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("keep_id"))
        & ((F.col("chain_length") == 1) | (F.col("text_sha256") == F.col("entry")))
    )
    kept = rows.join(winners, same, "left_semi")
    again = F.row_number().over(Window.partitionBy("bucket", "h", "text_sha256", "id").orderBy("h"))
    return kept.withColumn("again", again).filter("again = 1").select("row.*")
