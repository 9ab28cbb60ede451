"""N-gram Jaccard join by partitioning the universe of shingles, exact.

A document is its set of distinct k-word shingles. Two documents link when their sets have a
Jaccard similarity of at least `similarity`; documents with equal sets are one node from the start.

Sizes are divided into bands so that a document only links within its band and the next. Every
band has a scheme: shingles are hashed into segments. If two sets of the band differ in at most H
shingles and the weights of the segments exceed H, some segment is an agreement: a segment of
weight 1 when the two subsets are equal, a segment of weight 2 also when they differ by one
shingle, which the index finds by one-deletion neighbourhoods. The number of segments of each
kind is allocated for each band by a cost model. It leaves slack, which every document spends on
not looking up its most frequent segments: both partners order segments by the same corpus-wide
counts, and agreements outweigh the slack, so the rarest agreement is looked up by both. No
link is lost, whatever the counts.

Candidates are checked against a parity sketch, which bounds the difference from below, then
exactly. Inside a list of equal segments all members are compared with one of them first; those
that land in one component need no further comparison. The others meet by a prefix filter: of its
n shingles, rarest first, each of two linked sets has one of the other's in the first
n - ceil(similarity * n) + 1. What many documents share stands last, so members of a list that
only share a passage never meet, and a large group of near copies costs its size, not its square.

Text without words has an empty set and links with nothing. Null text is empty. Repeated rows and
ties are one node. A row is known by its id and a hash of its text, so rows with a null or a reused
doc_id take part with their own text; a null never names a component that has another id. Texts
are shingled whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import Words, give_back, join_counted, mix, pieces, sliced, stored, utf8, words
from skyledger.llm.components import connect

#: Defaults of the contract: five words, similarity of 80 in 100.
K = 5
PERCENT = 80
#: Cost model: share of a set assumed to lie in passages that many documents have, and how many
#: times larger a one-deletion segment is than an exact one. They decide costs, never results.
COMMON_SHARE, COMMON_SHINGLES, MOST_COMMON = 0.05, 15, 0.4
DELETION_SIZE = 3.0

EXACT, WHOLE, DELETED = 0, 1, 2
#: Bytes of the folded sketch that goes along with candidates.
FOLDED = 64
#: Cells of the filter of wanted documents: for each of them, and most of all, 64 in a row of 16 bytes.
CELLS, MOST_CELLS = 16, 1 << 26
#: A null doc_id counts as larger than all others.
LAST = (1 << 63) - 1
_SALT = np.uint64(0x5851F42D4C957F2D)


# ---- Bands and schemes --------------------------------------------------------------------


def band_starts(percent: int = PERCENT, largest: int = 1 << 40) -> list[int]:
    """First size of every band: larger partners of a size lie in its band or the next.

    A band spans two steps of the size ratio; about half of its members then need its own scheme
    alone, which costs fewer signatures than narrower or wider bands do.
    """
    starts = [1]
    while starts[-1] <= largest:
        start = starts[-1]
        for _ in range(2):
            start = max(start + 1, 100 * (start - 1) // percent + 1)
        starts.append(start)
    return starts


def differing(sizes: int, percent: int) -> int:
    """Most shingles in which two linked sets of so many shingles together can differ."""
    return sizes * (100 - percent) // (100 + percent)


def scheme(band: int, percent: int = PERCENT, known: dict = {}) -> tuple[int, int, int]:  # noqa: B006
    """Exact segments, one-deletion segments and total weight of a band: the cheapest allocation
    whose slack pays for the segments that documents with a common passage agree on by chance.
    `known` remembers them."""
    if (band, percent) in known:
        return known[band, percent]
    starts = band_starts(percent)
    n, largest = starts[band], starts[band + 1] - 1
    least = differing(largest + 100 * largest // percent, percent) + 1
    own = 1.0 - min(MOST_COMMON, COMMON_SHARE + COMMON_SHINGLES / n)
    best = None
    for slack in range(1, least + 4):
        weight = least + slack
        for deletion in range(0, min(weight // 2, 40) + 1):
            exact = weight - 2 * deletion
            size = n / (exact + DELETION_SIZE * deletion)
            by_chance = exact * math.exp(-size * own)
            chance_deletion = deletion * (1 + DELETION_SIZE * size) * math.exp(-DELETION_SIZE * size * own)
            rows = exact + deletion * (1 + DELETION_SIZE * size)
            excess = max(0.0, by_chance + 2 * math.sqrt(by_chance) - slack) + chance_deletion
            cost = rows * (1.0 + 0.2 * excess) + 30.0 * excess
            if best is None or cost < best[0]:
                best = (cost, exact, deletion, weight)
    known[band, percent] = best[1:]
    return best[1:]


# ---- Shingles and signatures, in Python workers -------------------------------------------


def shingle_sets(w: Words, count: int, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = w.windows(k)
    bound = np.searchsorted(w.doc[at], np.arange(count + 1))
    for i in range(count):
        a, b = bound[i], bound[i + 1]
        if b > a:
            yield np.unique(h[a:b])
        else:
            own = w.hash[w.first[i] : w.first[i + 1]]
            total = np.zeros(1, np.uint64)
            for x in own:
                total = mix(total * np.uint64(31) + x)
            yield total + np.uint64(len(own)) if len(own) else np.zeros(0, np.uint64)


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        local = offsets[a : b + 1] - offsets[a]
        yield from shingle_sets(words(data[offsets[a] : offsets[b]], local, lower=True), b - a, k)


def sketch(h: np.ndarray) -> bytes:
    """Parity of the set in each of a power of two of cells, about one for each shingle."""
    cells = max(8 * FOLDED, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((mix(h ^ _SALT) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch the same set would have with fewer cells."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def parity_distance(a: bytes, b: bytes) -> int:
    """Never more than the number of shingles in which the two sets differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.unpackbits(folded(x, size) ^ folded(y, size)).sum())


def signatures(h: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a set's segments under a band's scheme, with kinds."""
    exact, deletion, _ = scheme(band, percent)
    base = mix(np.array([band], np.uint64) + _SALT)[0]
    unit = (mix(h + base) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    scaled = unit * (exact + DELETION_SIZE * deletion)
    border = DELETION_SIZE * deletion
    segment = np.where(scaled < border, scaled / DELETION_SIZE, deletion + scaled - border).astype(np.int64)
    np.clip(segment, 0, deletion + exact - 1, out=segment)
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    value = mix(h[order] ^ base)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    ends = np.searchsorted(segment, np.arange(deletion + exact + 1))
    sums = total[ends[1:]] - total[ends[:-1]]
    name = mix(np.arange(deletion + exact, dtype=np.uint64) + base)
    in_deletion = slice(0, ends[deletion])
    less = sums[segment[in_deletion]] - value[in_deletion]
    sig = np.concatenate((mix(sums + name), mix(less + name[segment[in_deletion]])))
    kind = np.full(len(sig), DELETED, np.int32)
    kind[:deletion], kind[deletion : deletion + exact] = WHOLE, EXACT
    return sig, kind


def _index(k: int, percent: int, signed: bool):
    schema = ("doc_id bigint, fp bigint, n_shingles bigint, key bigint, node binary, sketch binary, "
              "fold array<bigint>, "
              "sig array<bigint>, tag array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(band_starts(percent))
        seen: set[bytes] = set()
        for batch in sliced(batches, 2):
            sizes, keys, nodes, sketches, folds, sigs, tags, ends = [], [], [], [], [], [], [], [0]
            total = 0
            for h in sets_of(batch.column(2), k):
                n = len(h)
                node = np.array([mix(h).sum(dtype=np.uint64), mix(h ^ _SALT).sum(dtype=np.uint64)], ">u8")
                sizes.append(n)
                keys.append(int(node[0].astype(np.int64)))
                nodes.append(node.tobytes() if n else None)
                # Copies in one partition need neither sketch nor signatures again.
                fresh = n > 0 and nodes[-1] not in seen
                sketches.append(sketch(h) if fresh and not signed else None)
                folds.append(None if sketches[-1] is None else
                             folded(np.frombuffer(sketches[-1], np.uint8), FOLDED).view(np.int64))
                if fresh and len(seen) < 1_000_000:
                    seen.add(nodes[-1])
                if fresh and signed:
                    band = int(np.searchsorted(starts, n, "right")) - 1
                    for lower in (0, 1):
                        if lower and (n * percent + 99) // 100 >= starts[band]:
                            continue  # its smaller partners are all of its own band
                        # Larger partner of a set of the band below, or either one in its own band.
                        most = n + (starts[band] - 1 if lower else 100 * n // percent)
                        allowed = differing(int(most), percent)
                        if not allowed:
                            continue
                        sig, kind = signatures(h, band - lower, percent)
                        slack = scheme(band - lower, percent)[2] - allowed - 1
                        sigs.append(sig.view(np.int64))
                        tags.append(kind + 4 * lower + 8 * slack)
                        total += len(sig)
                ends.append(total)
            none64, none32 = np.zeros(0, np.int64), np.zeros(0, np.int32)
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(folds, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none64, *sigs]))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none32, *tags]).astype(np.int32))),
            ], ["doc_id", "fp", "n_shingles", "key", "node", "sketch", "fold", "sig", "tag"])

    return run, schema


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
          percent: int = PERCENT, signed: bool = True) -> DataFrame:
    """One row per document: id, hash of the text, set size, node, sketch and, if wanted, signatures."""
    run, schema = _index(k, percent, signed)
    return docs.select(_id(doc_id).alias("doc_id"), _fp(text).alias("fp"), F.col(text).alias("text")).mapInArrow(run, schema)


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def _fp(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


# ---- Candidates ---------------------------------------------------------------------------


def lists(indexed: DataFrame) -> DataFrame:
    """Stored (sig, key, kind): the shared segments that each node looks up.

    Signatures are shuffled once. A list is as long as the number of different sets that share a
    segment; it is sorted and counted as a stream and may spill.
    """
    rows = (
        indexed.filter(F.size("sig") > 0)
        .select("key", F.explode(F.arrays_zip("sig", "tag")).alias("s"))
        .select("key", "s.sig", "s.tag")
    )
    kind = F.col("tag") % 4
    same = Window.partitionBy("sig")
    counted = (
        rows.withColumn("n", F.count(F.lit(1)).over(same))
        .withColumn("whole", F.max(kind != DELETED).over(same))
        .filter("n > 1 and whole").dropDuplicates(["sig", "key"])
    )
    costly = Window.partitionBy("key", F.shiftright("tag", 2)).orderBy(
        (kind != EXACT).cast("int"), F.desc("n"), "sig")
    looked_up = counted.withColumn("rank", F.row_number().over(costly)).filter(
        (kind != EXACT) | (F.col("rank") > F.shiftright("tag", 3)))
    # Who agrees most with others: the middle of a group of near copies comes first.
    centre = F.sum("n").over(Window.partitionBy("key")).alias("centre")
    return stored(looked_up.select("sig", "key", kind.alias("kind"), centre), "ngram-lists")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _likely_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose (rep, fp) may be wanted, all wanted ones among them: a Bloom filter of one hash,
    held as a bounded table of words. So the exact join moves few texts that it drops."""
    cells = min(MOST_CELLS, 64 << (CELLS * wanted.count() // 64).bit_length())
    cell = F.pmod(F.xxhash64("rep", "fp"), F.lit(cells))
    words = (
        wanted.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 AS int))")).alias("bits"))
    )
    found = rows.withColumn("cell", cell).join(F.broadcast(words), F.shiftright("cell", 6) == F.col("word"))
    return found.filter(F.bit_get("bits", F.col("cell") % 64) == 1).select(*rows.columns)


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(rep, fp, h): the shingle hashes of the wanted (rep, fp), a document and its text's hash."""
    wanted = stored(wanted, "ngram-wanted")
    rows = docs.select(_id(doc_id).alias("rep"), _fp(text).alias("fp"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            sets = [h.view(np.int64) for h in sets_of(batch.column(2), k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["rep", "fp", "h"])

    # An inner join stays above the filter; a semi join would be moved below it, to all texts.
    return (
        _likely_wanted(rows, wanted).join(wanted, ["rep", "fp"]).dropDuplicates(["rep", "fp"])
        .mapInArrow(run, "rep bigint, fp bigint, h array<bigint>")
    )


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int,
             percent: int) -> DataFrame:
    """Stored (a, b): pairs of nodes whose sets link. `pairs` holds keys (ka < kb)."""

    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        apart = [parity_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        give_back()
        return pa.array(apart, pa.int64())

    side = lambda s: nodes.select(
        F.col("key").alias(f"k{s}"), F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"),
        F.col("sketch").alias(f"s{s}"), F.col("rep").alias(f"r{s}"), F.col("fp").alias(f"f{s}"))
    close = F.arrow_udf(near, "bigint")
    likely = stored(
        pairs.join(side("a"), "ka").join(side("b"), "kb")
        .filter(_fits(F.col("na"), F.col("nb"), percent))
        .withColumn("apart", close("sa", "sb"))
        .filter(F.col("apart") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
        .select("a", "b", "ra", "fa", "rb", "fb"),
        "ngram-likely",
    )

    wanted = likely.select("ra", "fa").union(likely.select("rb", "fb")).toDF("rep", "fp").distinct()
    texts = stored(_sets(docs, wanted, doc_id, text, k), "ngram-sets")
    common = F.size(F.array_intersect("ha", "hb"))
    union = F.size("ha") + F.size("hb") - common
    return stored(
        likely.join(texts.toDF("ra", "fa", "ha"), ["ra", "fa"]).join(texts.toDF("rb", "fb", "hb"), ["rb", "fb"])
        .filter(common * 100 >= union * percent).select("a", "b"),
        "ngram-links",
    )


def _stars(of_lists: DataFrame) -> DataFrame:
    """Each member of a list with its most central whole member."""
    first = of_lists.filter(F.col("kind") != DELETED).groupBy("sig").agg(F.max(F.struct("centre", "key")).alias("hub"))
    return _ordered(of_lists.join(first, "sig").select(F.col("hub.key").alias("x"), F.col("key").alias("y")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return (
        pairs.filter("x <> y").select(F.least("x", "y").alias("ka"), F.greatest("x", "y").alias("kb"))
        .distinct()
    )


def _of_more(rows: DataFrame, by: str) -> DataFrame:
    """Rows of lists whose members are in more than one component."""
    apart = rows.groupBy(by).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return rows.join(apart.filter("lo <> hi").select(by), by)


def _across(of_lists: DataFrame, by_key: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int,
            percent: int) -> DataFrame:
    """Pairs of members of lists that are in different components so far and may link.

    Only shingles in the prefix of both bring two sets together: the rarest n - ceil(percent * n) + 1
    of each, of which linked sets have one in common. Shingles that no other of these documents
    has come first; a document that fills its prefix with them links with nobody. Pairs that met are
    bounded by sizes, own shingles and folded sketches before their sets are compared.
    """
    mixed = _of_more(of_lists.select("sig", "key").join(by_key.select("key", "component"), "key"), "sig")
    members = stored(by_key.join(mixed.select("key").distinct(), "key", "left_semi"), "ngram-members")
    shingles = stored(
        _sets(docs, members.select("rep", "fp").distinct(), doc_id, text, k)
        .join(members.select("key", "rep", "fp", "n_shingles"), ["rep", "fp"])
        .select("key", "n_shingles", F.explode("h").alias("h")),
        "ngram-shingles",
    )
    # A shingle's count here is its rank everywhere; ties go by the hash.
    counted = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    common = shingles.join(counted.filter("n > 1"), "h")
    shared = common.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    room = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / F.lit(100)) + 1
    able = (
        members.join(shared, "key").withColumn("own", F.col("n_shingles") - F.col("shared"))
        .withColumn("room", room - F.col("own")).filter("room > 0")
        .select("key", "component", "n_shingles", "own", "room", "fold")
    )
    able = stored(able, "ngram-able")
    rarest = Window.partitionBy("key").orderBy("n", "h")
    prefix = stored(
        common.drop("n_shingles").join(able.select("key", "room"), "key")
        .withColumn("rank", F.row_number().over(rarest)).filter("rank <= room").select("h", "key"),
        "ngram-prefix",
    )
    return _meeting(prefix, able, percent)


def _meeting(prefix: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """(ka, kb): keys of different components with a prefix shingle in common whose sizes, own
    shingles and folded sketches do not exclude a link."""
    lists = _of_more(prefix.join(able.select("key", "component"), "key"), "h").drop("component")
    met = stored(lists.join(able.drop("room"), "key"), "ngram-lists-met")
    side = lambda s: met.select(
        "h", F.col("key").alias(s), F.col("component").alias(f"c{s}"), F.col("n_shingles").alias(f"n{s}"),
        F.col("own").alias(f"own_{s}"), F.col("fold").alias(f"fold_{s}"))
    cells = sum((F.bit_count(F.col("fold_x")[i].bitwiseXOR(F.col("fold_y")[i])) for i in range(FOLDED // 8)), F.lit(0))
    most = (F.col("nx") + F.col("ny")) * (100 - percent)
    differ = ((F.col("own_x") + F.col("own_y")) * (100 + percent) <= most) & (cells * (100 + percent) <= most)
    return _ordered(side("x").join(side("y"), "h").filter(
        (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & _fits(F.col("nx"), F.col("ny"), percent) & differ))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                       percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node, and `kept`, whether it is the
    first row of its component by id and hash of the text; rows without words all are."""
    # Signatures are many times larger than the rest and go straight into the shuffle.
    indexed = stored(index(docs, doc_id, text, k, percent, signed=False).drop("sig", "tag"), "ngram-index")
    nodes = stored(
        indexed.filter("n_shingles > 0").groupBy("node", "key", "n_shingles")
        .agg(F.min(F.struct("doc_id", "fp")).alias("rep"), F.first("sketch", True).alias("sketch"),
             F.first("fold", True).alias("fold"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"fp": F.col("rep.fp"), "rep": F.col("rep.doc_id")}),
        "ngram-nodes",
    )
    of_lists = lists(index(docs, doc_id, text, k, percent).select("key", "sig", "tag"))
    tried = stored(_stars(of_lists), "ngram-stars")
    links = verified(tried, nodes, docs, doc_id, text, k, percent)
    grouped = connect(links)  # (id, component) of nodes with links
    by_key = stored(
        nodes.join(grouped, F.col("node") == F.col("id"), "left")
        .select("key", "n_shingles", "rep", "fp", "fold", F.coalesce("component", "node").alias("component")),
        "ngram-keys",
    )
    rest = _across(of_lists, by_key, docs, doc_id, text, k, percent)
    rest = stored(rest.join(tried, ["ka", "kb"], "left_anti"), "ngram-rest")
    more = verified(rest, nodes, docs, doc_id, text, k, percent)
    final = connect(links.unionByName(more))
    named = (
        nodes.join(final, F.col("node") == F.col("id"), "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = named.groupBy("component").agg(F.min(F.struct("rep", "fp")).alias("first"))
    by_node = stored(named.join(names, "component").select("node", "first", "copies"), "ngram-names")
    rows = indexed.select("doc_id", "fp", "n_shingles", "node")
    found = join_counted(rows.filter("node is not null"), by_node, ["node"], "copies", indexed.count())
    found = found.withColumn("kept", F.struct("doc_id", "fp") == F.struct(F.col("first.rep").alias("doc_id"), F.col("first.fp").alias("fp")))
    alone = rows.filter("node is null").withColumn("kept", F.lit(True))
    known = lambda c: F.nullif(c, F.lit(LAST))
    columns = ["n_shingles", "node", "fp", "kept"]
    return found.select(known(F.col("doc_id")).alias("doc_id"), known(F.col("first.rep")).alias("component_id"), *columns).unionByName(
        alone.select(known(F.col("doc_id")).alias("doc_id"), known(F.col("doc_id")).alias("component_id"), *columns))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
             percent: int = PERCENT) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all its columns; rows without
    words all stay. Of rows that share this id the one with the smallest hash of its text stays;
    rows alike in both are one document and stay together."""
    found = jaccard_components(docs, doc_id, text, k, percent)
    gone = found.filter("not kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("gone"), F.col("fp").alias("gone_fp")).distinct()
    return docs.join(gone, (_id(doc_id) == gone["gone"]) & (_fp(text) == gone["gone_fp"]), "left_anti")
