"""Substring dedup by repeated-phrase automata: words of 20-word windows that occur earlier go.

A window occurs earlier if a document with a smaller id has its word sequence, or the same document
does at a smaller word number. Windows are judged on the input.

1. Every 20-word window has an anchor, the least five-word gram in it by a hash. Windows in a row
   with one anchor are a context. Equal windows have equal anchors, so only contexts whose anchor
   recurs in the corpus can hold a recurring passage; all others end at the first shuffle, which
   counts anchors and combines before it moves them.
2. Recurring passages are confirmed: of an anchor with one form of context, the context is the
   phrase. Of an anchor whose contexts differ, the windows that recur are found by a digest of their
   words, and runs of them with one first place are the phrases. Each phrase has its words, and the
   first place (document, word number) where they occur.
3. Documents are dealt over parts of a few MB by a hash of their id; each part gets every phrase that
   one of its documents may hold from an earlier place, once. So a passage that a third of all
   documents share costs one row for each part.
4. Each part compiles its phrases into Aho-Corasick automata, a shard of bounded size at a time, and
   streams its documents through them, which locates every occurrence. The automaton reads one byte
   for each word; what it finds is compared as text, so the phrases decide and the hashes only route.

A null text counts as empty; texts with fewer words than a window lose nothing. Null doc_ids come after
all others. Rows that share a doc_id are read as one document whose word numbers overlap: an equal
place does not repeat another, a greater one does. Other columns are left alone. Texts are read
whole; a text of more than PIECE words is cut into overlapping pieces, which only changes contexts.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import Words, give_back, mix, sliced, stored, utf8, words

WIDTH = 20
GRAM = 5
#: Words of a text whose windows are hashed at once.
PIECE = 1 << 20
#: Bytes of text in a part of the documents, and phrases in one automaton (about 30 nodes each).
PART_BYTES = 4 << 20
AUTOMATON = 25_000
#: A null doc_id counts as larger than all others.
LAST = (1 << 63) - 1
_SALT = np.uint64(0x6A09E667F3BCC909)
_PLACE = 23  # bits of a place in a piece
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0, 1, ... modulo 2 ** 64; made once in a worker."""
    if len(known.get(base, ())) < n:
        known[base] = np.concatenate(
            (np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 18), base, np.uint64))))
    return known[base]


def contexts(w: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of several texts: text, first window, windows, anchor's hash, hash of all words.

    Windows are given by the place of their first word in `w`.
    """
    n, span = len(w.hash), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return (none,) * 5
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * _powers(n, _BASE)[:n])))
    inverse = _powers(n, _INVERSE)
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    mask = np.uint64((1 << _PLACE) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: reach - span], least[span - reach :])
    start = np.flatnonzero(w.doc[: n - width + 1] == w.doc[width - 1 :])
    if not len(start):
        return (none,) * 5
    least, text = least[start], w.doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a = start[first]
    anchor = grams[(least[first] & mask).astype(np.int64)].view(np.int64)
    content = mix((prefix[a + count - 1 + width] - prefix[a]) * inverse[a]) ^ mix(count.astype(np.uint64))
    return text[first], a, count, anchor, content.view(np.int64)


def _pieces_of(w: Words, width: int) -> Iterator[tuple[int, Words]]:
    """(first word, words): the texts of `w` as they are, or overlapping pieces of one long text."""
    n = len(w.hash)
    if n <= PIECE:
        yield 0, w
        return
    for text in range(len(w.first) - 1):
        lo, hi = int(w.first[text]), int(w.first[text + 1])
        for a in range(lo, max(lo + 1, hi - width + 1), PIECE):
            b = min(hi, a + PIECE + width - 1)
            yield a, Words(w.start[a:b], w.end[a:b], w.doc[a:b], w.hash[a:b], w.first)


def document_contexts(w: Words, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """`contexts` with texts of any length."""
    parts = []
    for a, piece in _pieces_of(w, width):
        text, start, count, anchor, content = contexts(piece, width)
        parts.append((text, start + a, count, anchor, content))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else contexts(w, width)


def joined(data: np.ndarray, w: Words) -> tuple[bytes, np.ndarray]:
    """All words, each followed by a space, and the place of each word."""
    length = w.end - w.start
    begin = np.concatenate(([0], np.cumsum(length + 1))).astype(np.int64)
    out = np.full(int(begin[-1]), 32, np.uint8)
    inner = np.arange(int(length.sum())) - np.repeat(begin[:-1] - np.arange(len(length)), length)
    out[np.repeat(begin[:-1], length) + inner] = data[np.repeat(w.start, length) + inner]
    return out.tobytes(), begin


def _anchored(slim: DataFrame, width: int) -> DataFrame:
    """(part, anchor, content, doc, start, n) of every text's different contexts; n counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            part, owner = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            w = words(*utf8(batch.column(2)))
            text, start, _, anchor, content = document_contexts(w, width)
            order = np.lexsort((start, content, text))
            new = np.ones(len(order), bool)
            new[1:] = (text[order][1:] != text[order][:-1]) | (content[order][1:] != content[order][:-1])
            first = np.flatnonzero(new)
            at = order[first]
            count = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[text[at]]), pa.array(anchor[at]), pa.array(content[at]), pa.array(owner[text[at]]),
                 pa.array((start[at] - w.first[text[at]]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["part", "anchor", "content", "doc", "start", "n"])

    return slim.mapInArrow(run, "part int, anchor bigint, content bigint, doc bigint, start int, n int")


def _fetched(slim: DataFrame, forms: DataFrame, width: int) -> DataFrame:
    """(anchor, content, several, n, doc, start, words, windows): the words of each form of context,
    from the document that has it first."""
    blank = F.lit(None)
    asked = forms.select(
        "part", F.lit(0).alias("kind"), "doc", "anchor", "content", "several", "n", "start",
        blank.cast("string").alias("text"))
    texts = slim.select(
        "part", F.lit(1).alias("kind"), "doc",
        *[blank.cast(k).alias(c) for c, k in (("anchor", "long"), ("content", "long"), ("several", "boolean"),
                                              ("n", "long"), ("start", "int"))], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, list] = {}  # of the present part: doc, lists of its forms
        part = None
        for batch in sliced(batches, 8):
            place, kind = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if b <= a:
                    continue
                if place[a] != part:
                    part, wanted = place[a], {}
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    for doc, *form in zip(*(rows.column(i).to_pylist() for i in range(2, 8)), strict=True):
                        wanted.setdefault(doc, []).append(form)
                    continue
                owner = rows.column(2).to_pylist()
                hit = [i for i, doc in enumerate(owner) if doc in wanted]
                if not hit:
                    continue
                rows = rows.take(pa.array(hit))
                data, offsets = utf8(rows.column(8))
                w = words(data, offsets)
                text, start, count, _, content = document_contexts(w, width)
                flat, begin = joined(data, w)
                bound = np.searchsorted(text, np.arange(len(hit) + 1))
                out = []
                for i, row in enumerate(hit):
                    lo, hi = bound[i], bound[i + 1]
                    place_of = dict(zip(zip((start[lo:hi] - w.first[i]).tolist(), content[lo:hi].tolist(), strict=True),
                                        range(lo, hi), strict=True))
                    left = []
                    for form in wanted[owner[row]]:
                        at = place_of.get((form[4], form[1]))
                        if at is None:  # another row has this doc_id
                            left.append(form)
                            continue
                        s, e = int(start[at]), int(start[at] + count[at] - 1 + width)
                        out.append((*form[:4], owner[row], form[4], flat[begin[s] : begin[e] - 1].decode(), int(count[at])))
                    wanted[owner[row]] = left
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        ["anchor", "content", "several", "n", "doc", "start", "words", "windows"])

    return (
        asked.unionByName(texts).repartition("part").sortWithinPartitions("part", "kind")
        .mapInArrow(run, "anchor bigint, content bigint, several boolean, n bigint, doc bigint, start int, "
                         "words string, windows int")
    )


def _windows(forms: DataFrame, width: int) -> DataFrame:
    """(anchor, content, k, digest, n, doc, at): every window of the forms. Equal windows have one
    anchor, so it tells windows apart with the digest, by 128 bits together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5):
            w = words(*utf8(batch.column(5)))
            starts = np.flatnonzero(w.doc[: len(w.doc) - width + 1] == w.doc[width - 1 :])
            row = w.doc[starts]
            k = (starts - w.first[row]).astype(np.int32)
            h = mix(w.hash ^ _SALT)
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h), _BASE)[: len(h)])))
            digest = mix((prefix[starts + width] - prefix[starts]) * _powers(len(h), _INVERSE)[starts])
            anchor, content, n, doc, start = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in range(5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(content), pa.array(k), pa.array(digest.view(np.int64)), pa.array(n),
                 pa.array(doc), pa.array(start + k)], ["anchor", "content", "k", "digest", "n", "doc", "at"])

    return forms.select("anchor", "content", "n", "doc", "start", "words").mapInArrow(
        run, "anchor bigint, content bigint, k int, digest bigint, n bigint, doc bigint, at int")


def phrases(forms: DataFrame, width: int = WIDTH) -> DataFrame:
    """(anchor, content, offset, src, at, phrase): for each form of context the phrases in it that
    recur, with the first place of each: word `at` of document `src`."""
    whole = forms.filter("not several").select(
        "anchor", "content", F.lit(0).alias("offset"), F.col("doc").alias("src"), F.col("start").alias("at"),
        F.col("words").alias("phrase"))
    listed = _windows(forms.filter("several"), width)
    first = (
        listed.groupBy("anchor", "digest").agg(F.min(F.struct("doc", "at")).alias("first"), F.sum("n").alias("n"))
        .filter("n > 1").select("anchor", "digest", F.col("first.doc").alias("src"), F.col("first.at").alias("at"))
    )
    # At most as many rows meet in this window as a context has windows.
    inside = Window.partitionBy("anchor", "content").orderBy("k")
    runs = (
        listed.select("anchor", "content", "k", "digest").join(first, ["anchor", "digest"])
        .select("anchor", "content", "k", "src", "at", (F.col("at") - F.col("k")).alias("shift"))
        .withColumn("new", F.when((F.lag("src").over(inside) == F.col("src")) & (F.lag("shift").over(inside) == F.col("shift"))
                                  & (F.lag("k").over(inside) == F.col("k") - 1), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(inside))
        .groupBy("anchor", "content", "run").agg(F.min("k").alias("offset"), F.max("k").alias("until"),
                                                 F.min("src").alias("src"), F.min("at").alias("at"))
    )
    cut = F.array_join(F.slice(F.split("words", " "), F.col("offset") + 1, F.col("until") - F.col("offset") + width), " ")
    some = runs.join(forms.filter("several").select("anchor", "content", "words"), ["anchor", "content"]).select(
        "anchor", "content", "offset", "src", "at", cut.alias("phrase"))
    return whole.unionByName(some)


class PhraseAutomaton:
    """An Aho-Corasick automaton over words, one byte for each; phrases are compared as text."""

    def __init__(self, texts: list[bytes]) -> None:
        data, offsets = utf8(pa.array(texts, pa.binary()).cast(pa.string()))
        w = words(data, offsets)
        code = (w.hash & np.uint64(255)).astype(np.uint8).tobytes().decode("latin-1")
        self.texts, self.counts = texts, w.counts().tolist()
        first = w.first.tolist()
        same: dict[str, list[int]] = {}
        for i in range(len(texts)):
            same.setdefault(code[first[i] : first[i + 1]], []).append(i)
        self.found = ahocorasick.Automaton()
        for key, numbers in same.items():
            if key:
                self.found.add_word(key, numbers)
        self.found.make_automaton()

    def occurrences(self, code: str, flat: bytes, begin: list[int], base: int) -> Iterator[tuple[int, int, int]]:
        """(phrase, first word, word after) of every occurrence in one text, whose first word is word
        `base` of `flat`."""
        texts, counts = self.texts, self.counts
        for last, numbers in self.found.iter(code):
            for i in numbers:
                start = last + 1 - counts[i]
                if flat[begin[base + start] : begin[base + last + 1] - 1] == texts[i]:
                    yield i, start, last + 1


def _cleaned(docs: pa.RecordBatch, listed: list[tuple[int, int, bytes]], shard: int) -> pa.RecordBatch:
    """Documents (doc, doc_id, text) without the words that phrases (src, at, text) cover."""
    data, offsets = utf8(docs.column("text"))
    w = words(data, offsets)
    flat, begin = joined(data, w)
    place, first = begin.tolist(), w.first.tolist()
    code = (w.hash & np.uint64(255)).astype(np.uint8).tobytes().decode("latin-1")
    owner = docs.column("doc").to_pylist()
    gone = np.zeros(len(w.hash) + 1, np.int64)
    for a in range(0, len(listed), shard):
        some = listed[a : a + shard]
        automaton = PhraseAutomaton([x[2] for x in some])
        for row, doc in enumerate(owner):
            base = first[row]
            for i, lo, hi in automaton.occurrences(code[base : first[row + 1]], flat, place, base):
                src, at, _ = some[i]
                if src < doc or src == doc and at < lo:
                    gone[base + lo] += 1
                    gone[base + hi] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    kept, n_removed = [], []
    for row in range(len(owner)):
        lo, hi = first[row], first[row + 1]
        out = covered[lo:hi]
        n_removed.append(int(out.sum()))
        if not n_removed[-1]:
            kept.append(flat[place[lo] : place[hi] - 1] if hi > lo else b"")
        else:
            kept.append(b" ".join(flat[place[i] : place[i + 1] - 1] for i in (np.flatnonzero(~out) + lo).tolist()))
    return pa.RecordBatch.from_arrays([
        docs.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n_removed, pa.int64()),
        pa.array(kept, pa.binary()).cast(pa.string()),
        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    ], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   part_bytes: int = PART_BYTES, shard: int = AUTOMATON) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    # The text counts too, so that rows without an id spread.
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    own = own.select(part.alias("part"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "doc_id", "text")
    slim = own.select("part", "doc", "text")

    rows = _anchored(slim, width)
    recurring = stored(
        rows.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "phrase-anchors")
    met = stored(rows.join(recurring, "anchor"), "phrase-met")
    forms = stored(
        met.groupBy("anchor", "content").agg(F.min(F.struct("doc", "start", "part")).alias("first"), F.sum("n").alias("n"))
        .select("anchor", "content", "n", "first.*"),
        "phrase-firsts",
    )
    several = forms.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    forms = forms.join(several, "anchor")
    # Tables of text lie packed, and between them the shuffles before can go.
    confirmed = stored(
        phrases(stored(_fetched(slim, forms, width), "phrase-forms", "zstd"), width), "phrase-list", "zstd")

    # A part needs a phrase if one of its documents has it later than its first place. Only whether
    # a later one exists counts, so parts are combined before the shuffle.
    needs = met.groupBy("part", "anchor", "content").agg(
        F.max(F.struct("doc", "start")).alias("late"), F.max("n").alias("most"),
    ).select("part", "anchor", "content", "late.*", "most")
    here = F.struct("doc", (F.col("start") + F.col("offset")).alias("at"))
    routed = (
        needs.join(confirmed, ["anchor", "content"])
        .filter((F.col("most") > 1) | (here > F.struct(F.col("src").alias("doc"), "at")))
        .select("part", "src", "at", "phrase")
    )
    sent = routed.select(
        "part", F.lit(0).alias("kind"), F.col("src").alias("doc"), "at", F.lit(None).cast("long").alias("doc_id"),
        F.col("phrase").alias("text"))
    read = own.select(
        "part", F.lit(1).alias("kind"), "doc", F.lit(None).cast("int").alias("at"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, listed, held = None, {}, []
        for batch in batches:
            place, kind = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if b <= a:
                    continue
                if place[a] != part:
                    if held:
                        yield _cleaned(pa.Table.from_batches(held).combine_chunks().to_batches()[0], list(listed), shard)
                    part, listed, held = place[a], {}, []
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    # Contexts that differ may hold the same phrase.
                    listed |= dict.fromkeys(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(),
                                                [x.encode() for x in rows.column(5).to_pylist()], strict=True))
                else:
                    held.append(rows.select(["doc", "doc_id", "text"]))
        if held:
            yield _cleaned(pa.Table.from_batches(held).combine_chunks().to_batches()[0], list(listed), shard)
        give_back()

    return (
        sent.unionByName(read).repartition("part").sortWithinPartitions("part", "kind")
        .mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
    )
