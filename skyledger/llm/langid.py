"""Language identification with language-bitmask n-gram filters.

For every language a Bloom filter holds its frequent letter trigrams. The filters are bit-sliced:
one table whose cells have a bit for each language, so three lookups and two ANDs return all
languages that contain a trigram. A text is given to the language with most of its trigrams,
after its count is corrected for the filter's false positives.

Trigrams are counted over all training rows as a distributed sum. A trigram enters a filter if it
makes up at least `min_share` of its language's trigrams, so a language has at most 1 / min_share
of them, however large the corpus: that bounds the filter, which is built on the driver and
broadcast.

Text that is null or has no letter is `und` with score 0, and so is everything if no row is
labelled. Ties go to the language that comes first by name. Texts are read whole; repeated rows
are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import mix, share, shared, sliced, stored

MIN_SHARE = 2e-5
PROBES = 3
CELLS_PER_GRAM = 12
UNKNOWN = "und"


def _letters(known: list = []) -> np.ndarray:  # noqa: B006
    """Which code points are letters; made once in a worker."""
    if not known:
        known.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return known[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Exact 63-bit codes of all trigrams around a letter, and the text each is from.

    Texts are lower-cased and padded with a space; all but letters counts as space.
    """
    lowered = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(letter)  # never at an edge of a text
    gram = code[at - 1] << np.uint64(42) | code[at] << np.uint64(21) | code[at + 1]
    return gram, doc[at]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text) rows, combined in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            gram, doc = trigrams([t or "" for t in batch.column(1).to_pylist()])
            lang = np.array([names.index(x) for x in langs])[doc]
            for i, name in enumerate(names):
                found, n = np.unique(gram[lang == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])

    parts = labelled.mapInArrow(run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    """Bit-sliced Bloom filters: cells[word][cell] holds 64 languages' bits."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        h, top = mix(gram), np.uint64(self.cells.shape[1] - 1)
        places = [((h >> np.uint64(20 * i)) & top).astype(np.int64) for i in range(PROBES)]
        return [np.bitwise_and.reduce([word[p] for p in places]) for word in self.cells]

    def corrected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and how many of them each language truly contains."""
        gram, doc = trigrams(texts)
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        masks = self.masks(gram)
        found = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            hit = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            found[:, i] = np.bincount(doc, weights=hit, minlength=len(texts))
        return total, np.maximum(0.0, found - total[:, None] * self.false_rate) / (1.0 - self.false_rate)


def fit(labelled: DataFrame, min_share: float = MIN_SHARE) -> Filters:
    """Learn filters from (lang, text) rows with non-null lang."""
    counts = stored(gram_counts(labelled), "langid-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").filter(F.col("n") >= F.col("total") * min_share)
    rows = frequent.select("lang", "gram").collect()  # at most 1 / min_share for each language
    languages = sorted({r["lang"] for r in rows})
    largest = max([sum(r["lang"] == x for r in rows) for x in languages], default=1)
    size = 1 << max(10, int(largest * CELLS_PER_GRAM - 1).bit_length())
    cells = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
    made = Filters(languages, cells, np.zeros(len(languages)))
    for i, name in enumerate(languages):
        h = mix(np.array([r["gram"] for r in rows if r["lang"] == name], np.uint64))
        for p in range(PROBES):
            place = ((h >> np.uint64(20 * p)) & np.uint64(size - 1)).astype(np.int64)
            cells[i // 64][place] |= np.uint64(1 << (i % 64))
        filled = ((cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        made.false_rate[i] = min(0.99, filled**PROBES)
    return made


def predict(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score). The score is the best language's share of its own and the
    runner-up's trigrams."""
    handle = share(docs.sparkSession, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(handle)
        for batch in sliced(batches, 1):
            total, count = model.corrected([t or "" for t in batch.column(1).to_pylist()])
            pred, score = [UNKNOWN] * len(total), np.zeros(len(total))
            if model.languages:
                best = count.argmax(axis=1)
                ordered = np.sort(np.pad(count, ((0, 0), (1, 0))), axis=1)
                both = ordered[:, -1] + ordered[:, -2]
                score = np.where((total > 0) & (both > 0), ordered[:, -1] / np.maximum(both, 1e-9), 0.0)
                pred = [model.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
