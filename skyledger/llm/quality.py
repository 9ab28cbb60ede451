"""Quality rules, line first.

Every line of a text is judged by itself: punctuation, navigation, boilerplate, shouting and
repetition. Failing lines are removed, and a document that loses too much of its text goes.
Documents also have to pass two base rules: at least 50 words, and at most half of the words in
3-word windows that the text repeats.

Null and empty text have no words, fail the base rules and are rejected. Repeated rows are judged
alike, extra columns pass through untouched, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import SEPARATORS, give_back, pieces, utf8, words

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_COUNTED = np.ones(256, bool)  # bytes that begin a code point of a word
_COUNTED[0x80:0xC0] = False
_COUNTED[[ord(c) for c in SEPARATORS]] = False


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules."""

    max_lost: float = 0.5  # share of word characters on failing lines
    max_symbols_per_word: float = 0.3
    min_letters: float = 0.5  # share of word characters
    max_upper: float = 0.7  # share of letters, on lines of min_judged words
    max_exclaiming: float = 0.3  # share of words that end in !!
    min_distinct: float = 0.25  # share of words, on lines of min_judged words
    min_judged: int = 8
    max_without_end: int = 3  # words a line without closing punctuation may have and still fail


#: Phrases of page furniture; a short line that has one is boilerplate.
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (use|service)|privacy policy|cookie|enable javascript|"
    r"sign up|log ?in\b|subscribe|click here|read more|share (this|on)|skip to content", re.I
)
BOILERPLATE_WORDS = 12
NAVIGATION = re.compile(r"\s[|›»/·•]\s")
CLOSED = tuple('.!?…:;"\'”’»)]')

OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("lost_chars", T.LongType()), T.StructField("kept", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
])


def line_fails(line: str, rules: LineRules) -> str | None:
    """The first rule a line fails, or None. A line without a word fails none."""
    parts = line.split()
    if not parts:
        return None
    n, chars = len(parts), sum(map(len, parts))
    symbols = sum(map(line.count, SYMBOLS))
    if symbols > rules.max_symbols_per_word * n:
        return "navigation" if NAVIGATION.search(line) else "symbols"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    if len(NAVIGATION.findall(line)) > max(2, 0.3 * n):
        return "navigation"
    if n <= rules.max_without_end and not line.rstrip().endswith(CLOSED):
        return "punctuation"
    if sum(p.endswith("!!") for p in parts) > rules.max_exclaiming * n:
        return "punctuation"
    if n >= rules.min_judged:
        if len(set(parts)) < rules.min_distinct * n:
            return "repetition"
        letters = sum(map(str.isalpha, line))
        if letters < rules.min_letters * chars:
            return "letters"
        if sum(map(str.isupper, line)) > rules.max_upper * letters:
            return "shouting"
    return None


def clean_lines(text: str, rules: LineRules) -> tuple[str, int, int]:
    """The text without failing lines, repeated lines in it, and word characters lost."""
    lines = text.split("\n")
    with_word = [line for line in lines if line.strip(SEPARATORS)]
    good, lost = [], 0
    for line in lines:
        if line_fails(line, rules):
            lost += sum(map(len, line.split()))
        else:
            good.append(line)
    return "\n".join(good) if lost else text, len(with_word) - len(set(with_word)), lost


def _measure(batch: pa.Array, rules: LineRules) -> pa.StructArray:
    data, offsets = utf8(batch)
    w = words(data, offsets)
    n, count = w.counts(), len(batch)
    sums = []
    for table in (_COUNTED, _SYMBOL):
        total = np.concatenate(([0], np.cumsum(table[data])))
        sums.append(np.diff(total[offsets]))
    h, at = w.windows(3)
    order = np.lexsort((h, w.doc[at]))
    h, at = h[order], at[order]
    same = (h[1:] == h[:-1]) & (w.doc[at[1:]] == w.doc[at[:-1]])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(w.hash), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    repeated = np.bincount(w.doc[covered], minlength=count)
    cleaned = [clean_lines(t or "", rules) for t in batch.to_pylist()]
    lost = np.array([c[2] for c in cleaned], np.int64)
    failed = (n < MIN_WORDS) | (repeated > MAX_REPEATED * n)
    kept = ~failed & (lost <= rules.max_lost * sums[0])
    values = [n, sums[0], sums[1], np.array([c[1] for c in cleaned], np.int64), repeated, failed, lost, kept]
    return pa.StructArray.from_arrays(
        [*map(pa.array, values), pa.array([c[0] for c in cleaned], pa.string())], OUTPUT.names)


def measure(batch: pa.Array, rules: LineRules) -> pa.StructArray:
    """Measures and verdicts of a batch, a slice of bounded size at a time."""
    width = np.asarray(pc.fill_null(pc.binary_length(batch), 0), np.int64)
    cuts = pieces(np.concatenate(([0], np.cumsum(width))))
    parts = [_measure(batch.slice(a, b - a), rules) for a, b in cuts]
    return pa.concat_arrays(parts) if parts else _measure(batch, rules)


def with_quality(docs: DataFrame, text: str = "text", name: str = "quality",
                 rules: LineRules = LineRules()) -> DataFrame:
    """Add a struct column with the measures, the verdict and the cleaned text."""

    def judge(batch: pa.Array) -> pa.Array:
        measured = measure(batch, rules)
        give_back()
        return measured

    return docs.withColumn(name, F.arrow_udf(judge, OUTPUT)(F.col(text)))
