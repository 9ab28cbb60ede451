import random

import pytest
import reference
from reference import prose

from skyledger.llm import phrase_dedup

SF = "/root/testdata/sf0.001"


def against_brute_force(spark, rows, **parameters):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in phrase_dedup.remove_phrases(docs, **parameters).collect()), key=str)
    want = sorted(((rows[i][0], *x) for i, x in reference.repeated_windows(rows).items()), key=str)
    assert got == want
    return got


def test_odd_rows(spark, odd_rows):
    got = against_brute_force(spark, [(r[0], r[1]) for r in odd_rows])
    assert sum(n for _, _, n, _ in got) > 2000


@pytest.mark.parametrize("parameters", [{}, {"part_bytes": 2000, "shard": 7}])
def test_passages_that_begin_and_end_anywhere(spark, parameters):
    """Shared passages cut out of one another, inside one document too, next to changed words."""
    draw = random.Random(11)
    pool = [prose(draw, 120).split() for _ in range(4)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += prose(draw, draw.randint(0, 25)).split()
            source = draw.choice(pool)
            a = draw.randrange(len(source) - 10)
            piece = source[a : a + draw.randint(5, 70)]
            if draw.random() < 0.3:
                piece[draw.randrange(len(piece))] = "changed"
            words += piece
        rows.append((i * 7 % 90, " ".join(words)))
    assert sum(n > 0 for _, _, n, _ in against_brute_force(spark, rows, **parameters)) > 40


def test_overlaps_within_one_document(spark):
    rows = [(1, "a " * 70), (2, "a b " * 45), (3, " ".join(f"w{i % 23}" for i in range(90))), (4, "a " * 19),
            (5, "a " * 20), (6, "a\tb\n" * 10)]
    against_brute_force(spark, rows)


def test_null_and_reused_ids(spark):
    draw = random.Random(2)
    passage, other = prose(draw, 40), prose(draw, 30)
    rows = [(None, "x " + passage), (None, passage), (7, passage + " " + other), (7, "y " + passage), (3, other), (9, None)]
    against_brute_force(spark, rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    draw = random.Random(3)
    passage = prose(draw, 300)
    long = " ".join((prose(draw, 700), passage, prose(draw, 400)))
    monkeypatch.setattr(phrase_dedup, "PIECE", 90)
    import numpy as np

    from skyledger.llm.common import words
    for text in (long, passage):
        data = np.frombuffer(text.encode(), np.uint8)
        w = words(data, np.array([0, len(data)]))
        _, start, count, *_ = phrase_dedup.document_contexts(w)
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(start, count, strict=True)])
        assert sorted(covered.tolist()) == list(range(len(w.hash) - 19))


def test_automaton_finds_every_occurrence():
    texts = [b"a b c d", b"b c", b"c d a", b"b c d e f"]
    found = phrase_dedup.PhraseAutomaton(texts)
    import numpy as np

    from skyledger.llm.common import words
    data = np.frombuffer(b"a b  c d a b c\nd e f", np.uint8)
    w = words(data, np.array([0, len(data)]))
    flat, begin = phrase_dedup.joined(data, w)
    code = (w.hash & np.uint64(255)).astype(np.uint8).tobytes().decode("latin-1")
    got = sorted(found.occurrences(code, flat, begin.tolist(), 0))
    assert got == [(0, 0, 4), (0, 4, 8), (1, 1, 3), (1, 5, 7), (2, 2, 5), (3, 5, 10)]


def test_repeated_rows_clashing_columns_and_empty_tables(spark, twice, none):
    assert phrase_dedup.remove_phrases(twice).count() == 141
    extra = ["part", "kind", "anchor", "content", "start", "words"]
    clash = none.selectExpr("*", *[f"1 AS {c}" for c in extra])
    assert phrase_dedup.remove_phrases(clash).count() == 0
    assert phrase_dedup.remove_phrases(none).columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = reference.repeated_windows(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.remove_phrases(docs).collect()}
    assert got == {rows[i][0]: x for i, x in want.items()}
