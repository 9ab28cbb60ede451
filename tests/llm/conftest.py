import random

import pytest
from reference import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, copies, near copies, ties and a hot group."""
    draw = random.Random(5)
    base, passage = prose(draw, 80), prose(draw, 20)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3),
            (3, base, "en", "a", len(base)), (4, base.upper(), "en", "b", len(base)),
            (5, base.replace(" ", "  "), None, "b", 1), (6, base, "en", None, len(base))]
    for i in range(7, 60):
        words = base.split()
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4])):
            words[draw.randrange(len(words))] = prose(draw, 1)
        rows.append((i, " ".join(words), "en", "hot", 1))
    for i in range(60, 110):
        n = draw.choice([1, 2, 3, 4, 5, 6, 8, 12, 30, 60])
        rows.append((i, prose(draw, n) + "\n" + (passage if i % 2 else ""), "de", f"s{i % 5}", n))
    for i in range(110, 118):
        rows.append((i, passage + " " + passage, "fr", "hot", 2))
    rows.append((118, prose(draw, 30_000), "es", "long", 9))
    rows.append((119, "Ärger über 中文 «Ñandú» ſtraße " * 12, "de", "a", 7))
    rows.append((120, "one two\x0bthree\x0cfour\x1cfive\x85six seven " * 20, "en", "a", 7))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def twice(spark, odd_rows):
    """Every row twice, a null doc_id, and columns named as operators name theirs."""
    rows = [(*r, i, 2, "x") for i, r in enumerate(odd_rows[:70] * 2)] + [(None, odd_rows[3][1], "en", "a", 1, 0, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA + ", size long, kept int, h string")
