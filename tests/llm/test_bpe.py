import random
import sys

import numpy as np
import pytest

from skyledger.llm import bpe
from skyledger.llm.queries import tokenizer

ODD = ["a", "'s", "'re", " ", "  ", "\n", "\t", "é", "中", "१", "²", "Ⅷ", "\x1c", "\x85", "\u2003", "😀", "!",
       "<|endoftext|>", "\x00", "aaaa", "the", "ing", "123", "\u0301", "\u200b", "\ufeff", "ſ", "ﬁ"]


@pytest.fixture(scope="module")
def model():
    return bpe.load(tokenizer()).prepare()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def ids(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


def test_ids_of_odd_strings(model, library):
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 14)))
        assert ids(model, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point_falls_into_the_right_class(model, library):
    points = [c for c in range(0, sys.maxunicode + 1, 7) if not 0xD800 <= c < 0xE000]
    for c in points[:40_000:3]:
        text = f"a{chr(c)}1{chr(c)} x"
        assert ids(model, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_full_memory_changes_nothing(library):
    small = bpe.load(tokenizer())
    small.memory = 5
    small.prepare()
    draw = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(draw.choices("aeinorst", k=6)) for _ in range(20))
        assert ids(small, text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_documents(odd, odd_rows, library):
    coded = bpe.encode(odd.select("doc_id", "text"), tokenizer(), decoded="again", keep=["doc_id"])
    got = {r.doc_id: r for r in bpe.decode(coded, tokenizer()).collect()}
    for row in odd_rows:
        text = row[1] or ""
        assert got[row[0]].ids == library.encode(text, add_special_tokens=False).ids
        assert got[row[0]].decoded == got[row[0]].again == text


def test_decoding_replaces_broken_bytes_and_keeps_null(spark, library):
    rows = [(0, [447]), (1, [447, 247]), (2, []), (3, None), (4, [50256, 1])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, tokenizer()).collect()}
    assert got[3] is None
    for k, v in rows:
        if v is not None:
            assert got[k] == library.decode(v, skip_special_tokens=False)


def test_empty_table(none):
    coded = bpe.encode(none, tokenizer())
    assert bpe.decode(coded, tokenizer()).columns == [*none.columns, "ids", "decoded"]
    assert bpe.decode(coded, tokenizer()).count() == 0
