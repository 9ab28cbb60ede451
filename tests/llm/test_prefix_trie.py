import random

import pytest
import reference

from skyledger.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.conversation_trie(docs).collect()]
    assert sorted(got, key=str) == reference.conversation_trie(rows)
    return got


def test_shared_prefixes_at_every_depth(spark):
    """Long and short conversations that part at any depth, across the borders of pieces."""
    draw = random.Random(6)
    trunk = [("user", f"turn {k} of the trunk") for k in range(70)]
    rows = []
    for c in range(64):
        keep = draw.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 40, 63, 64, 70])
        own = trunk[:keep] + [("assistant", f"{draw.randrange(3)} {k}") for k in range(draw.choice([0, 0, 1, 3, 20]))]
        rows += [(c * 3 % 70, t, role, text) for t, (role, text) in enumerate(own)]
    got = against_brute_force(spark, rows)
    assert max(r[1] for r in got) > 64 and max(r[3] for r in got) > 20


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 5, "user", ""), (1, 5, "a", "x y"),
            (2, 1, "", "us er"), (2, 1, "us", "er"), (21, 0, "user", "only one"), (40, 3, None, "a  b\tc"),
            (45, 1, "u", None), (45, 2, "u", "z"), (None, 1, "user", "nobody"), (-7, 1, "u", "a"), (-20, 1, "u", "b"),
            (-27, 0, "user", "a b"), (-27, 1, "u", "c")]
    against_brute_force(spark, rows)


def test_one_conversation_in_many_copies(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 300) for t in range(5)]
    got = against_brute_force(spark, rows)
    assert max(r[3] for r in got) == 300


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(20, 1, "ab", "c"), (40, 1, "a", "bc"), (60, 1, "abc", ""), (80, 1, "", "abc")]
    against_brute_force(spark, rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_conversations(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    against_brute_force(spark, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", name string, i int, words int, last int")
    assert prefix_trie.conversation_trie(none).count() == 0
    some = spark.createDataFrame([(1, 1, "u", "t", "n", 1, 2, 3)], none.schema)
    assert prefix_trie.conversation_trie(some).count() >= 1
