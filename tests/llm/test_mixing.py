import pytest
import reference
from pyspark.sql import functions as F

from skyledger.llm import mixing


def level_targets(sizes):
    """Targets by resharing the excess again and again; sizes in the order of the sources."""
    weight = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / total >= 2 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


def check(rows, got):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(reference.WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, level_targets([sizes[s] for s in order]), strict=True))
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(order, 0)
    for r in got:
        own = source[r.doc_id]
        assert r.source_size == sizes[own] and r.target == pytest.approx(want[own], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[own] += r.taken
    return want, taken


def test_targets_and_words_taken(odd, odd_rows):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows)
    want, taken = check(odd_rows, got)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(100, 0.05 * want[s]) or s == "long"
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(odd.repartition(7)).collect()))


def test_many_documents_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), "", f"s{i % 4}" if i % 3 else None, 0) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    want, taken = check(rows, got)
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.005)


def test_hot_strata_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRATUM_ROWS", 20)
    rows = [(i, "a b c", "", "hot" if i % 3 else "rest", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df).collect()
    want, taken = check(rows, got)
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.01)


def test_rows_of_the_mix(twice):
    slim = mixing.mix(twice).groupBy("doc_id").agg(F.sum("copies").alias("n"))
    rows = mixing.mixed(twice)
    assert rows.columns == twice.columns
    per_doc = {r.doc_id: r.n for r in slim.collect() if r.n}
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == per_doc


def test_empty_table(none):
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(none).count() == 0
