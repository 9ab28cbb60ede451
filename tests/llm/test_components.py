import pytest

from skyledger.llm import components


def test_a_long_path_and_separate_parts(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (600, 600)]
    got = {r.id: r.component for r in components.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_unfinished_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 2)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connect(edges)
