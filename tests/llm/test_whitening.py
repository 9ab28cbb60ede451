import numpy as np
import pytest

from skyledger.llm import bidiagonal, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def check(rows, got, most=16):
    """Result rows against plain numpy on the whole table."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dims = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000) for i, v in good if len(v) == dims]
    fit = np.unique(np.array([x for _, x in good]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-13 * e[0]).sum()))
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    whole = np.zeros((len(good), k))
    for row, (i, x) in enumerate(good):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        for c in range(k):
            r = by[i, deviation][c + 1][0]
            whole[row, c] = r.whitened
            assert r.n == n and abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9
    want = (n * np.array([x for _, x in good]) - s) / n @ (u[:, :k] / np.sqrt(e[:k]))
    for c in range(k):
        apart = [abs(e[c] - x) / e[c] for j, x in enumerate(e) if j != c]
        if min(apart, default=1) > 1e-6:  # else any rotation among equal ones is as good
            sign = np.sign(whole[:, c] @ want[:, c])
            assert np.allclose(whole[:, c], sign * want[:, c], atol=1e-7)
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_given_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in table.collect()], whitening.whitened(table).collect())


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=5).round(2).tolist()) for i in range(40)]
    rows += [(40, None), (41, []), (42, [1.0, None, 2.0, 3.0, 4.0]), (43, [float("nan")] * 5), (44, [float("inf")] * 5),
             (45, [1.0, 2.0]), (None, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (46, [-30.5] * 5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    check(rows, whitening.whitened(df).collect())


def test_one_vector_a_third_of_the_rows_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=20).tolist()) for i in range(400)] + [(400 + i, [0.25] * 20) for i in range(200)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = whitening.whitened(df).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(rows, got)


def test_constant_dimensions_and_single_vectors(spark):
    rows = [(i, [0.5, float(i % 7), 1.0, float(i % 3)]) for i in range(50)]
    check(rows, whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect())
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    assert whitening.whitened(one).count() == 0
    assert whitening.whitened(one.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "twins", "rank", "zero", "orthogonal"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_singular_vectors_against_a_dense_solver(kind, d):
    draw = np.random.default_rng(d)
    q = np.linalg.qr(draw.normal(size=(d, d)))[0]
    p = np.linalg.qr(draw.normal(size=(d, d)))[0]
    values = {
        "random": np.abs(draw.normal(size=d)) + 0.01, "graded": 10.0 ** -np.linspace(0, 10, d), "equal": np.full(d, 3.0),
        "twins": np.repeat(np.arange(1.0, d + 1), 2)[:d], "rank": np.where(np.arange(d) < (d + 1) // 2, 1.0 + np.arange(d), 0.0),
        "zero": np.zeros(d), "orthogonal": np.ones(d),
    }[kind]
    m = (q * values) @ p.T
    r = np.linalg.qr(m, mode="r") if kind != "orthogonal" else np.eye(d)
    got, v = bidiagonal.right_singular(r)
    want = np.sort(np.linalg.svd(r, compute_uv=False))[::-1][: len(got)]
    assert np.allclose(got, want, rtol=1e-10, atol=1e-13)
    assert len(got) >= (values > 1e-9 * max(values.max(), 1e-300)).sum() * (kind != "zero")
    assert np.allclose(v.T @ v, np.eye(len(got)), atol=1e-9)
    assert np.allclose(np.linalg.norm(r @ v, axis=0), got, atol=1e-10 * max(1.0, values.max()))


def test_dqds_has_small_values_to_high_relative_accuracy():
    """A bidiagonal matrix of known determinant with singular values over twenty orders."""
    a, b = 10.0 ** -np.linspace(0, 10, 12), np.full(11, 1e-3)
    a = a.copy()
    got = bidiagonal.dqds(a, b)
    assert np.isclose(np.sum(np.log(got)), np.sum(np.log(a)), rtol=0, atol=1e-10)
