import math

import numpy as np
import pytest

from papyrion.llm import whitening


def plain(vectors, components=4):
    """n, sums, components and eigenvalues from products of exact integers."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    y = [[n * c - t for c, t in zip(v, s)] for v in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    return n, s, values[::-1][:components], axes[:, ::-1][:, :components], float(np.trace(cov))


def check(rows, kept):
    """``kept``: (id, vector) of the rows that remain, each as often as it comes."""
    n, s, values, axes, trace = plain([v for _, v in kept], max(r.component for r in rows))
    want = []
    for key, v in kept:
        x = [math.floor(256 * c) for c in v]
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for k in range(len(values)):
            white = sum(float(a - b / n) * w for a, b, w in zip(x, s, axes[:, k])) / math.sqrt(values[k])
            want.append((key, k + 1, n, deviation, abs(white), values[k] / trace))
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in rows), key=repr)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-8, abs=1e-8)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_query_against_plain_products(spark):
    d = "/root/testdata/sf0.001"
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    check(whitening.op13_embedding_whitening(spark, d).collect(), kept)


@pytest.mark.parametrize("scale", [1, 1e7, 1e13])
def test_odd_rows_and_large_entries(spark, scale):
    random = np.random.default_rng(5)
    vectors = [(int(i), (random.normal(size=3) * [5, 3, 1] * scale).tolist()) for i in range(60)]
    kept = vectors + [vectors[0]] * 30 + [(None, vectors[1][1])]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, math.nan, 2.0]), (93, [math.inf, 1.0, 2.0]), (94, []), (95, [1.0]), (96, [1e300, 0.0, 0.0])]
    rows = spark.createDataFrame([(k, v, "x", 1) for k, v in kept + odd], "vec_id long, embedding array<double>, component string, n int").repartition(5)
    found = whitening.whiten(rows)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), kept)


def test_blocks_of_rows_give_the_same_sums(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), i / 3, (i * i) % 11 / 5]) for i in range(50)], "vec_id long, embedding array<double>")
    distinct, dims = whitening.fit_list(rows)
    once = whitening.fit(distinct, dims)
    monkeypatch.setattr(whitening, "ROWS", 3)
    assert (whitening.fit(distinct.repartition(4), dims).covariance == once.covariance).all()
    wide = lambda f: np.array([[f(i, j) for j in range(3)] for i in range(3)])
    x = np.floor(256 * np.array([r.embedding for r in rows.collect()]))
    x = np.unique(x, axis=0)
    assert once.covariance == pytest.approx(wide(lambda i, j: np.mean((x[:, i] - x[:, i].mean()) * (x[:, j] - x[:, j].mean()))), rel=1e-12)


def test_too_few_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(one.selectExpr("vec_id", "cast(null as array<float>) embedding")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id string, embedding array<float>")
    assert sorted((r.vec_id, r.component) for r in whitening.whiten(line).collect()) == [(str(i), 1) for i in range(4)]
