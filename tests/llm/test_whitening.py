import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clipalign.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def scatter(x):
    centred = x - x.mean(axis=0)
    return centred.T @ centred


def agrees(spectrum, x):
    whole = scatter(x)
    size = max(np.linalg.eigvalsh(whole)[-1], 1e-300)
    assert spectrum.n == len(x) and np.allclose(spectrum.mean, x.mean(axis=0))
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(x.shape[1])).max() < 1e-11
    assert np.abs(spectrum.vectors * spectrum.values @ spectrum.vectors.T - whole).max() < 1e-11 * size


def vectors(n, d, seed=0):
    draw = np.random.default_rng(seed)
    return np.floor(draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) * 100) + 100_000


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
@pytest.mark.parametrize("d", [1, 2, 9, 40])
def test_updates_in_blocks_of_any_size_give_the_spectrum(block, d):
    x = vectors(300, d)
    x[100:200] = x[0]  # one frequent vector
    spectrum = whitening.Spectrum(0, np.zeros(d))
    for at in range(0, len(x), block):
        spectrum.add(x[at:at + block])
    agrees(spectrum, x)


def test_few_directions_equal_eigenvalues_and_no_variance():
    for x in (np.repeat(vectors(1, 7), 20, axis=0), vectors(3, 12), np.concatenate([np.eye(6) * 50, np.eye(6) * -50]),
              np.tile(vectors(200, 1), (1, 5)), np.pad(vectors(50, 2), ((0, 0), (0, 6)))):
        spectrum = whitening.Spectrum(0, np.zeros(x.shape[1]))
        for row in x:
            spectrum.add(row[None, :])
        agrees(spectrum, x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 9), st.integers(1, 10 ** 6)), min_size=1, max_size=12, unique_by=lambda p: p[0]))
def test_secular_roots(parts):
    d, z = (np.array(v, float) for v in zip(*sorted(parts)))
    pole, away = whitening._secular_roots(d, z * z)
    expected = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.allclose(d[pole] + away, expected, rtol=1e-12, atol=1e-12 * expected[-1])
    assert (d[pole] + away >= d).all()


def test_combined_spectra(spark):
    x = vectors(400, 6)
    rows = spark.createDataFrame([([int(v) for v in r],) for r in x], "x array<bigint>").repartition(37)
    found = whitening.combined(whitening.spectra(rows, "x")).collect()
    assert len(found) == 1 and found[0].sums == x.sum(axis=0).astype(int).tolist()
    agrees(whitening.Spectrum(found[0].n, np.array(found[0].mean), np.array(found[0]["values"]), np.array(found[0].vectors).reshape(6, 6)), x)


def slow(rows, k):
    """vec_id -> what a dense eigendecomposition gives, of the rows that stay."""
    fine = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in fine], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (x - np.array([t / n for t in s])).astype(float)
    v = centred.T @ centred / n
    values, components = np.linalg.eigh(v)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    return [(i, n, sum((n * c - t) ** 2 for c, t in zip(row, s)), w, values / np.trace(v))
            for (i, row), w in zip(fine, centred @ components / np.sqrt(values))]


def compare(found, expected):
    found, expected = sorted(found, key=lambda r: (r[0], r[2])), sorted(expected, key=lambda r: (r[0], r[2]))
    assert [tuple(r[:3]) for r in found] == [tuple(e[:3]) for e in expected]
    a, b = (np.array([r[3] for r in rows]) for rows in (found, expected))
    signs = np.sign((a * b).sum(axis=0))
    assert np.abs(a * signs - b).max() < 1e-9
    assert np.allclose([r[4] for r in found], [e[4] for e in expected], rtol=1e-10)


def test_whitened_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=12) * np.arange(1, 13) / 20).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (500, None), (501, []), (502, [None] * 12), (503, [float("nan")] * 12), (504, [float("inf")] * 12), (505, [0.5] * 3),
             *[(600 + i, [0.25] * 12) for i in range(60)]]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("own")).withColumn("n", F.lit(-1))
    found = whitening.whiten(table, "embedding", 5)
    assert found.columns == ["vec_id", "embedding", "x", "n", "whitening"]
    found = found.collect()
    assert all(r.x == "own" and r.n == -1 for r in found)
    compare([(r.vec_id, r.whitening.n, r.whitening.deviation, r.whitening.whitened, r.whitening.explained) for r in found],
            slow([r for r in rows if r[0] != 505], 5))
    assert all(r.whitening.identity_error < 1e-10 for r in found)


def test_small_and_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA), "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA), "embedding").count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], SCHEMA), "embedding").first().whitening
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [0.0, 0.0], [0.0, 0.0], 1.0)
    line = whitening.whiten(spark.createDataFrame([(i, [i / 4, i / 2]) for i in range(4)], SCHEMA), "embedding", 1).collect()
    assert all(abs(r.whitening.explained[0] - 1) < 1e-12 for r in line)
    assert abs(sum(r.whitening.whitened[0] ** 2 for r in line) / 4 - 1) < 1e-12


def test_deviations_beyond_64_bits_are_refused(spark):
    far = spark.createDataFrame([(i, [3e15 * (-1) ** i]) for i in range(8)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(far, "embedding").collect()


def test_query_equals_a_dense_decomposition(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = {}
    for r in queries.op12_whitening(spark, sf_dir).collect():
        assert r.identity_error < 1e-4
        found.setdefault((r.vec_id, r.n, r.deviation), {})[r.component] = (r.whitened, r.explained)
    assert all(sorted(c) == list(range(1, 9)) for c in found.values())
    compare([(*k, [c[i][0] for i in range(1, 9)], [c[i][1] for i in range(1, 9)]) for k, c in found.items()],
            slow([(r.vec_id, r.embedding) for r in rows], 8))
