"""Embedding join and whitening against plain versions, on vectors with nulls, zeros, odd lengths, copies and repeated ids."""

import math

import numpy as np
import pytest

from changeimpact.llm import embedding_join, whitening

VECTORS = "vec_id long, embedding array<double>, label int"
D = 24


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    rows = []
    for label in range(2):
        centres = draw.normal(size=(9, D))
        for _ in range(110):
            x = centres[draw.integers(9)] + draw.normal(size=D) * draw.choice([0.05, 0.15, 0.22, 0.27, 0.3])
            rows.append((len(rows), (x * draw.uniform(0.1, 9)).tolist(), label))
        rows += [(len(rows) + k, rows[-1 - 3 * k][1], label) for k in range(10)]  # copies
        own = [[0.0] * D, [math.nan] + [1.0] * (D - 1), [math.inf] + [1.0] * (D - 1), None, [], [2.0, None, 6.0]]
        rows += [(len(rows) + k, v, label) for k, v in enumerate(own)]
        rows += [(len(rows) + k, [1.0 + k, 2.0 + 2 * k, 3.0 + 3 * k], label) for k in range(2)]  # another length
        rows += [(5, centres[0].tolist(), label), (None, centres[0].tolist(), label), (len(rows), centres[1].tolist(), None)]
    return [*rows, rows[7]]


def plain_links(rows, at_least):
    """(vec_id, n_links, component_id) of every row, by comparing all pairs."""
    usable = [
        i for i, (vec_id, v, label) in enumerate(rows)
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    root = {rows[i][0]: rows[i][0] for i in usable}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for n, i in enumerate(usable):
        for j in usable[:n]:
            (a, x, la), (b, y, lb) = rows[i], rows[j]
            if la == lb and len(x) == len(y):
                if np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= at_least:
                    links[i] += 1
                    links[j] += 1
                    low, high = sorted((top(a), top(b)))
                    root[high] = low
    return [(r[0], links[i], top(r[0]) if i in usable else r[0]) for i, r in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("block, tile_bytes", [(16, 2 << 20), (4, 20 * 8 * D), (64, 8 * D)])
def test_links_equal_those_of_all_pairs(spark, vectors, block, tile_bytes):
    frame = spark.createDataFrame([(*v, "x") for v in vectors], VECTORS + ", LINKS string").repartition(3)
    judged = embedding_join.near_duplicates(frame, 0.93, block, tile_bytes)
    expected = ordered(plain_links(vectors, 0.93))
    assert sum(r[1] for r in expected) > 500
    assert ordered(judged.select("vec_id", "n_links", "component_id").collect()) == expected
    assert judged.filter("kept <> coalesce(vec_id = component_id, true)").isEmpty()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_join.near_duplicates(empty, 0.93).collect() == []
    assert whitening.whitened(empty.select("vec_id", "embedding")).collect() == []


def test_rotation_keeps_distances_and_rows_apart():
    x = np.random.default_rng(5).normal(size=(40, 50)) * 1e200
    turned = embedding_join.rotated(x)
    unit = x / 1e200
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert np.allclose(turned @ turned.T, unit @ unit.T, atol=1e-12)
    assert (embedding_join.rotated(x[7:9])[1] == turned[8]).all()


def test_eigenpairs_to_double_precision():
    draw = np.random.default_rng(1)
    for d, wanted in ((64, 32), (200, 8), (10, 32)):
        rows = draw.normal(size=(d * 3, d)) * np.linspace(3, 0.2, d)
        a = rows.T @ rows / len(rows)
        values, vectors = whitening.eigenpairs(lambda p: a @ p, d, wanted)  # noqa: B023
        exact = np.linalg.eigvalsh(a)[::-1][:wanted]
        assert np.abs(values - exact).max() < 1e-13 * exact[0]
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * exact[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_eigenpairs_of_equal_and_zero_values():
    a = np.diag([5.0, 5, 5, 2, 2] + [0.0] * 20)
    values, vectors = whitening.eigenpairs(lambda p: a @ p, 25, 8)
    assert np.allclose(values, [5, 5, 5, 2, 2, 0, 0, 0], atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12)


def test_whitened_equals_a_dense_solution(spark):
    draw = np.random.default_rng(9)
    rows = [(i, (draw.normal(size=12) * np.linspace(2, 0.3, 12)).tolist()) for i in range(300)]
    rows += [rows[4], (None, rows[5][1]), (400, None), (401, []), (402, [math.nan] * 12), (403, [1.0] * 11 + [None]), (404, [1.0, 2.0])]
    kept = [r for r in rows if r[1] and len(r[1]) == 12 and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.floor(64 * np.array([r[1] for r in kept])).astype(np.int64) + 1_000_000
    n = len(x)
    gap = n * x - x.sum(axis=0)
    c = gap / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(8)])
    w = c @ axes / np.sqrt(values)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, N int").repartition(4)
    out = whitening.whitened(frame, 8).collect()
    assert len(out) == 8 * n
    expected = ordered((r[0], k + 1, n, int((gap[i] ** 2).sum())) for i, r in enumerate(kept) for k in range(8))
    assert ordered((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in out) == expected
    by_id = {(r["vec_id"], r["component"]): r for r in out}
    for i, r in enumerate(kept):
        for k in range(8):
            own = by_id[r[0], k + 1]
            assert abs(own["whitened"] - w[i, k]) < 1e-9
            assert abs(own["explained"] - values[k] / (c * c).sum() * n) < 1e-12
            assert own["identity_error"] < 1e-12


def test_whitening_without_variance(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(frame).collect() == []
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whitened(line).collect()} == {1}
