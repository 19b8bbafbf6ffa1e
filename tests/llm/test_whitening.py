from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from contingo.llm import whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("n", T.StringType()), T.StructField("component", T.IntegerType())])


@pytest.fixture(scope="module")
def make(spark):
    def frame(vectors, ids=None):
        ids = range(len(vectors)) if ids is None else ids
        rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 7) for i, v in zip(ids, vectors)]
        return spark.createDataFrame(rows, VECTORS).repartition(3)
    return frame


def brute(vectors):
    """(x, S, eigenvalues, eigenvectors, trace) from the exact covariance."""
    x = np.floor(np.array(vectors, dtype=np.float32).astype(np.float64) * 64).astype(np.int64) + 1000000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    d = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n ** 3)) for j in range(len(sums))] for i in range(len(sums))])
    e, v = np.linalg.eigh(cov)
    return x, sums, e[::-1], v[:, ::-1], float(np.trace(cov)), d


def compare(rows, vectors, expect=32, digits=1e-7):
    x, sums, e, v, trace, d = brute(vectors)
    n = len(x)
    got = {}
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n
    for i, by in got.items():
        assert sorted(by) == list(range(1, expect + 1))
        assert all(r.deviation == sum(c * c for c in d[i]) for r in by.values())
    for k in range(expect):
        want = (x - np.array(sums) / n) @ v[:, k] / np.sqrt(e[k])
        have = np.array([got[i][k + 1].whitened for i in range(n)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < digits
        assert abs(got[0][k + 1].explained - e[k] / trace) <= 1e-9 * e[k] / trace


def test_equals_brute_force(make):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(300, 40)) * np.linspace(1, 9, 40) + 3
    compare(whitening.whiten(make(vectors)).collect(), vectors)


def test_far_from_orthogonal(make):
    """A spread of 10^6 between directions: without shift and repeated passes the Gram matrix isn't definite."""
    r = np.random.default_rng(2)
    base = np.floor(r.normal(size=(400, 6)) * 3e5) / 64 * [1e3, 100, 10, 1, 1e-2, 1e-4]
    vectors = (base @ np.triu(np.ones((6, 6)))).astype(np.float32)
    found = whitening.fit(make(vectors).select("embedding"))
    _, _, e, v, _, _ = brute(vectors)
    live = len(found.eigenvalues)
    assert live >= 5 and found.identity_error < 1e-9
    assert np.allclose(found.eigenvalues[:4], e[:4], rtol=1e-9)
    assert np.allclose(np.abs(found.components[:, 0] @ v[:, 0]), 1, atol=1e-12)


def test_shift_is_needed_and_passes_repair_it():
    g = np.outer([1, 1, 1], [1.0, 1, 1]) + 1e-17 * np.eye(3)
    r = whitening.next_factor(g)
    assert np.allclose(r, np.triu(r)) and np.isfinite(r).all() and r[2, 2] > 0


def test_dependent_and_constant_dimensions_are_no_components(make):
    r = np.random.default_rng(3)
    a = r.normal(size=(200, 3)) * 5
    vectors = np.column_stack([a, a[:, 0], np.full(200, 2.0)])
    rows = whitening.whiten(make(vectors)).collect()
    assert {x.component for x in rows} == {1, 2, 3}
    assert max(x.identity_error for x in rows) < 1e-9
    whitened = np.zeros((200, 3))
    for x in rows:
        whitened[x.vec_id, x.component - 1] = x.whitened
    assert np.allclose(whitened.T @ whitened / 200, np.eye(3), atol=1e-9)


def test_edge_rows(make):
    r = np.random.default_rng(4)
    good = (r.normal(size=(60, 4)) * 8).tolist()
    vectors = [None, [], [1.0, None, 2, 3], [float("nan"), 1, 2, 3], [float("inf"), 1, 2, 3], [1.0, 2], *good, good[0]]
    ids = [1, 2, 3, 4, 5, 6, *range(100, 159), None, 100]
    rows = whitening.whiten(make(vectors, ids)).collect()
    assert len(rows) == 61 * 4 and {x.n for x in rows} == {61}
    assert {x.vec_id for x in rows} == {*range(100, 159), None}
    assert sum(x.vec_id == 100 for x in rows) == 8                         # repeated rows stay


def test_nothing_to_whiten(make):
    for vectors in ([], [None, []], [[1.0, 2.0]] * 5, [[3.0]]):
        assert whitening.whiten(make(vectors)).collect() == []


def test_huge_entries_are_bounded(make):
    rows = whitening.whiten(make([[1e30, 1], [-1e30, 2], [5, 3], [6, 9]])).collect()
    assert {x.vec_id: x.deviation for x in rows} == {0: None, 1: None, 2: 368640, 3: 2498560}
    assert {x.n for x in rows} == {4}
    assert all(np.isfinite(x.whitened) for x in rows)


def test_exact_sums_and_deviation():
    x = np.array([[1000003, 999990], [1000010, 1000001], [999999, 1000000]])
    sums = tuple(int(s) for s in x.sum(axis=0))
    _, exact = whitening.centred(x, 3, sums)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(exact, 3, sums) == want


def test_one_common_vector(make):
    r = np.random.default_rng(5)
    vectors = np.concatenate([r.normal(size=(90, 5)) * 4, np.tile([1.0, 2, 3, 4, 5], (60, 1))])
    compare(whitening.whiten(make(vectors)).collect(), vectors, expect=5)
