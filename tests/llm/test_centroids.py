import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from contingo.llm import centroids

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("cluster", T.StringType()), T.StructField("block", T.IntegerType())])


@pytest.fixture(scope="module")
def make(spark):
    def frame(vectors, ids=None):
        ids = range(len(vectors)) if ids is None else ids
        rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 7) for i, v in zip(ids, vectors)]
        return spark.createDataFrame(rows, VECTORS).repartition(3)
    return frame


def brute(vectors, ids, k=8, rounds=10, scale=1024.0):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(np.float64) * scale).astype(np.int64)
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), n) for n, i in enumerate(ids) if i is not None)[:k]
    c = [x[n].tolist() for _, n in seeds]

    def nearest():
        d = np.array([[sum((a - b) ** 2 for a, b in zip(row, y)) for y in c] for row in x.tolist()])
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        a, _ = nearest()
        for j in range(len(c)):
            own = x[a == j]
            if len(own):
                c[j] = [int(s) // len(own) for s in own.sum(axis=0)]
    return (*nearest(), c)


def same(found, vectors, ids, **kw):
    a, d, c = brute(vectors, ids, **kw)
    assert found.centroids == c
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in found.rows.collect())
    assert got == sorted((i if i is not None else -1, int(j), int(e)) for i, j, e in zip(ids, a, d))


def test_equals_plain_rounds(make, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 64)
    r = np.random.default_rng(1)
    vectors = np.concatenate([r.normal(loc=m, size=(120, 6)) for m in (0, 1, 2, 5)])
    ids = list(range(len(vectors)))
    found = centroids.cluster(make(vectors), size=6, k=5)
    same(found, vectors, ids, k=5)
    full = centroids.cluster(make(vectors), size=6, k=5, tighten=False)
    assert full.centroids == found.centroids
    assert found.scanned[0] == len(vectors) and sum(found.scanned) < 0.6 * 10 * len(vectors)
    assert sum(found.scanned) <= sum(full.scanned)                         # tighter bounds, fewer scans


def test_ties_and_one_common_vector(make):
    grid = [[i % 3, i // 3 % 3] for i in range(90)] + [[1, 1]] * 60
    ids = list(range(len(grid)))
    same(centroids.cluster(make(grid), size=2, k=4, scale=1.0), grid, ids, k=4, scale=1.0)


def test_edge_rows(make):
    r = np.random.default_rng(2)
    good = r.normal(size=(30, 3)).tolist()
    vectors = [None, [], [1.0, None, 2], [float("nan"), 1, 2], [float("inf"), 1, 2], [1.0, 2], [1.0, 2, 3, 4], *good, good[0]]
    ids = [1, 2, 3, 4, 5, 6, 7, *range(100, 129), None, 100]
    found = centroids.cluster(make(vectors, ids), size=3, k=4)
    same(found, good + good[:1], [*range(100, 129), None, 100], k=4)


def test_few_or_no_rows(make):
    assert centroids.cluster(make([]), size=2) is None
    assert centroids.cluster(make([None, [1.0]]), size=2) is None
    assert centroids.cluster(make([[1.0, 2.0]], [None]), size=2) is None
    found = centroids.cluster(make([[1.0, 2], [5, 5]]), size=2)
    assert len(found.centroids) == 2 and sorted(r.distance for r in found.rows.collect()) == [0, 0]


def test_huge_entries_are_bounded(make):
    found = centroids.cluster(make([[1e30, 0], [-1e30, 0], [3, 3], [4, 4]]), size=2, k=2)
    assert found.rows.count() == 4 and max(r.distance for r in found.rows.collect()) < 1 << 63
    assert centroids.entry_bound(64) == 1 << 27


def test_exact_distances_of_large_integers():
    r = np.random.default_rng(3)
    for largest in (100, 1 << 20, 1 << 27):
        x, c = r.integers(-largest, largest, (20, 64)), r.integers(-largest, largest, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert centroids.squared_distances(x, c).tolist() == want


def test_gain_bounds_hold_in_the_sphere_and_are_below_the_drift():
    r = np.random.default_rng(4)
    tighter = 0
    for _ in range(300):
        size = int(r.integers(2, 6))
        centre, old, new = r.normal(size=(3, size)) * r.choice([1, 5, 30])
        radius = float(r.uniform(0, 4))
        bound = centroids.gains(centre[None], np.array([radius]), old[None], new[None])[0, 0]
        drift = np.linalg.norm(new - old)
        points = r.normal(size=(400, size))
        points *= (radius * r.uniform(0.9, 1, 400) / np.linalg.norm(points, axis=1))[:, None]
        points = np.concatenate([points, [radius * (new - old) / drift]]) + centre
        gain = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        assert gain.max() <= bound + 1e-9 and 0 <= bound <= drift * (1 + 1e-12)
        tighter += bound < 0.8 * drift
    assert tighter > 100


def test_rounds_join_without_an_exchange(make, spark):
    r = np.random.default_rng(5)
    tables = centroids._Tables(spark, 4)
    blocks = centroids.pack(make(r.normal(size=(50, 2))).selectExpr("vec_id AS id", "embedding AS vector"), 2, 1024.0)
    vectors = tables.write(blocks, "vectors")
    move = centroids.Move(np.array([[0, 0], [500, 500]]))
    state = tables.write(centroids._assigned(vectors, None, move, 2), "state")
    after = centroids.Move.between(move.centroids, move.centroids + 5, np.array([9e9, 9e9]))
    plan = centroids._assigned(vectors, state, after, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    tables.forget()


def test_inertia_and_digests(make):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(80, 64)).tolist()
    found = centroids.cluster(make(vectors))
    a, d, c = brute(vectors, range(80))
    for row in centroids.with_inertia(found).collect():
        assert row.cluster == a[row.vec_id] and row.distance == d[row.vec_id]
        assert row.cluster_inertia == d[a == row.cluster].sum() and row.inertia == d.sum()
        assert row.centroid_sha256 == hashlib.sha256(",".join(map(str, c[row.cluster])).encode()).hexdigest()
