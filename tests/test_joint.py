"""Joint fit of several sigmoids (J5, J6) against Newton's method and against plain sums."""
import hashlib
import math
import re

import numpy as np
import pytest

from contingo.operators import joint

BUCKETS = 16
ROWS = [(1, "alpha beta gamma", 1, 0), (2, "alpha delta", 1, None), (3, "epsilon zeta beta", 0, 1), (4, "", 0, 1),
        (5, None, 1, 1), (6, "Alpha alpha ALPHA!", 1, 0), (7, "zeta eta theta iota", 0, 1), (7, "zeta eta theta iota", 0, 1),
        (8, "gamma kappa", 1, 0), (9, "kappa zeta", None, None), (10, "é ß", 0, 0)]


def frame(spark, rows=ROWS, parts=3):
    return spark.createDataFrame(rows, "id long, text string, a int, b int").repartition(parts)


def vector(text):
    words = set(re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text)))
    own = {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % BUCKETS for w in words}
    x = np.zeros(BUCKETS + 1)
    x[list(own)] = 1 / math.sqrt(len(own)) if own else 0
    x[-1] = 1
    return x


def truth(label):
    rows = [(vector(t), (a, b)[label]) for _, t, a, b in ROWS if t is not None and (a, b)[label] is not None]
    return np.array([x for x, _ in rows]), np.array([y for _, y in rows], dtype=float)


def matrix(model):
    out = np.zeros((2, BUCKETS + 1))
    for r in model.collect():
        out["ab".index(r.label), r.bucket] = r.weight
    return out


def test_steps_equal_plain_gradient_descent(spark):
    got = matrix(joint.fit_joint(frame(spark), "text", ["a", "b"], BUCKETS, steps=3, l2=0.1))
    for label in (0, 1):
        x, y = truth(label)
        w, decay = np.zeros(BUCKETS + 1), np.array([0.1] * BUCKETS + [0])
        for _ in range(3):
            w -= (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + decay * w) / 0.6
        assert np.allclose(got[label], w, atol=1e-8)


def test_fit_reaches_newtons_optimum(spark):
    got = matrix(joint.fit_joint(frame(spark, parts=1), "text", ["a", "b"], BUCKETS, steps=60, l2=0.1))
    for label in (0, 1):
        x, y = truth(label)
        w, decay = np.zeros(BUCKETS + 1), np.array([0.1] * BUCKETS + [0])
        for _ in range(12):
            p = 1 / (1 + np.exp(-x @ w))
            hessian = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(decay)
            w -= np.linalg.lstsq(hessian, x.T @ (p - y) / len(y) + decay * w, rcond=None)[0]
        loss = lambda v: np.mean(np.logaddexp(0, x @ v) - y * (x @ v)) + (decay * v * v).sum() / 2
        assert loss(w) - 1e-12 <= loss(got[label]) <= loss(w) + 1e-3
        assert np.abs(1 / (1 + np.exp(-x @ got[label])) - 1 / (1 + np.exp(-x @ w))).max() < 0.05


def test_model_is_the_same_however_rows_are_dealt(spark):
    models = [sorted(map(tuple, joint.fit_joint(frame(spark, parts=n), "text", ["a", "b"], BUCKETS, 4).collect()))
              for n in (1, 5)]
    assert models[0] == models[1]


def test_saved_model_scores_texts(spark, tmp_path):
    model = joint.fit_joint(frame(spark), "text", ["a", "b"], BUCKETS, 5)
    joint.save_model(model, str(tmp_path / "m"))
    w = matrix(model)
    got = joint.classify_joint(joint.load_model(spark, str(tmp_path / "m")), frame(spark), ["id"], "text", BUCKETS).collect()
    want = []
    for i, text, _, _ in ROWS:
        if text is not None:
            for lab, p in zip("ab", 1 / (1 + np.exp(-w @ vector(text)))):
                if p > 0.5:
                    want.append((i, lab, round(p, 9)))
    assert sorted((r.id, r.label, round(r.score, 9)) for r in got) == sorted(want)


def test_no_rows(spark):
    empty = frame(spark, [])
    model = joint.fit_joint(empty, "text", ["a", "b"], BUCKETS, 2)
    assert sorted(map(tuple, model.collect())) == [("a", -1, 0.0), ("b", -1, 0.0)]
    assert joint.classify_joint(model, empty, ["id"], "text", BUCKETS).count() == 0
    assert joint.classify_joint(model.limit(0), frame(spark), ["id"], "text", BUCKETS).collect() == []


def test_fit_and_scores_are_narrow(spark):
    model = joint.fit_joint(frame(spark, parts=2), "text", ["a"], BUCKETS, 1)
    plan = joint.classify_joint(model, spark.createDataFrame(ROWS, "id long, text string, a int, b int"), ["id"], "text",
                                BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
    with pytest.raises(Exception):
        joint.fit_joint(frame(spark), "text", ["missing"], BUCKETS, 1)
