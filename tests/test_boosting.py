from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import boosting as B


def plain_tree(codes, grad, hess, depth, rate, l2, least):
    """A tree by loops over rows; returns a function from bins to values."""

    def grow(rows, level):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-12, None)
        if level < depth:
            for f in range(codes.shape[1]):
                own = codes[rows, f]
                for cut in range(1, codes[:, f].max() + 1):
                    for missing_left in (False, True):
                        left = (own > 0) & (own <= cut) | (own == 0) & missing_left
                        if min(left.sum(), (~left).sum()) < least:
                            continue
                        gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
                        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                        if gain > best[0] + 1e-9:
                            best = gain, (f, cut, missing_left, left)
        if best[1] is None:
            return -rate * g / (h + l2)
        f, cut, missing_left, left = best[1]
        if not (codes[rows, f] == 0).any():
            missing_left = left.sum() >= (~left).sum()
        return f, cut, missing_left, grow(rows[left], level + 1), grow(rows[~left], level + 1)

    def value(node, row):
        while isinstance(node, tuple):
            f, cut, missing_left, a, b = node
            node = a if (row[f] <= cut if row[f] else missing_left) else b
        return node

    tree = grow(np.arange(len(codes)), 0)
    return lambda c: np.array([value(tree, row) for row in c])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    x[rng.random(600) < 0.3, 1] = np.nan
    x[rng.random(600) < 0.1, 0] = np.nan
    y = np.where(np.isnan(x[:, 1]), 2.0, np.sin(2 * np.nan_to_num(x[:, 1]))) + np.nan_to_num(x[:, 0]) + 0.2 * rng.normal(size=600)
    rows = [(k, *(None if np.isnan(v) and k % 2 else float(v) for v in x[k]), float(y[k]), float(y[k] > 1)) for k in range(600)]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, won double").repartition(3)


@pytest.mark.parametrize("logistic", [False, True])
def test_equals_plain_loops(table, logistic):
    x, y, df = table
    y = (y > 1).astype(float) if logistic else y
    options = {"trees": 10, "depth": 3, "rate": 0.3, "l2": 1.0, "least": 15, "bins": 12}
    model = B.fit(df, ["a", "b", "c"], "won" if logistic else "y", logistic=logistic, **options)
    codes = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(model.edges[k], x[:, k], "left")) for k in range(3)], 1)
    raw = np.full(600, np.log(y.mean() / (1 - y.mean())) if logistic else y.mean())
    for _ in range(10):
        p = 1 / (1 + np.exp(-raw)) if logistic else raw
        raw = raw + plain_tree(codes, p - y, p * (1 - p) if logistic else np.ones(600), 3, 0.3, 1.0, 15)(codes)
    want = 1 / (1 + np.exp(-raw)) if logistic else raw
    got = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
    assert len(model.trees) == 10 and [got[k] for k in range(600)] == pytest.approx(want.tolist(), abs=1e-6)
    assert model.losses == sorted(model.losses, reverse=True)


@pytest.mark.parametrize("high", ["missing", "small", "large"])
def test_missing_goes_to_the_side_that_it_is_like(spark, high):
    rows = [(float(k % 50) if k % 3 else None, 0.0) for k in range(600)]
    like = {"missing": lambda x: x is None, "small": lambda x: x is None or x < 20, "large": lambda x: x is None or x >= 30}[high]
    df = spark.createDataFrame([(x, 10.0 if like(x) else 0.0) for x, _ in rows], "x double, y double")
    model = B.fit(df, ["x"], "y", trees=1, depth=1, rate=1.0, l2=0.0, least=1, bins=50)
    tree = model.trees[0]
    assert tree.missing_left[0] == (high == "small")
    assert all(r["prediction"] == pytest.approx(r["y"], abs=1e-9) for r in model.predict(df).collect())


def test_stops_when_held_rows_no_longer_gain(table):
    _, _, df = table
    noise = df.withColumns({"held": F.col("id") % 3 == 0, "y": F.rand(3)})
    model = B.fit(noise, ["a", "b", "c"], "y", trees=40, depth=3, rate=0.5, least=5, held="held", patience=3)
    assert len(model.trees) < 10 and len(model.losses) < 15
    assert B.fit(df.where("false"), ["a"], "y").trees == []
