from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest

from tallyspark.operators.normality import normality, ranked


def plain(values):
    """W and the Anderson-Darling statistic from sorted values, weight by weight."""
    x, n = np.sort(np.array(values, float)), len(values)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, a = 1 / math.sqrt(n), m / math.sqrt(m @ m)
    last = a[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    next_ = a[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    if n > 5:
        a = m / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2))
        a[-2], a[1] = next_, -next_
    else:
        a = m / math.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    z = (x - x.mean()) / x.std(ddof=1)
    below, above = (np.array([math.log(0.5 * math.erfc(s * t / math.sqrt(2))) for t in z]) for s in (-1, 1))
    i = np.arange(1, n + 1)
    return w, -n - ((2 * i - 1) * (below + above[::-1])).sum() / n


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(6)
    return {"tied": np.round(rng.normal(0, 3, 900)), "skewed": rng.exponential(1, 300), "few": rng.normal(0, 1, 9), "five": np.array([1.0, 2, 2, 4, 9]), "hot": np.append(np.zeros(500), rng.normal(0, 1, 700)), None: rng.normal(5, 1, 40)}


def test_equals_numpy(spark, groups):
    rows = [(k, float(x), "more") for k, v in groups.items() for x in v] + [("tied", None, ""), ("tied", float("nan"), "")]
    got = {r["g"]: r for r in normality(spark.createDataFrame(rows, "g string, x double, n string").repartition(5), ["g"], "x").collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        w, a = plain(v)
        assert (got[k]["n"], got[k]["mean"], got[k]["sd"]) == (len(v), pytest.approx(v.mean()), pytest.approx(v.std(ddof=1)))
        assert got[k]["shapiro_w"] == pytest.approx(w, rel=1e-9) and 0 <= got[k]["shapiro_p"] <= 1
        assert got[k]["anderson"] == (pytest.approx(a, rel=1e-9, abs=1e-9) if len(v) >= 8 else None)
    assert got["skewed"]["shapiro_p"] < 1e-6 < got["few"]["shapiro_p"] and got["skewed"]["anderson"] > got["skewed"]["anderson_5"] > got[None]["anderson"]


def test_known_values(spark):
    """Weights of eleven men, the usual worked example: W = 0.79 and p = 0.007."""
    rows = [(float(x),) for x in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)]
    row = normality(spark.createDataFrame(rows, "x double"), [], "x").first()
    assert (round(row["shapiro_w"], 2), round(row["shapiro_p"], 3)) == (0.79, 0.007)


def test_few_or_equal_values_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 4.0), ("b", 4.0), *[("c", 1.0)] * 9], "g string, x double")
    got = {r["g"]: r for r in normality(df, ["g"], "x").collect()}
    assert all(got[k]["shapiro_w"] is None and got[k]["anderson"] is None for k in "abc") and got["a"]["n"] == 2
    assert normality(df.where("false"), ["g"], "x").collect() == []


def test_a_million_values_in_many_tasks(spark):
    """One group: its different values lie in many parts, and its ranks are those of a sort."""
    df = spark.range(0, 1_000_000, 1, 16).selectExpr("1 as g", "if(id % 3 = 0, 7.0D, (id * 7919 % 1000003) / 1000.0D) as x")
    rows = ranked(df, ["g"], "x")
    assert rows.select("part").distinct().count() >= 4
    ids = np.arange(1_000_000)
    x = np.where(ids % 3 == 0, 7.0, (ids * 7919 % 1000003) / 1000.0)
    value, count = np.unique(x, return_counts=True)
    got = rows.orderBy("x").toPandas()
    assert np.array_equal(got.x, value) and np.array_equal(got.m, count) and np.array_equal(got.before, np.cumsum(count) - count)
    row = normality(df, ["g"], "x").first()
    w, a = plain(x)
    assert row["shapiro_w"] == pytest.approx(w, rel=1e-8) and row["anderson"] == pytest.approx(a, rel=1e-8)
