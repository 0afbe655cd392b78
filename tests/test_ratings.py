from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ratings as R
from tallyspark.operators.sparse import by_gradients

DAY = dt.date(2024, 1, 1)
SCHEMA = "game_id long, day date, home_lineup array<long>, away_lineup array<long>, home_pts double, away_pts double, home_poss int, away_poss int"


@pytest.fixture(scope="module")
def stints():
    rng = np.random.default_rng(4)
    worth = rng.normal(0, 3, 30)
    rows = []
    for game in range(60):
        for _ in range(8):
            people = rng.choice(30, 10, replace=False)
            h, a = sorted(map(int, people[:5])), sorted(map(int, people[5:]))
            poss = [int(rng.integers(0, 12)), int(rng.integers(1, 12))]
            pts = [float(max(0.0, n * (1.1 + (worth[own].sum() - worth[other].sum()) / 100) + rng.normal(0, 1))) for n, own, other in zip(poss, (h, a), (a, h), strict=True)]
            rows.append((game, DAY + dt.timedelta(days=game), h, a, *pts, *poss))
    return rows + rows[:3]


def plain(rows, weight, ridge, prior=None, people=None):
    """Coefficients, columns and design of a weighted ridge regression, in numpy."""
    data = [(own, other, pts, poss, home, weight(r)) for r in rows for own, other, pts, poss, home in ((r[2], r[3], r[4], r[6], 1.0), (r[3], r[2], r[5], r[7], 0.0)) if poss > 0]
    people = people or sorted({p for d in data for p in (*d[0], *d[1])})
    x, y, w = np.zeros((len(data), 2 + 2 * len(people))), np.zeros(len(data)), np.zeros(len(data))
    for k, (own, other, pts, poss, home, more) in enumerate(data):
        x[k, :2] = 1, home
        for p in own:
            x[k, 2 + people.index(p)] = 1
        for p in other:
            x[k, 2 + len(people) + people.index(p)] = -1
        y[k], w[k] = 100 * pts / poss, more * poss
    start = np.zeros(x.shape[1])
    if prior:
        start[2:] = [*(prior[p][0] for p in people), *(prior[p][1] for p in people)]
    penalty = np.diag([0.0, 0.0] + [ridge] * (2 * len(people)))
    return np.linalg.solve(x.T @ (w[:, None] * x) + penalty, x.T @ (w * y) + penalty @ start), people, x, y, w


@pytest.mark.parametrize("small", [2000, 0])
def test_ridges_by_folds_equal_refits(spark, stints, small):
    df = spark.createDataFrame(stints, SCHEMA).repartition(3)
    ridges = [50.0, 4000.0] if small else [4000.0]
    fold = {r[0]: r[1] for r in df.select("game_id", F.pmod(F.xxhash64(F.col("game_id").cast("string")), F.lit(3))).distinct().collect()}
    got = {r["ridge"]: r["weighted_mse"] for r in R.ridge_by_folds(df, "game_id", ridges, 3, small).collect()}
    people = sorted({p for r in stints for p in (*r[2], *r[3])})
    for ridge in ridges:
        sse = total = 0.0
        for f in range(3):
            beta, *_ = plain([r for r in stints if fold[r[0]] != f], lambda r: 1.0, ridge, people=people)
            _, _, x, y, w = plain([r for r in stints if fold[r[0]] == f], lambda r: 1.0, ridge, people=people)
            sse += float(w @ (y - x @ beta) ** 2)
            total += w.sum()
        assert got[ridge] == pytest.approx(sse / total, rel=1e-6)


@pytest.mark.parametrize(("half_life", "window"), [(None, None), (20.0, 28)])
def test_weekly_ratings_equal_refits(spark, stints, half_life, window):
    df = spark.createDataFrame(stints, SCHEMA).repartition(3)
    first = DAY + dt.timedelta(days=14)
    levels = [(p, DAY + dt.timedelta(days=d), float(p % 7 + d / 10), 10.0 + p) for p in range(30) for d in range(p % 5, 60, 9)]
    cells = R.asof_cells(df, "day", str(first), half_life, window)
    cuts = cells.select("asof").distinct()
    prior = R.level_prior(spark.createDataFrame(levels, "person_id long, game_date date, level double, minutes double"), cuts, 0.8, 0.5, 30)
    known = {(r["asof"], r["person_id"]): (r["offence"], r["defence"]) for r in prior.collect()}
    got = {}
    for r in R.asof_ratings(cells, 300.0, prior, least=20).collect():
        got.setdefault(r["asof"], {})[r["person_id"]] = r
    weeks = [first + dt.timedelta(days=7 * k) for k in range(8)]
    for week in weeks:
        old = [r for r in stints if r[1] < week and (window is None or r[1] >= week - dt.timedelta(days=window))]
        last = {}
        for p, day, level, minutes in sorted(levels, key=lambda x: x[1]):
            if week - dt.timedelta(days=30) <= day < week:
                last[p] = level, minutes
        mean = sum(x * m for x, m in last.values()) / sum(m for _, m in last.values())
        start = {p: (0.4 * (last[p][0] - mean), 0.4 * (last[p][0] - mean)) if p in last else (0.0, 0.0) for p in range(30)}
        for p in last:
            assert known[week, p] == pytest.approx(start[p])
        beta, people, *_ = plain(old, lambda r, week=week: 0.5 ** ((week - r[1]).days / half_life) if half_life else 1.0, 300.0, {p: (o, d) for p, (o, d) in start.items()})
        assert sorted(got[week]) == people and got[week][people[0]]["n_rows"] == sum((r[6] > 0) + (r[7] > 0) for r in old)
        for k, p in enumerate(people):
            row = got[week][p]
            assert (row["offence"], row["defence"]) == pytest.approx((beta[2 + k], beta[2 + len(people) + k]), abs=1e-6)
            assert (row["intercept"], row["home"]) == pytest.approx((beta[0], beta[1]), abs=1e-6)
    assert set(got) == set(weeks)
    with pytest.raises(ValueError):
        R.asof_cells(df, "day", str(first), None, 10)


def test_a_later_stint_changes_no_earlier_rating(spark, stints):
    df = spark.createDataFrame(stints, SCHEMA)
    first = str(DAY + dt.timedelta(days=14))
    early = lambda rows: {(r["asof"], r["person_id"]): r["offence"] for r in R.asof_ratings(R.asof_cells(rows, "day", first), 300.0).where("asof <= date'2024-02-05'").collect()}
    later = df.withColumn("home_pts", F.when(F.col("day") >= "2024-02-05", 99.0).otherwise(F.col("home_pts")))
    a, b = early(df), early(later)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_prior_scale_is_the_pooled_slope(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=200)
    ratings = [(DAY, k, float(0.7 * x[k]), float(0.9 * x[k] + 0.1), 3000.0 if k % 4 else 10.0) for k in range(200)]
    levels = [(DAY, k, float(x[k])) for k in range(200)]
    r = spark.createDataFrame(ratings, "asof date, person_id long, offence double, defence double, off_poss double")
    assert R.prior_scale(r, spark.createDataFrame(levels, "asof date, person_id long, level double")) == pytest.approx(1.6)
    assert R.prior_scale(r, spark.createDataFrame([], "asof date, person_id long, level double")) is None


def test_gradients_that_do_not_arrive_raise(spark):
    gram = spark.createDataFrame([(0, i, j, 1.0 / (i + j + 1)) for i in range(12) for j in range(12)], "system int, i int, j int, g double")
    right = spark.createDataFrame([(0, i, 1.0 + i % 3, 0.0) for i in range(12)], "system int, i int, b double, penalty double")
    with pytest.raises(ArithmeticError):
        by_gradients(gram, right, "system", steps=2)
