"""Ladders, judgements and partial correlations against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ladder as D
from tallyspark.operators import linear as L

NAMES = ["a", "b", "form_home", "form_away", "form_home_var", "form_away_var", "base_home", "base_away", "margin"]


def seasons(n=400, seed=3):
    """(season, values): a margin made of two features and of form; some values are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, fh, fa = rng.normal(size=4)
        vh, va = rng.uniform(1, 3, 2)
        row = [a, b, fh, fa, vh, va, 0.3, -0.2, 3 * a - b + 0.5 * (fh - fa) + rng.normal()]
        if i % 17 == 0:
            row[1] = None
        rows.append((f"s{i % 5}", *map(lambda x: None if x is None else float(x), row)))
    return rows


def test_ladder_is_a_fit_on_all_earlier_seasons(spark):
    rows = seasons()
    df = spark.createDataFrame(rows, "season string, " + ", ".join(f"{c} double" for c in NAMES))
    models = {"one": ["a"], "two": ["a", "b"], "three": ["a", "b", "shrunk_form"]}
    got = D.ladder(df, "season", models, "margin", burn_in=2, least_train=50, least_test=20, window=15).collect()
    assert {r["season"] for r in got} == {"s2", "s3", "s4"} and all(r["b"] is not None for r in got)
    at = {c: i + 1 for i, c in enumerate(NAMES)}
    for season in ("s2", "s4"):
        past = [r for r in rows if r[0] < season]
        means, noise = np.array([r[at["form_home"]] for r in past]), np.mean([r[at["form_home_var"]] for r in past])
        games = np.clip(noise / means.var(), 1, 15)
        signal = max(means.var() - noise / games, 1e-6)
        reliable = lambda v: signal / (signal + v / games)  # noqa: E731,B023
        form = lambda r: reliable(r[at["form_home_var"]]) * (r[at["form_home"]] - 0.3) - reliable(r[at["form_away_var"]]) * (r[at["form_away"]] + 0.2)  # noqa: E731,B023
        whole = [r for r in past if r[at["b"]] is not None]
        x = {"one": lambda r: [1, r[1]], "two": lambda r: [1, r[1], r[2]], "three": lambda r: [1, r[1], r[2], form(r)]}  # noqa: B023
        for m, make in x.items():
            beta = np.linalg.lstsq(np.array([make(r) for r in whole]), np.array([r[at["margin"]] for r in whole]), rcond=None)[0]
            want = sorted(float(np.dot(make(r), beta)) for r in rows if r[0] == season and r[at["b"]] is not None)
            assert np.allclose(sorted(r[f"pred_{m}"] for r in got if r["season"] == season), want, atol=1e-7)
    assert D.ladder(df.where("season < 's2'"), "season", models, "margin", burn_in=2).count() == 0


def test_judged_and_long_form(spark):
    df = spark.createDataFrame([("s", 4.0, 3.0, 2.0), ("s", -2.0, 1.0, 2.0)], "season string, margin double, pred_m double, sd_m double")
    r = D.judged(D.long_form(df, ["m"], ["season", "margin"]), "margin", ["model"]).first()
    p = [0.5 * (1 + math.erf(z / math.sqrt(2))) for z in (1.5, 0.5)]
    assert (r["n"], r["mae"], r["accuracy"]) == (2, 2.0, 0.5)
    assert r["log_loss"] == pytest.approx(-(math.log(p[0]) + math.log(1 - p[1])) / 2, abs=1e-5)
    assert r["brier"] == pytest.approx(((p[0] - 1) ** 2 + p[1] ** 2) / 2, abs=1e-6)


def test_partial_correlation_is_that_of_residuals(spark):
    rng = np.random.default_rng(1)
    c, d = rng.normal(size=(2, 300))
    x, y = c + 0.5 * d + rng.normal(size=300), c - d + rng.normal(size=300)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(x, y, c, d, strict=True)], "g string, x double, y double, c double, d double")
    design = np.c_[np.ones(300), c, d]
    rest = [v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in (x, y)]
    got = D.partial_correlations(df, "x", "y", ["c", "d"], ["g"]).first()
    assert got["n"] == 300 and got["partial"] == pytest.approx(np.corrcoef(*rest)[0, 1])
    one = D.partial_correlations(df.withColumn("c", F.lit(1.0)), "x", "y", ["c"], ["g"]).first()
    assert one["partial"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_partial_correlation_of_as_few_rows_as_columns(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(12):
        half = np.round(rng.normal(size=(4, 5)) * 10, 1)  # with their opposites, as the two sides of four games
        x, y, *controls = half.T
        rest = [v - np.c_[*controls] @ np.linalg.lstsq(np.c_[*controls], v, rcond=None)[0] for v in (x, y)]
        want[f"g{k:02}"] = np.sign(rest[0] @ rest[1])
        rows += [(f"g{k:02}", *map(float, r)) for r in [*half, *-half]]
    df = spark.createDataFrame(rows, "g string, x double, y double, c double, d double, e double")
    got = {r["g"]: r["partial"] for r in D.partial_correlations(df, "x", "y", ["c", "d", "e"], ["g"]).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    explained = D.partial_correlations(df.withColumn("x", F.col("c") + F.col("d")), "x", "y", ["c", "d"], ["g"])
    assert {r["partial"] for r in explained.collect()} == {None}


def test_a_system_is_solved_alike_on_the_driver_and_by_steps(spark):
    from tallyspark.operators.forecast import market_ratings
    from tallyspark.operators.sparse import solved

    rng = np.random.default_rng(6)
    half = rng.normal(size=(20, 12))
    a, b = half.T @ half, rng.normal(size=12)
    gram = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, g double")
    right = spark.createDataFrame([(i, float(b[i]), 0.5) for i in range(12)], "i long, b double, penalty double")
    want = np.linalg.solve(a + 0.5 * np.eye(12), b)
    for small in (100, 3):
        got = {r["i"]: r["x"] for r in solved(gram, right, small).collect()}
        assert np.allclose([got[i] for i in range(12)], want, atol=1e-6), small
    strength = [3.0, 0.0, -3.0]
    lines = spark.createDataFrame([(h, g, strength[h] - strength[g] + 2.0) for h in range(3) for g in range(3) if h != g] * 5, "home_id long, away_id long, line double")
    rated = {r["team_id"]: r["rating"] for r in market_ratings(lines, 1e-6).collect()}
    assert rated[0] - rated[2] == pytest.approx(6, abs=1e-3) and rated[1] == pytest.approx(0, abs=1e-3)


def test_each_feature_alone_equals_walk_forward(spark):
    rng = np.random.default_rng(21)
    rows = [(f"{2000 + y}", k, *map(float, rng.normal(size=3))) for y in range(5) for k in range(30)]
    df = spark.createDataFrame(rows, "season string, k int, a double, b double, y double")
    got = {(r["model"], r["season"], r["k"]): r["prediction"] for r in D.each_alone(df, "season", ["a", "b"], "y", 2).collect()}
    for f in ("a", "b"):
        want = {(f, r["season"], r["k"]): r["prediction"] for r in L.walk_forward(df, "season", [f], "y", 2).collect()}
        assert {k: v for k, v in got.items() if k[0] == f} == pytest.approx(want)


def test_a_group_of_too_many_teams_raises(monkeypatch):
    import pandas as pd

    from tallyspark.operators import statespace as S

    monkeypatch.setattr(S, "MOST_TEAMS", 3)
    games = pd.DataFrame({"game_date": [1, 2], "game_id": ["a", "b"], "home_id": [1, 3], "away_id": [2, 4]})
    with pytest.raises(ValueError):
        S.in_order(games)
