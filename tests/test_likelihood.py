from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tallyspark.operators.likelihood import OuModel, Problem, component_filters, fitted, minimised
from tallyspark.operators.statespace import Histories, dealt, ou_filter, ou_likelihood, scored
from tallyspark.plans import QUERIES
from tallyspark.plans.models import OU_GRID

PLANTED = 0.03, 40.0, 150.0


@pytest.fixture(scope="module")
def log(spark):
    """Levels that revert at a known rate, seen with noise of a known size."""
    rng = np.random.default_rng(12)
    lam, sigma2, c = PLANTED
    people, games = 1000, 60
    gap = rng.integers(1, 9, (people, games))
    minutes = rng.integers(5, 40, (people, games)).astype(float)
    level = rng.normal(0, np.sqrt(sigma2), people)
    rows = []
    day = np.zeros(people, int)
    for g in range(games):
        keep = np.exp(-lam * gap[:, g])
        level = keep * level + rng.normal(0, 1, people) * np.sqrt(sigma2 * (1 - keep**2))
        day = day + gap[:, g]
        seen = 10 + level + rng.normal(0, 1, people) * np.sqrt(c / minutes[:, g])
        rows += [(p, dt.date(2023, 1, 1) + dt.timedelta(days=int(day[p])), float(seen[p]), float(minutes[p, g]), int(day[p] // 90)) for p in range(people)]
    return spark.createDataFrame(rows, "person_id long, game_date date, score double, minutes double, period int").repartition(4)


@pytest.fixture(scope="module")
def model(log):
    return OuModel(log, "person_id", "game_date", "score", "minutes", "period")


def test_planted_parameters_are_found(model):
    best = model.fit()
    assert np.exp(best.at) == pytest.approx(PLANTED, rel=0.05)
    grid = [np.log([0.6931471805599453 / h, s * 1e-5, c * 1e-5]) for h, s, c in OU_GRID] + [np.log(PLANTED)]
    assert best.value <= model.scores([(x, None) for x in grid]).min() + 1e-6
    for (estimate, low, high), true, at in zip(model.intervals(best), PLANTED, best.at, strict=True):
        assert low < estimate < high and low * 0.9 < true < high * 1.1 and estimate == pytest.approx(float(np.exp(at)))
        assert high / low < 1.4


def test_folds_are_fitted_on_earlier_periods_alone(spark, log, model):
    got = {r["period"]: r for r in model.walk_forward().collect()}
    assert min(got) == 1 and all(np.isfinite(r["nll"]) and r["n"] > 0 for r in got.values())
    last = max(got)
    alone = OuModel(log.where(f"period < {last}"), "person_id", "game_date", "score", "minutes", "period")
    alone.mu = model.mu
    best = alone.fit()
    assert (got[last]["lam"], got[last]["sigma2"], got[last]["c"]) == pytest.approx(tuple(np.exp(best.at)), rel=0.02)


def test_the_search_on_a_known_surface():
    def scores(asked):
        return np.array([(x[0] - 1) ** 2 * 5 + (x[1] + 2) ** 2 + 0.3 * (x[0] - 1) * (x[1] + 2) + (x[2] - 0.5) ** 4 for x, _ in asked])

    low, high = np.full(3, -9.0), np.full(3, 9.0)
    free, fixed = minimised([Problem(np.zeros(3)), Problem(np.array([3.0, 0.0, 0.5]), (1, 2))], scores, low, high, tolerance=1e-9)
    assert free.at == pytest.approx([1, -2, 0.5], abs=0.06) and fixed.at == pytest.approx([3, -2.3, 0.5], abs=0.02)


def test_a_search_ends_at_a_bound_and_where_nothing_is_gained(spark):
    passes = []

    def scores(asked):
        passes.append(len(asked))
        return np.array([(x[0] - 20) ** 2 + (x[1] + 2) ** 2 + (x[2] - 0.5) ** 2 for x, _ in asked])

    low, high = np.full(3, -9.0), np.full(3, 9.0)
    (bound,) = minimised([Problem(np.zeros(3))], scores, low, high)
    assert bound.done and len(passes) < 30 and bound.at == pytest.approx([9, -2, 0.5], abs=0.01) and bound.value == pytest.approx(121, abs=1e-3)
    (there,) = minimised([Problem(np.array([8.0, -2.0, 0.5]))], lambda asked: np.array([((x - [8, -2, 0.5]) ** 2).sum() for x, _ in asked]), low, high)
    assert there.done and there.value == 0
    assert spark.createDataFrame([(there.value,)], "nll double").first()[0] == 0  # a plain number, which Spark takes


def test_dealt_rows_give_the_filters_likelihood(spark):
    """Several values with gaps of their own, dealt once; rows that show nothing; several rows of a day; a period without a value."""
    rng = np.random.default_rng(5)
    rows = []
    for p in range(60):
        for g in range(1 + p % 23):
            a, b = (float(rng.normal(3, 2)) if rng.random() < keep else None for keep in (0.7, 0.9))
            day = dt.date(2024, 1, 1) + dt.timedelta(days=int(g * 1.4))
            rows.append((p, day, None if day.day == 9 else a, b, [20.0, 7.5, 0.0, None][int(rng.integers(0, 4)) if g % 5 == 0 else 0], f"p{day.day // 9}"))
    rows.append((7, dt.date(2024, 3, 1), None, None, 5.0, "void"))
    df = spark.createDataFrame(rows, "person long, d date, a double, b double, m double, period string").repartition(3)
    settings = [(0.05, 2.0, 30.0), (2.0, 0.5, 9.0), (1e-3, 9.0, 1.0)]
    packed = dealt(df, "person", "d", ["a", "b"], "m", "period")
    got = {(r["part"], r["setting"], r["period"]): (r["nll"], r["n"]) for r in scored(packed, [settings, settings[:1]], [3.0, 2.5]).collect()}
    h = Histories(df.toPandas(), "person", "d", "a", "m")
    for part, (value, mu) in enumerate((("a", 3.0), ("b", 2.5))):
        h.show(value)
        for k, (lam, sigma2, c) in enumerate(settings[: 3 - 2 * part]):
            level, var = h.filtered([lam], [sigma2], [c], mu)[0, h.seen, :2].T
            total = var + c / h.minutes[h.seen]
            term = 0.5 * (np.log(2 * np.pi * total) + (h.value[h.seen] - level) ** 2 / total)
            names = h.rows.period.to_numpy()[h.seen]
            for name in set(names):
                assert got.pop((part, k, name)) == (pytest.approx(term[names == name].sum()), (names == name).sum())
    assert not got
    assert {x for r in packed.select("periods").collect() for x in r[0]} == {"p0", "p1", "p2", "p3", "void"}
    alone = {(r["setting"], r["period"]): r["nll"] for r in ou_likelihood(df, "person", "d", "b", "m", "period", settings, 2.5).collect()}
    both = {(r["setting"], r["period"]): r["nll"] for r in scored(packed, [[], settings], [0.0, 2.5]).collect()}
    assert alone == pytest.approx(both)


def test_models_that_share_their_rows_are_fitted_like_single_ones(log):
    wide = log.selectExpr("person_id", "game_date", "minutes", "period", "score", "case when person_id % 3 > 0 then 5 - 2 * score end as other")
    models = OuModel.each(wide, "person_id", "game_date", ["score", "other"], "minutes", "period")
    for value, shared, found in zip(("score", "other"), models, fitted(models), strict=True):
        single = OuModel(wide, "person_id", "game_date", value, "minutes", "period")
        best = single.fit([single.start])
        assert (shared.mu, *shared.start) == pytest.approx((single.mu, *single.start))
        assert found.value == pytest.approx(best.value) and found.at == pytest.approx(best.at, abs=1e-3)


def test_components_are_added_up_with_what_they_share(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(40):
        for g in range(30):
            common = rng.normal()
            rows.append((p, dt.date(2015 + g // 10, 11, 1) + dt.timedelta(days=g % 10 * 3), f"{2015 + g // 10}_{16 + g // 10}", float(10 + p % 9), float(common + rng.normal()), float(2 + common + rng.normal()), float(rng.normal()) if p or g != 3 else None))
    df = spark.createDataFrame(rows, "person_id long, game_date date, season string, minutes double, a double, b double, c double").repartition(3)
    settings = {"a": (0.02, 1.0, 20.0, 0.0), "b": (0.05, 0.5, 30.0, 2.0), "c": (0.01, 0.2, 15.0, 0.0)}
    got = {(r["person_id"], r["game_date"]): r for r in component_filters(df, "person_id", "game_date", "season", "minutes", settings).collect()}
    part = {k: {(r["person_id"], r["game_date"]): (r[k], r["pred"], r["pred_var"] + s[2] / r["minutes"]) for r in ou_filter(df, "person_id", "game_date", k, "minutes", *s).collect()} for k, s in settings.items()}
    assert len(got) == 1200
    season = {(r[0], r[1]): r[2] for r in rows}
    for key, r in got.items():
        early = [k for k in got if season[k] < season[key] and part["c"][k][0] is not None]
        var = [part[k][key][2] for k in "abc"]
        joint = sum(var)
        if early and key[0] < 3:
            z = np.array([[(part[k][e][0] - part[k][e][1]) / np.sqrt(part[k][e][2]) for e in early] for k in "abc"])
            rho = np.corrcoef(z)
            joint += sum(2 * rho[i, j] * np.sqrt(var[i] * var[j]) for i in range(3) for j in range(i + 1, 3))
        if not early or key[0] < 3:
            assert (r["pred"], r["var"], r["joint_var"]) == tuple(map(pytest.approx, (sum(part[k][key][1] for k in "abc"), sum(var), joint)))


def test_the_component_query_fits_its_parts_in_common_passes(spark, sf_dir):
    """Five fits share their rows and passes: the query's jobs are those of one search, not of five."""
    context = spark.sparkContext
    context.setJobGroup("components", "")
    try:
        rows = QUERIES["q10_component_filters"](spark, sf_dir).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len({(r["person_id"], r["game_date"]) for r in rows}) == len(rows) > 0 and all(r["var"] > 0 and np.isfinite(r["pred"]) for r in rows)
    jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    assert jobs < 300, jobs
