"""As-of joins, least squares, filters, play-by-play, ratings, text and streams."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import plans
from tallyspark.operators import asof as A
from tallyspark.operators import availability as V
from tallyspark.operators import linear as L
from tallyspark.operators import ratings as R
from tallyspark.operators import sequence as S
from tallyspark.operators import statespace as K
from tallyspark.operators import text as X
from tallyspark.streaming import incremental as I

DAY = lambda n: dt.date(2024, 1, n)


def test_asof_strictness_and_ties(spark):
    left = spark.createDataFrame([("a", DAY(1)), ("a", DAY(2)), ("a", DAY(3)), ("b", DAY(9))], "k string, t date")
    right = spark.createDataFrame([("a", DAY(2), 1, 10.0), ("a", DAY(2), 2, 20.0), ("a", DAY(1), 1, None)], "k string, t date, n int, v double")
    value = lambda **x: [r["v"] for r in A.asof(left, right, ["k"], "t", ["v"], tie=["n"], **x).orderBy("k", "t").collect()]
    assert value() == [None, None, 20.0, None]
    assert value(strict=False) == [None, 20.0, 20.0, None]


def test_absences_fall_back(spark):
    rows = [("p", "2022_23", DAY(1), 10.0, "played", True), ("p", "2023_24", DAY(2), None, "inactive", True), ("p", "2023_24", DAY(3), 4.0, "played", False), ("p", "2023_24", DAY(4), None, "inactive", False), ("q", "2023_24", DAY(4), None, "inactive", True)]
    log = spark.createDataFrame(rows, "person_id string, season string, t date, score double, status string, is_home boolean")
    got = {(r["person_id"], r["t"].day): r["value_asof"] for r in V.valued_absences(log, F.col("status") == "inactive", "score", "t").collect()}
    assert got == {("p", 2): 10.0, ("p", 4): 4.0, ("q", 4): 0.0}


def test_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=500) * 0.1
    df = spark.createDataFrame([(int(i % 5), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "fold int, a double, b double, y double")
    fit = L.fit(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.c_[np.ones(500), x], y, rcond=None)[0]
    assert np.allclose(fit["beta"], want, atol=1e-9) and fit["n"] == 500
    said = L.walk_forward(df, "fold", ["a", "b"], "y", burn_in=2)
    assert sorted({r["fold"] for r in said.select("fold").distinct().collect()}) == [2, 3, 4]
    changed = df.withColumn("y", F.when(F.col("fold") == 4, 0.0).otherwise(F.col("y")))
    early = lambda d: sorted(r["prediction"] for r in L.walk_forward(d, "fold", ["a", "b"], "y", burn_in=2).where("fold < 4").collect())
    assert np.allclose(early(df), early(changed))
    metrics = L.metrics(said, "prediction", "y", sigma=1.0).first()
    assert metrics["mae"] < 0.1 and 0 <= metrics["brier"] <= 1


def test_player_filter_follows_a_level_and_ignores_absence(spark):
    rng = np.random.default_rng(1)
    rows = [("p", dt.date(2023, 1, 1) + dt.timedelta(days=2 * i), float(20 + rng.normal()), 30.0) for i in range(60)]
    schema = "person string, d date, y double, m double"
    out = K.ou_filter(spark.createDataFrame(rows, schema), "person", "d", "y", "m", 0.001, 25.0, 30.0, 0.0).orderBy("d").collect()
    assert out[-1]["level"] == pytest.approx(20, abs=1.5) and all(0 < r["level_var"] <= r["pred_var"] <= 25 for r in out)
    absent = [(*r[:2], None, None) if i == 30 else r for i, r in enumerate(rows)]
    other = K.ou_filter(spark.createDataFrame(absent, schema), "person", "d", "y", "m", 0.001, 25.0, 30.0, 0.0).orderBy("d").collect()
    assert other[30]["level"] == other[30]["pred"] and [tuple(r) for r in out[:30]] == [tuple(r) for r in other[:30]]


LEAGUE = "season string, game_id string, game_date date, home_id long, away_id long, margin double"


def league(n=90, seed=2):
    rng = np.random.default_rng(seed)
    strength = {1: 8.0, 2: 0.0, 3: -8.0}
    rows = []
    for i in range(n):
        h, a = rng.choice([1, 2, 3], 2, replace=False)
        rows.append(("2024_25", f"{i:03}", DAY(1) + dt.timedelta(days=i), int(h), int(a), float(strength[h] - strength[a] + 2.5 + rng.normal() * 3)))
    return strength, rows


def textbook(observed, h, noise, drift, x, p, wanted=None):
    """A Kalman filter with whole matrices: what is foreseen of `wanted` (a row of each h by default), step by step."""
    said = []
    for y, m in zip(observed, h, strict=True):
        p = p + np.diag(drift)
        row = m[0] if wanted is None else wanted(m)
        said.append((row @ x, row @ p @ row))
        if not np.isnan(y).any():
            gain = p @ m.T @ np.linalg.inv(m @ p @ m.T + noise)
            x, p = x + gain @ (y - m @ x), (np.eye(len(x)) - gain @ m) @ p
    return np.array(said)


def test_team_kalman_finds_the_better_team_and_never_looks_ahead(spark):
    strength, rows = league()
    out = {r["game_id"]: r["pred"] for r in K.team_kalman(spark.createDataFrame(rows, LEAGUE), q=0.01, r=9.0).collect()}
    late = rows[60:]
    assert np.mean([abs(out[r[1]] - (strength[r[3]] - strength[r[4]] + 2.5)) for r in late]) < 2
    changed = [(*r[:5], -50.0) if r is rows[-1] else r for r in rows]
    assert {r["game_id"]: r["pred"] for r in K.team_kalman(spark.createDataFrame(changed, LEAGUE), q=0.01, r=9.0).collect()} == out


def test_team_kalman_is_the_textbook_filter(spark):
    _, rows = league(40)
    rows[7] = (*rows[7][:5], None)  # not played yet
    h = [np.array([[(t == r[3]) - (t == r[4]) for t in (1, 2, 3)] + [1.0]], float) for r in rows]
    y = [np.array([np.nan if r[5] is None else r[5]]) for r in rows]
    want = textbook(y, h, np.array([[9.0]]), [0.02] * 3 + [0.0], np.array([1.5, 0.0, -4.0, 2.5]), np.diag([30.0, 30.0, 30.0, 1.0]))
    seed = spark.createDataFrame([("2024_25", 1, 1.5), ("2024_25", 3, -4.0)], "season string, team_id long, rating double")
    got = sorted(tuple(r)[1:] for r in K.team_kalman(spark.createDataFrame(rows, LEAGUE), seed, q=0.02, r=9.0).collect())
    assert np.allclose([g[1] for g in got], want[:, 0]) and np.allclose([g[2] for g in got], want[:, 1] + 9.0)


def test_kalman_grid_is_each_setting_by_itself_and_choices_look_back(spark):
    rows = [(f"202{k}", *r[1:]) for k in range(3) for r in league(30, k)[1]]
    games = spark.createDataFrame(rows, LEAGUE)
    grid = [{"q": 0.01, "r": 9.0, "p0": 30.0}, {"q": 5.0, "r": 400.0, "p0": 30.0}]
    scores = K.kalman_grid(games, grid)
    for r in scores.collect():
        s = grid[r["setting"]]
        own = K.team_kalman(games.where(F.col("season") == r["season"]), q=s["q"], r=s["r"], p0=s["p0"]).join(games, ["season", "game_id"])
        one = own.agg(F.avg(0.5 * (F.log(2 * math.pi * F.col("pred_var")) + F.pow(F.col("margin") - F.col("pred"), 2) / F.col("pred_var"))).alias("nll"), F.avg(F.abs(F.col("margin") - F.col("pred"))).alias("mae")).first()
        assert r["nll"] == pytest.approx(one["nll"]) and r["mae"] == pytest.approx(one["mae"]) and r["n"] == 30
    assert sorted((r["season"], r["setting"]) for r in K.chosen_before(scores, "season").collect()) == [("2021", 0), ("2022", 0)]


@pytest.mark.parametrize("margin_noise", [None, 4.0])
def test_factor_kalman_is_the_textbook_filter(spark, margin_noise):
    rng = np.random.default_rng(4)
    rows = [(*r, *map(float, rng.normal(size=2))) for r in league(25)[1]]
    rows[5] = (*rows[5][:7], None)
    w = np.array([2.0, -1.0])
    h, y = [], []
    for r in rows:
        m = np.zeros((2, 6))
        for k in range(2):
            m[k, 2 * (r[3] - 1) + k], m[k, 2 * (r[4] - 1) + k] = 1, -1
        z = [np.nan if v is None else (v - 0.1) / 2 for v in r[6:]]
        h.append(m if margin_noise is None else np.vstack([m, w @ m]))
        y.append(np.array(z if margin_noise is None else [*z, r[5] - 2.5]))
    noise = np.diag([1.5, 1.5] + ([] if margin_noise is None else [margin_noise]))
    want = textbook(y, h, noise, [0.03] * 6, np.zeros(6), np.eye(6) * 0.7, lambda m: w @ m[:2])
    found = K.factor_kalman(spark.createDataFrame(rows, LEAGUE + ", f double, g double"), ["f", "g"], [0.1, 0.1], [2.0, 2.0], list(w), 2.5, 5.0, q=0.03, r=1.5, p0=0.7, margin_noise=margin_noise)
    got = sorted(tuple(r)[1:] for r in found.collect())
    assert np.allclose([g[1] for g in got], want[:, 0] + 2.5) and np.allclose([g[2] for g in got], want[:, 1] + 5.0)


def careers(players=40, games=80, half_life=30.0, seed=5):
    """Levels that revert with a known half-life, seen with noise 300 / minutes."""
    rng = np.random.default_rng(seed)
    rows, lam = [], math.log(2) / half_life
    for p in range(players):
        level, day = rng.normal() * 5, 0
        for _ in range(games):
            step = int(rng.integers(1, 6))
            day += step
            keep = math.exp(-lam * step)
            level = keep * level + rng.normal() * 5 * math.sqrt(1 - keep * keep)
            minutes = float(rng.integers(10, 40))
            rows.append((p, dt.date(2023, 1, 1) + dt.timedelta(days=day), level + rng.normal() * math.sqrt(300 / minutes), minutes))
    return [(*r[:2], None, None) if i % 11 == 3 else r for i, r in enumerate(rows)]


def test_likelihood_is_the_sum_of_its_rows_and_finds_the_half_life(spark):
    rows = careers()
    df = spark.createDataFrame(rows, "person long, d date, y double, m double").withColumn("month", F.date_format("d", "yyyy-MM"))
    settings = [(math.log(2) / h, 25.0, 300.0) for h in (2.0, 30.0, 500.0)]
    got = {(r["setting"], r["month"]): (r["nll"], r["n"]) for r in K.ou_likelihood(df, "person", "d", "y", "m", "month", settings, 0.0).collect()}
    want = {}
    for k, (lam, s2, c) in enumerate(settings):
        for p in range(40):
            level, var, last = 0.0, s2, None
            for _, d, y, m in (r for r in rows if r[0] == p):
                keep = math.exp(-lam * (d - last).days) if last else 1.0
                last, level, var = d, keep * level, keep**2 * var + s2 * (1 - keep**2)
                if y is not None:
                    f = var + c / m
                    total, n = want.get((k, f"{d:%Y-%m}"), (0.0, 0))
                    want[k, f"{d:%Y-%m}"] = (total + 0.5 * (math.log(2 * math.pi * f) + (y - level) ** 2 / f), n + 1)
                    level, var = level + var / f * (y - level), var * (1 - var / f)
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    sums = [sum(v[0] for (k, _), v in got.items() if k == s) for s in range(3)]
    assert sums[1] == min(sums)


def play(pos, kind, team=1, pid=11, made=False, at=0.0, pts=0, n=1, m=1, oreb=None, technical=False, flagrant=False, period=1):
    return ("g", pos, period, float(at), team, pid, kind, made, pts, n, m, technical, flagrant, oreb)


def test_possessions(spark):
    schema = "game_id string, feed_pos long, period int, at double, team long, pid long, kind string, made boolean, pts int, n int, m int, technical boolean, flagrant boolean, is_oreb boolean"
    rows = [
        play(1, "shot", made=True, pts=2, at=10), play(2, "ft", made=True, pts=1, at=10),  # and one
        play(3, "shot", team=2, pid=21, at=20), play(4, "reb", team=2, pid=22, at=21, oreb=True), play(5, "shot", team=2, pid=22, at=25), play(6, "reb", team=1, pid=12, at=26, oreb=False),
        play(7, "tov", team=1, at=40),
        play(8, "ft", team=1, pid=13, technical=True, made=True, pts=1, at=45),
        play(9, "shot", team=2, pid=21, at=50), play(10, "shot", team=1, made=True, pts=3, at=60),  # a change without an end
        play(11, "ft", team=2, pid=21, made=True, pts=1, n=2, m=2, flagrant=True, at=70), play(12, "shot", team=2, pid=21, at=80), play(13, "period_end", team=0, pid=0, at=720),
        play(14, "shot", team=1, made=True, pts=2, at=730, period=2),
    ]
    out = S.possessions(spark.createDataFrame(rows, schema)).orderBy("possession_idx").collect()
    got = [(r["off_team"], r["points"], r["n_chances"], r["end_type"], r["start_type"], r["start_at"], r["end_at"]) for r in out]
    assert got == [
        (1, 3, 1, "ft", "period_start", 10.0, 10.0),
        (2, 0, 2, "dreb", "ft", 10.0, 26.0),
        (1, 0, 1, "tov", "dreb", 26.0, 40.0),
        (2, 0, 1, "anomaly", "tov", 40.0, 50.0),
        (1, 3, 1, "make", "anomaly", 50.0, 60.0),
        (2, 1, 2, "period_end", "make", 60.0, 720.0),
        (1, 2, 1, "make", "period_start", 730.0, 730.0),
    ]
    assert out[0]["flags"] == ["and1"] and out[3]["flags"] == ["forced_close"] and len(out[1]["events"]) == 4


def test_normalised_feed(spark):
    schema = "gameId string, feed_pos long, period int, clock string, teamId long, personId long, actionType string, subType string, description string"
    rows = [("1", 1, 1, "PT11M30.00S", 1, 11, "Missed Shot", "", "MISS A 3PT"), ("1", 2, 1, "PT11M29.00S", 1, 12, "Rebound", "", "A REBOUND (Off:1 Def:0)"), ("1", 3, 5, "PT05M00.00S", 1, 12, "Rebound", "", "A REBOUND (Off:1 Def:1)"), ("1", 4, 5, "PT04M00.00S", 2, 21, "Free Throw", "Free Throw 1 of 2", "B Free Throw"), ("1", 5, 5, "PT04M00.00S", 2, 21, "Made Shot", "", "B 26' 3PT"), ("1", 6, 5, "PT03M00.00S", 2, 21, "Turnover", "No Turnover", "NO TURNOVER"), ("1", 7, 5, "PT03M00.00S", 0, None, "period", "end", "")]
    out = S.normalised(spark.createDataFrame(rows, schema)).orderBy("feed_pos").collect()
    assert [(r["kind"], r["at"], r["pts"], r["is_oreb"]) for r in out] == [("shot", 30.0, 0, None), ("reb", 31.0, 0, True), ("reb", 2880.0, 0, False), ("ft", 2940.0, 1, None), ("shot", 2940.0, 3, None), ("period_end", 3000.0, 0, None)]
    assert (out[3]["n"], out[3]["m"]) == (1, 2) and out[0]["game_id"] == "0000000001"


def test_stints_and_starters(spark):
    schema = "game_id string, period int, feed_pos long, at double, kind string, side string, pid long, sub_in long, pts int"
    home, away = [101, 102, 103, 104, 105], [201, 202, 203, 204, 205]
    rows = [("g", 1, i, 10.0 + i, "shot", "home", p, None, 1) for i, p in enumerate(home)] + [("g", 1, 10 + i, 30.0 + i, "shot", "away", p, None, 0) for i, p in enumerate(away)]
    rows += [("g", 1, 20, 360.0, "sub", "home", 101, 106, 0), ("g", 1, 21, 400.0, "shot", "away", 201, None, 2), ("g", 1, 22, 500.0, "shot", "home", 106, None, 0)]
    events = spark.createDataFrame(rows, schema)
    starters = S.period_starters(events)
    assert {(r["side"], r["pid"]) for r in starters.collect()} == {("home", p) for p in home} | {("away", p) for p in away}
    out = S.stints(events, starters).orderBy("stint_idx").collect()
    assert [(r["seconds"], r["home_pts"], r["away_pts"]) for r in out] == [(360.0, 5, 0), (360.0, 0, 2)]
    assert out[0]["home_lineup"] == home and out[1]["home_lineup"] == [102, 103, 104, 105, 106]
    played = {r["pid"]: r["seconds"] for r in S.lineup_channels(S.stints(events, starters)).collect()}
    assert played[101] == played[106] == 360 and played[102] == 720 and sum(played.values()) == 7200
    assert S.stints(events.where("pid <> 105"), S.period_starters(events.where("pid <> 105"))).count() == 0


def test_ratings_recover_planted_players(spark):
    rng = np.random.default_rng(0)
    skill = rng.normal(0, 4, 40)
    rows = []
    for _ in range(3000):
        who = rng.permutation(40)[:10]
        margin = skill[who[:5]].sum() - skill[who[5:]].sum() + 3
        rows.append((sorted(map(int, who[:5])), sorted(map(int, who[5:])), float(20 * (110 + margin / 2) / 100), float(20 * (110 - margin / 2) / 100), 20, 20))
    df = spark.createDataFrame(rows, "home_lineup array<long>, away_lineup array<long>, home_pts double, away_pts double, home_poss int, away_poss int")
    out = {r["person_id"]: r["offence"] + r["defence"] for r in R.ridge_ratings(R.design(df), 50.0).collect()}
    assert np.corrcoef([out[i] for i in range(40)], skill)[0, 1] > 0.98
    twice = R.design(df.unionAll(df))
    assert twice.count() == R.design(df).count() and twice.agg(F.sum("w")).first()[0] == 2 * R.design(df).agg(F.sum("w")).first()[0]


def test_text_chunks_and_index(spark):
    text = "intro\n\n# One\n\n" + "\n\n".join("word " * 30 for _ in range(5)) + "\n## Two\nshort"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = X.chunks(docs, "id", "text", 400, 50).orderBy("section", "chunk").collect()
    assert [r["heading"] for r in rows][:1] == ["(start)"] and rows[-1]["heading"] == "Two" and rows[-1]["body"] == "short"
    assert sum(r["heading"] == "One" for r in rows) > 1 and all(len(r["body"]) <= 460 for r in rows)
    index = X.tf_idf(spark.createDataFrame([(1, "red fox fox"), (2, "red dog the")], "id int, text string"), "id", "text")
    weights = {(r["id"], r["term"]): r["weight"] for r in index.collect()}
    assert set(weights) == {(1, "red"), (1, "fox"), (2, "red"), (2, "dog")} and weights[1, "fox"] > weights[1, "red"]
    assert sum(w * w for (i, _), w in weights.items() if i == 1) == pytest.approx(1)


def test_streams(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 10, i % 10), i % 3, "view", float(i), "{}") for i in range(40)]
    source = tmp_path / "in"
    for part in range(4):
        spark.createDataFrame(rows[10 * part : 10 * part + 10] + rows[10 * part : 10 * part + 1], I.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda stream, name, mode="append": (I.run_once(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode), spark.read.parquet(str(tmp_path / name)))[1]
    events = I.event_stream(spark, str(source), files=20)
    assert run(I.deduplicated(events), "once").count() == 40
    days = {r["day"].day: r["n"] for r in run(I.daily_counters(events), "days").collect()}
    assert days[1] == 11 and 4 not in days  # the last days are still open
    assert run(I.sessions(events, "2 hours"), "sessions").count() > 0
    levels = I.player_levels(events, 0.01, 100.0, 10.0, 0.0)
    seen = []
    levels.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "l")).start().awaitTermination()
    assert {r["user_id"] for r in seen} == {0, 1, 2} and all(0 < r["level_var"] < 100 for r in seen)


def test_sections_query_splits_texts_with_headings(spark, tmp_path):
    texts = {1: "intro\n# One\nbody 1\n### Two \n\nbody 2\nmore\n#### deep\n#tag", 2: "# Only", 3: "plain", 4: "", 5: "## A\n## B\nx", 6: None, 7: "a # b\n## C\ny"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, text in texts.items():
        parts = [[]]
        for line in (text or "").split("\n"):
            if parts[-1] and any(line.startswith("#" * n + " ") for n in (1, 2, 3)):
                parts.append([])
            parts[-1].append(line)
        for k, lines in enumerate(parts):
            headed = any(lines[0].startswith("#" * n + " ") for n in (1, 2, 3))
            heading = lines[0].lstrip("#").strip() if headed else "(start)"
            body = "\n".join(lines[1:] if headed else lines).strip()
            if headed or body:
                want.add((i, k, heading, len(body)))
    assert {tuple(r) for r in plans.QUERIES["t1_sections"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["t6_cosine_top_k", "t7_prompt"])
def test_searches_grow_with_the_table(spark, sf_dir, name):
    asked = {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    assert {r["query"] for r in plans.QUERIES[name](spark, sf_dir).collect()} == asked and len(asked) > 3


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, v array<double>").where("aggregate(v, 0d, (s, x) -> s + abs(x)) > 0")
    found = X.nearest(docs.where("id % 4 = 0"), docs, "id", "v", 5, block=7, asked=3)
    want = docs.alias("a").join(docs.alias("b")).where("a.id % 4 = 0").select(F.col("a.id").alias("q"), F.col("b.id").alias("i"), X.cosine(F.col("a.v"), F.col("b.v")).alias("s")).collect()
    best = {(q, *x) for q in {r["q"] for r in want} for x in [(r["i"], n) for n, r in enumerate(sorted((r for r in want if r["q"] == q), key=lambda r: (-r["s"], r["i"]))[:5], 1)]}
    assert {(r["query"], r["id"], r["rank"]) for r in found.collect()} == best


def test_tf_idf_query_has_all_terms_and_documents(spark, tmp_path):
    rows = [(1, " ".join(f"t{k}" for k in range(1000))), (2, " ".join(f"u{k} u{k}" for k in range(300))), (3, "the of"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["terms"], r["top"] is None) for r in plans.QUERIES["t4_tf_idf"](spark, str(tmp_path)).collect()}
    assert found == {1: (1000, False), 2: (300, False), 3: (0, True), 4: (0, True)}
