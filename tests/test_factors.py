"""Golden values, zero denominators, corruption, leakage and pivots of the team-game operators."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import pairing as P
from tallyspark.operators import trailing as T
from tallyspark.sources import boxscores as B

KEL = {"fgm": 36, "fga": 80, "fg3m": 12, "fg3a": 33, "ftm": 18, "fta": 25, "oreb": 9, "dreb": 31, "tov": 11, "pts": 102}
ORN = {"fgm": 35, "fga": 84, "fg3m": 7, "fg3a": 25, "ftm": 21, "fta": 30, "oreb": 13, "dreb": 29, "tov": 15, "pts": 98}


def games(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], B.TEAM_SCHEMA)


def row(game, team, abbr, home, counts, day=1, neutral=False):
    return (game, dt.date(2024, 11, day), "2024_25", "regular_season", team, abbr, home, neutral, *[counts[c] for c in P.COUNTS])


def test_golden_factors(spark):
    out = P.with_factors(P.with_opponent(games(spark, [row("0022400001", 1, "KEL", True, KEL), row("0022400001", 2, "ORN", False, ORN)]))).where("team_id = 1").first()
    want = {"off_efg_pct": 42 / 80, "off_tov_pct": 11 / 102, "off_orb_pct": 9 / 38, "off_ft_rate": 25 / 80, "def_efg_pct": 38.5 / 84, "def_tov_pct": 15 / 112.2, "def_orb_pct": 13 / 44, "def_ft_rate": 30 / 84}
    for name, value in want.items():
        assert out[name] == pytest.approx(value, abs=1e-15), name
    assert out["margin"] == 4


def test_a_scoreless_game_has_no_factors(spark):
    zero = dict.fromkeys(P.COUNTS, 0)
    rows = P.with_factors(P.with_opponent(games(spark, [row("g", 1, "A", True, zero), row("g", 2, "B", False, zero)])))
    out = rows.first()
    assert all(out[f"{s}_{k}"] is None for s in ("off", "def") for k in ("efg_pct", "tov_pct", "orb_pct", "ft_rate"))
    assert P.without_canceled(rows).count() == 0


@pytest.mark.parametrize("teams", [[1], [1, 2, 3]])
def test_an_unpaired_game_raises(spark, teams):
    with pytest.raises(Exception, match="without exactly two rows"):
        P.with_opponent(games(spark, [row("g", t, "A", True, KEL) for t in teams])).collect()


def test_pairing_is_one_shuffle(spark):
    plan = P.with_factors(P.with_opponent(games(spark, [row("g", 1, "A", True, KEL), row("g", 2, "B", False, ORN)])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_game_level_gives_neutral_games_a_home_side(spark):
    rows = P.with_opponent(games(spark, [row("g", 1, "KEL", False, KEL, neutral=True), row("g", 2, "ORN", False, ORN, neutral=True)]))
    out = P.game_level(rows, ["team_abbr", "pts"]).first()
    assert (out["home_team_abbr"], out["away_team_abbr"], out["home_pts"]) == ("KEL", "ORN", 102)
    assert P.game_level(rows, ["pts"], include_neutral=False).count() == 0


def series(spark, values, start=1):
    rows = [("A", dt.date(2024, 11, start) + dt.timedelta(days=2 * i), f"{i:03}", v, bool(i % 3), 30.0 + i, -90.0 - i, -6) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "team string, game_date date, game_id string, v double, flag boolean, lat double, lon double, utc int")


TRAILING = {
    "means": lambda d: T.causal_means(d, ["team"], ["game_date", "game_id"], ["v"], 5, 2),
    "form": lambda d: T.weighted_form(d, ["team"], ["game_date", "game_id"], "v", 0.9, 4, 2),
    "frames": lambda d: T.form_frames(d, ["team"], "team", ["game_date"], "v"),
    "history": lambda d: T.history_arrays(d, ["team"], ["game_date"], ["v"], 3),
    "missed": lambda d: T.missed_streak(d, ["team"], ["game_date"], "flag", "missed"),
}


@pytest.mark.parametrize("name", TRAILING)
def test_no_row_sees_itself_or_the_future(spark, name):
    values = [float(x * x % 17) for x in range(12)]
    changed = [*values[:-1], 999.0]
    a, b = (TRAILING[name](series(spark, v)).drop("v", "flag").orderBy("game_id").collect() for v in (values, changed))
    assert a == b


def test_trailing_values(spark):
    out = T.causal_means(series(spark, [1.0, None, 3.0, 5.0]), ["team"], ["game_date"], ["v"], 15, 2).orderBy("game_id").collect()
    assert [r["v_exp"] for r in out] == [None, 1.0, 1.0, 2.0]
    assert [r["v_roll"] for r in out] == [None, None, None, 2.0]
    assert out[3]["v_var"] == pytest.approx(2.0)


def test_a_week_is_left_open(spark):
    out = T.travel(series(spark, [1.0] * 6), ["team"], ["game_date", "game_id"]).orderBy("game_id").collect()
    legs = [r["leg_miles"] for r in out]
    assert [r["rest_days"] for r in out] == [None, 2, 2, 2, 2, 2] and legs[0] == 0 and out[0]["is_opener"] == 1
    assert out[5]["miles_7d"] == pytest.approx(sum(legs[2:6]))


def test_streaks(spark):
    out = T.signed_streak(series(spark, [0.0] * 7), ["team"], ["game_date"], "flag", "s").orderBy("game_id").collect()
    assert [r["s"] for r in out] == [-1, 1, 2, -1, 1, 2, -1]


def test_haversine_and_clocks(spark):
    x = spark.range(1).select(
        E.haversine(F.lit(34.0522), F.lit(-118.2437), F.lit(40.7128), F.lit(-74.006)).alias("d"),
        *[E.minutes_of(F.lit(t)).alias(f"m{i}") for i, t in enumerate(["12:30", "PT06M30.00S", "7", "", "DNP"])],
        E.iso_clock_seconds(F.lit("PT11M30.50S")).alias("s"),
        E.name_key(F.lit(" Luka Dončić Jr. ")).alias("n"),
        E.normal_cdf(F.lit(1.96)).alias("p"),
        E.season_of(F.lit("2024-03-01").cast("date")).alias("y"),
        E.game_id_parts(F.lit("49700001"))["season"].alias("g"),
    ).first()
    assert x["d"] == pytest.approx(2445.6, abs=1) and [x["m0"], x["m1"], x["m2"], x["m3"], x["m4"]] == [12.5, 6.5, 7.0, None, None]
    assert x["s"] == 690.5 and x["n"] == "luka doncic" and x["p"] == pytest.approx(0.9750021, abs=1e-6) and x["y"] == "2023_24" and x["g"] == "1997_98"


def envelope(tmp_path, matchups=("KEL vs. ORN", "ORN @ KEL"), key="resultSets"):
    headers = ["GAME_ID", "GAME_DATE", "MATCHUP", "TEAM_ID", "TEAM_ABBREVIATION", "FGM", "FGA", "FG3M", "FG3A", "FTM", "FTA", "OREB", "DREB", "TOV", "PTS"]
    rows = [["22400001", "2024-11-01", m, t, m[:3], *[c[x] for x in P.COUNTS]] for t, (m, c) in enumerate(zip(matchups, (KEL, ORN), strict=True))]
    one = {"name": "LeagueGameLog", "headers": headers, "rowSet": rows}
    (tmp_path / "log.json").write_text(json.dumps({key: [one] if key == "resultSets" else one}, indent=1))
    return str(tmp_path / "log.json")


@pytest.mark.parametrize("key", ["resultSets", "resultSet"])
def test_game_log_envelope(spark, tmp_path, key):
    rows = B.team_games_from_log(B.read_envelope(spark, envelope(tmp_path, key=key), "LeagueGameLog"), "2024_25", "regular_season").orderBy("team_id").collect()
    assert [(r["game_id"], r["team_abbr"], r["is_home"], r["is_neutral"], r["pts"]) for r in rows] == [("0022400001", "KEL", True, False, 102), ("0022400001", "ORN", False, False, 98)]
    assert B.read_envelope(spark, envelope(tmp_path), "Other").count() == 0


def test_neutral_and_corrupt_envelopes(spark, tmp_path):
    rows = B.team_games_from_log(B.read_envelope(spark, envelope(tmp_path, ("KEL @ ORN", "ORN @ KEL"))), "2024_25", "regular_season").collect()
    assert all(r["is_neutral"] and not r["is_home"] for r in rows)
    with pytest.raises(Exception, match="unknown match-up"):
        B.team_games_from_log(B.read_envelope(spark, envelope(tmp_path, ("KEL - ORN", "ORN @ KEL"))), "2024_25", "regular_season").collect()
    (tmp_path / "bad.json").write_text("{nothing")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        B.read_envelope(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError, match="missing columns: x"):
        B.require_columns(spark.range(1), ["id", "x"])


def test_processed_tree(spark, tmp_path):
    rows = P.with_opponent(games(spark, [row("a", 1, "KEL", True, KEL), row("a", 2, "ORN", False, ORN)]))
    root = str(tmp_path / "processed")
    assert B.read_processed(spark, root, "2020_21", "2025_26", "regular_season").count() == 0
    B.write_processed(rows, root)
    B.write_processed(rows.withColumn("season", F.lit("2023_24")), root)
    B.write_processed(rows, root)  # replaces its own partition alone
    assert B.read_processed(spark, root, "2023_24", "2024_25", "regular_season").count() == 4
    assert B.read_processed(spark, root, "2024_25", "2024_25", "regular_season").count() == 2


def test_box_scores_lines_and_coaches(spark, tmp_path):
    player = lambda i, m, c="", pos="": {"personId": i, "firstName": "A", "familyName": f"P{i}", "nameI": f"A. P{i}", "position": pos, "comment": c, "statistics": {"minutes": m, "points": 4}}
    box = {"boxScoreTraditional": {"gameId": "22400001", "homeTeam": {"teamId": 1, "players": [player(1, "30:30", pos="G"), player(2, "", "DNP - Coach's Decision")]}, "awayTeam": {"teamId": 2, "players": [player(3, "PT12M00.00S"), player(4, "", "DND - Injury")]}}}
    (tmp_path / "box.json").write_text(json.dumps(box))
    rows = {r["person_id"]: r for r in B.players_from_box(spark, str(tmp_path / "box.json")).collect()}
    assert [rows[i]["status"] for i in (1, 2, 3, 4)] == ["played", "dnp_coach", "played", "dnp_other"]
    assert rows[1]["minutes"] == 30.5 and rows[1]["starter"] and rows[3]["minutes"] == 12.0 and not rows[3]["is_home"]
    (tmp_path / "l.csv").write_text("date,home,away,score_home,score_away,spread,total,whos_favored\n2024-11-01,a,b,1,2,3.5,200,away\n2024-11-02,a,b,1,2,3.5,200,home\n")
    assert [r["line"] for r in B.lines_csv(spark, str(tmp_path / "l.csv")).orderBy("date").collect()] == [-3.5, 3.5]
    (tmp_path / "c.txt").write_text("#2023\nORN,Ann\nORN,Bob\n#2024\nORN,Bob\n")
    got = [tuple(r) for r in B.coach_stints(spark, str(tmp_path / "c.txt")).orderBy("season", "stint").collect()]
    assert got == [("2023_24", "ORN", "Ann", 1), ("2023_24", "ORN", "Bob", 2), ("2024_25", "ORN", "Bob", 1)]
