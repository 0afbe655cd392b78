"""Pairing, factors, pivots and trailing features over team-games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import pairing as P
from tallyspark.operators import trailing as T
from tallyspark.plans.base import query, with_team
from tallyspark.sources import boxscores as B

FACTORS = [f"{s}_{k}" for s in ("off", "def") for k in ("efg_pct", "tov_pct", "orb_pct", "ft_rate")]
DIFFS = ["efg_d", "oreb_d", "tov_d", "ftr_d", "ftmfga_d", "pace"]


def r(x: str | Column, name: str | None = None, places: int = 6) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), places).alias(name or x)


def rs(*names: str, places: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {places}) AS {n}" for n in names)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_factors(P.with_opponent(B.team_games(spark, sf_dir), names=("team_abbr",)))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.differentials(P.without_canceled(fact(spark, sf_dir)))


@query("j1_p1_four_factors", with_team(f"SELECT game_id, game_date, season, team_id, opp_team_id, is_home, pts, opp_pts, {rs(*FACTORS)}, margin FROM fact"))
def four_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).select("game_id", "game_date", "season", "team_id", "opp_team_id", "is_home", "pts", "opp_pts", *map(r, FACTORS), "margin")


@query("p2_differentials", with_team(f"SELECT game_id, team_id, {rs(*DIFFS)} FROM live"))
def differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select("game_id", "team_id", *map(r, DIFFS))


def z_sql(over: str) -> str:
    parts = " + ".join(f"{w} * ({c} - avg({c}) OVER ({over})) / nullif(stddev_pop({c}) OVER ({over}), 0)" for c, w in (("efg_d", 0.4), ("tov_d", 0.25), ("oreb_d", 0.2), ("ftr_d", 0.15)))
    return with_team(f"SELECT game_id, team_id, round({parts}, 5) AS composite FROM live")


@query("p3_composite", z_sql(""))
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.composite(live(spark, sf_dir)).select("game_id", "team_id", r("composite", places=5))


@query("p5_season_composite", z_sql("PARTITION BY season"))
def season_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.composite(live(spark, sf_dir), by=["season"]).select("game_id", "team_id", r("composite", places=5))


@query(
    "p4_era_zscore",
    with_team("SELECT game_id, team_id, round((off_ft_rate - avg(off_ft_rate) OVER (PARTITION BY season < '1998_99')) / nullif(stddev_pop(off_ft_rate) OVER (PARTITION BY season < '1998_99'), 0), 5) AS composite FROM live"),
)
def era_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).withColumn("era", F.col("season") < "1998_99")
    return P.composite(rows, {"off_ft_rate": 1.0}, ["era"]).select("game_id", "team_id", r("composite", places=5))


@query(
    "j2_game_level",
    with_team("""SELECT game_id, game_date, season, is_neutral, max(CASE WHEN h = 1 THEN team_id END) AS home_team_id, max(CASE WHEN h > 1 THEN team_id END) AS away_team_id,
    max(CASE WHEN h = 1 THEN pts END) AS home_pts, max(CASE WHEN h > 1 THEN pts END) AS away_pts
    FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY is_home DESC, team_abbr, team_id) AS h FROM fact) GROUP BY ALL"""),
)
def game_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.game_level(fact(spark, sf_dir), ["team_id", "pts"])


@query(
    "j3_modeling_table",
    with_team("""SELECT a.game_id, a.season, a.team_id AS home_id, b.team_id AS away_id, round(a.efg_d_exp - b.efg_d_exp, 6) AS efg_diff, round(a.tov_d_exp - b.tov_d_exp, 6) AS tov_diff, a.margin,
    CAST(a.margin > 0 AS INTEGER) AS home_win FROM
    (SELECT *, avg(efg_d) OVER w AS efg_d_exp, avg(tov_d) OVER w AS tov_d_exp FROM live WHERE NOT is_neutral WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a JOIN
    (SELECT *, avg(efg_d) OVER w AS efg_d_exp, avg(tov_d) OVER w AS tov_d_exp FROM live WHERE NOT is_neutral WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b
    ON a.game_id = b.game_id AND a.is_home AND NOT b.is_home"""),
)
def modeling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.causal_means(live(spark, sf_dir).where("not is_neutral"), ["season", "team_id"], ["game_date", "game_id"], ["efg_d", "tov_d"])
    g = P.game_level(rows, ["team_id", "efg_d_exp", "tov_d_exp", "margin"])
    diff = lambda c: r(F.col(f"home_{c}_d_exp") - F.col(f"away_{c}_d_exp"), f"{c}_diff")
    return g.select("game_id", "season", F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), diff("efg"), diff("tov"), F.col("home_margin").alias("margin"), F.coalesce((F.col("home_margin") > 0).cast("int"), F.lit(0)).alias("home_win"))


FRAME = "PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN"


@query(
    "w1_w2_causal_means",
    with_team(f"""SELECT game_id, team_id, round(avg(margin) OVER e, 6) AS margin_exp, CASE WHEN count(margin) OVER n >= 5 THEN round(avg(margin) OVER n, 6) END AS margin_roll,
    CASE WHEN count(margin) OVER n >= 5 THEN round(var_samp(margin) OVER n, 4) END AS margin_var FROM live
    WINDOW e AS ({FRAME} UNBOUNDED PRECEDING AND 1 PRECEDING), n AS ({FRAME} 15 PRECEDING AND 1 PRECEDING)"""),
)
def causal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.causal_means(live(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"], ["margin"])
    return rows.select("game_id", "team_id", r("margin_exp"), r("margin_roll"), r("margin_var", places=4))


@query("w3_full_window_mean", with_team(f"SELECT game_id, team_id, CASE WHEN count(margin) OVER n = 5 THEN round(avg(margin) OVER n, 6) END AS margin_5 FROM live WINDOW n AS ({FRAME} 4 PRECEDING AND CURRENT ROW)"))
def full_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("season", "team_id").orderBy("game_date", "game_id").rowsBetween(-4, 0)
    return live(spark, sf_dir).select("game_id", "team_id", r(T.full_window_mean("margin", w, 5), "margin_5"))


def with_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team-games at the home team's arena; the arena of team i lies at a place made up from i."""
    rows = B.team_games(spark, sf_dir)
    host = rows.groupBy("game_id").agg(F.min("team_id").alias("host"))
    rows = rows.join(host, "game_id")
    return rows.withColumns({"lat": 25 + (F.col("host") * 7 % 24).cast("double"), "lon": -120 + (F.col("host") * 13 % 50).cast("double"), "utc": (-8 + F.col("host") % 4).cast("int")})


VENUE = """venue AS (SELECT *, CAST(25 + host * 7 % 24 AS DOUBLE) AS lat, CAST(-120 + host * 13 % 50 AS DOUBLE) AS lon, CAST(-8 + host % 4 AS INTEGER) AS utc FROM (SELECT *, min(team_id) OVER (PARTITION BY game_id) AS host FROM team)),
legs AS (SELECT *, lag(game_date) OVER w AS d0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(utc) OVER w AS utc0 FROM venue WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id)),
miles AS (SELECT *, CASE WHEN d0 IS NULL THEN 0 ELSE 2 * 3958.7613 * asin(sqrt(least(1.0, power(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * power(sin(radians(lon - lon0) / 2), 2)))) END AS leg FROM legs)"""


@query(
    "w4_w6_travel",
    with_team(f""", {VENUE} SELECT game_id, team_id, CAST(date_diff('day', d0, game_date) AS INTEGER) AS rest_days, round(leg, 4) AS leg_miles, CAST(coalesce(utc - utc0, 0) AS INTEGER) AS tz_shift,
    CAST(coalesce(date_diff('day', d0, game_date) = 1, false) AS INTEGER) AS is_b2b, CAST(d0 IS NULL AS INTEGER) AS is_opener,
    round(sum(leg) OVER (PARTITION BY season, team_id ORDER BY game_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS miles_7d FROM miles"""),
)
def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.travel(with_venue(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"])
    return made.select("game_id", "team_id", "rest_days", r("leg_miles", places=4), "tz_shift", "is_b2b", "is_opener", r("miles_7d", places=4))


@query(
    "w7_home_streak",
    with_team(f""", f AS (SELECT *, CASE WHEN is_home = lag(is_home) OVER w THEN 0 ELSE 1 END AS ch FROM team WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id)),
    i AS (SELECT *, sum(ch) OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS isl FROM f)
    SELECT game_id, team_id, CAST(CASE WHEN is_home THEN n ELSE -n END AS INTEGER) AS streak FROM (SELECT *, row_number() OVER (PARTITION BY season, team_id, isl ORDER BY game_date, game_id) AS n FROM i)"""),
)
def home_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.signed_streak(B.team_games(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"], "is_home", "streak").select("game_id", "team_id", "streak")


@query("w9_game_number", with_team("SELECT game_id, team_id, CAST(row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS INTEGER) AS game_number FROM team"))
def game_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("season", "team_id").orderBy("game_date", "game_id"))
    return B.team_games(spark, sf_dir).select("game_id", "team_id", n.alias("game_number"))


@query(
    "w16_differences",
    with_team("""SELECT season, CAST(count(dm) AS BIGINT) AS n, round(CAST(sum(dm * dm) AS DOUBLE) / (2 * count(dm)), 6) AS noise_variance, round(corr(margin, prev), 5) AS lag1
    FROM (SELECT season, CAST(margin AS DOUBLE) AS margin, CAST(prev AS DOUBLE) AS prev, CAST(margin - prev AS DOUBLE) AS dm FROM (SELECT *, lag(margin) OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS prev FROM live)) WHERE prev IS NOT NULL GROUP BY season"""),
)
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = F.lag("margin").over(W.partitionBy("season", "team_id").orderBy("game_date", "game_id"))
    rows = live(spark, sf_dir).select("season", F.col("margin").cast("double"), prev.cast("double").alias("prev")).where("prev is not null")
    dm = F.col("margin") - F.col("prev")
    return rows.groupBy("season").agg(F.count(dm).alias("n"), r(F.sum(dm * dm) / (2 * F.count(dm)), "noise_variance"), r(F.corr("margin", "prev"), "lag1", 5))


@query(
    "w13_weighted_form",
    with_team("""SELECT game_id, team_id, CASE WHEN len(past) >= 5 THEN round(list_sum(list_transform(range(1, len(past) + 1), lambda i: past[len(past) + 1 - i] * power(0.9, i - 1)))
    / list_sum(list_transform(range(1, len(past) + 1), lambda i: power(0.9, i - 1))), 6) END AS form
    FROM (SELECT *, coalesce(list(CAST(margin AS DOUBLE)) OVER (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS past FROM live)"""),
)
def weighted_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).withColumn("m", F.col("margin").cast("double"))
    return T.weighted_form(rows, ["season", "team_id"], ["game_date", "game_id"], "m", 0.9).select("game_id", "team_id", r("form"))


@query(
    "w19_history",
    with_team("""SELECT game_id, team_id, CAST(len(past) AS INTEGER) AS n_past, round(coalesce(list_sum(past), 0), 4) AS total, CAST(5 - len(past) AS INTEGER) AS padded
    FROM (SELECT *, coalesce(list(CAST(pts AS DOUBLE)) OVER (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS past FROM live)"""),
)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.history_arrays(live(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"], ["pts", "margin"], 5)
    total = F.aggregate("history", F.lit(0.0), lambda s, x: s + x[0])
    n = F.aggregate("mask", F.lit(0), lambda s, x: s + x)
    return rows.select("game_id", "team_id", n.alias("n_past"), r(total, "total", 4), (F.lit(5) - n).alias("padded"))


@query(
    "g32_trailing_league",
    with_team("""SELECT game_date, fga, coalesce(CAST(sum(fga) OVER w AS BIGINT), 0) AS trail_fga, coalesce(CAST(sum(pts) OVER w AS BIGINT), 0) AS trail_pts
    FROM (SELECT game_date, CAST(sum(fga) AS BIGINT) AS fga, CAST(sum(pts) AS BIGINT) AS pts FROM live GROUP BY game_date)
    WINDOW w AS (ORDER BY game_date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"""),
)
def trailing_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = live(spark, sf_dir).groupBy("game_date").agg(F.sum("fga").alias("fga"), F.sum("pts").alias("pts"))
    return T.daily_baseline(daily, "game_date", ["fga", "pts"]).select("game_date", "fga", "trail_fga", "trail_pts")


@query("g1_g2_team_seasons", with_team(f"SELECT season, team_abbr, count(*) AS games, CAST(sum(CAST(margin > 0 AS INTEGER)) AS BIGINT) AS wins, round(avg(margin), 6) AS net, {', '.join(f'round(avg({f}), 6) AS {f}' for f in FACTORS)} FROM live GROUP BY season, team_abbr"))
def team_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = F.sum((F.col("margin") > 0).cast("int"))
    return live(spark, sf_dir).groupBy("season", "team_abbr").agg(F.count("*").alias("games"), win.alias("wins"), r(F.avg("margin"), "net"), *[r(F.avg(f), f) for f in FACTORS])


@query("w21_season_centred", with_team("SELECT game_id, team_id, round(margin - avg(margin) OVER (PARTITION BY season, is_home), 6) AS centred, round(CAST(pts AS DOUBLE) / nullif(sum(pts) OVER (PARTITION BY game_id), 0) * 5, 6) AS share FROM live"))
def season_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = E.ratio("pts", F.sum("pts").over(W.partitionBy("game_id"))) * 5
    return live(spark, sf_dir).select("game_id", "team_id", r(F.col("margin") - F.avg("margin").over(W.partitionBy("season", "is_home")), "centred"), r(share, "share"))
