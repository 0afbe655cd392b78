"""Statistics, least squares, shrinkage, walk-forward evaluation, filters and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import linear as L
from tallyspark.operators import pairing as P
from tallyspark.operators import statespace as S
from tallyspark.operators import text as X
from tallyspark.operators import trailing as T
from tallyspark.operators.likelihood import NAMES, OuModel
from tallyspark.plans.base import ols_sql, query, with_player, with_team
from tallyspark.plans.factors import fact, live, r
from tallyspark.sources import boxscores as B


def home_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season, game_id, game_date, home_id, away_id, margin of games that count."""
    g = P.game_level(live(spark, sf_dir), ["team_id", "margin"])
    return g.select("season", "game_id", "game_date", F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), F.col("home_margin").alias("margin"))


@query("g19_regression", with_team("SELECT season, count(*) AS n, round(corr(margin, efg_d), 4) AS r, round(regr_slope(margin, efg_d), 3) AS slope, round(regr_intercept(margin, efg_d), 3) AS intercept, round(regr_r2(margin, efg_d), 4) AS r2, round(covar_samp(margin, efg_d), 4) AS cov FROM live GROUP BY season"))
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"), r(F.corr("margin", "efg_d"), "r", 4), r(F.regr_slope("margin", "efg_d"), "slope", 3), r(F.regr_intercept("margin", "efg_d"), "intercept", 3), r(F.regr_r2("margin", "efg_d"), "r2", 4), r(F.covar_samp("margin", "efg_d"), "cov", 4))


@query(
    "g20_partial_correlation",
    with_team("SELECT season, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 4) AS partial FROM (SELECT season, corr(margin, efg_d) AS a, corr(margin, tov_d) AS b, corr(efg_d, tov_d) AS c FROM live GROUP BY season)"),
)
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = live(spark, sf_dir).groupBy("season").agg(F.corr("margin", "efg_d").alias("a"), F.corr("margin", "tov_d").alias("b"), F.corr("efg_d", "tov_d").alias("c"))
    return c.select("season", r((F.col("a") - F.col("b") * F.col("c")) / F.sqrt((1 - F.col("b") ** 2) * (1 - F.col("c") ** 2)), "partial", 4))


@query(
    "g21_distribution",
    with_team("""SELECT season, round(avg(pts), 4) AS mean, round(stddev_samp(pts), 4) AS sd, round(kurtosis_pop(pts), 3) AS kurt,
    round((avg(pts::DOUBLE ** 3) - 3 * avg(pts) * avg(pts::DOUBLE ** 2) + 2 * avg(pts) ** 3) / stddev_pop(pts) ** 3, 3) AS skew,
    round(quantile_cont(pts::DOUBLE, 0.05), 4) AS p05, round(quantile_cont(pts::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(pts::DOUBLE, 0.95), 4) AS p95 FROM live GROUP BY season"""),
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("pts", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    d = live(spark, sf_dir).groupBy("season").agg(r(F.avg("pts"), "mean", 4), r(F.stddev_samp("pts"), "sd", 4), r(F.kurtosis("pts"), "kurt", 3), r(F.skewness("pts"), "skew", 3), p.alias("p"))
    return d.select("season", "mean", "sd", "kurt", "skew", *[r(F.col("p")[i], n, 4) for i, n in enumerate(("p05", "p50", "p95"))])


@query(
    "g22_error_buckets",
    with_team("SELECT bucket, count(*) AS n, round(avg(abs(margin)), 6) AS mae FROM (SELECT margin, CASE WHEN pace > 70 AND pace <= 85 THEN 'slow' WHEN pace > 85 AND pace <= 95 THEN 'even' WHEN pace > 95 AND pace <= 200 THEN 'fast' END AS bucket FROM live) GROUP BY bucket"),
)
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).withColumn("bucket", E.bracket("pace", [70, 85, 95, 200], ["slow", "even", "fast"])).groupBy("bucket").agg(F.count("*").alias("n"), r(F.avg(F.abs("margin")), "mae"))


@query("g24_mean_of_means", with_team("SELECT round(avg(m), 6) AS fold_mean, round((SELECT avg(abs(margin)) FROM live), 6) AS pooled FROM (SELECT avg(abs(margin)) AS m FROM live GROUP BY season)"))
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = live(spark, sf_dir).groupBy("season").agg(F.avg(F.abs("margin")).alias("m"), F.sum(F.abs("margin")).alias("s"), F.count("*").alias("n"))
    return folds.agg(r(F.avg("m"), "fold_mean"), r(F.sum("s") / F.sum("n"), "pooled"))


@query("g26_pivot", with_team("SELECT season, round(avg(margin) FILTER (WHERE is_home), 6) AS home, round(avg(margin) FILTER (WHERE NOT is_home), 6) AS away FROM live GROUP BY season"))
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = live(spark, sf_dir).groupBy("season").pivot("is_home", [True, False]).avg("margin")
    return p.select("season", r(F.col("true"), "home"), r(F.col("false"), "away"))


@query("g28_symmetry_k", with_team("SELECT season, round(-sum(x * y) / sum(x * x), 5) AS k FROM (SELECT season, CAST(fta - opp_fta AS DOUBLE) AS x, CAST((fga - oreb + tov) - (opp_fga - opp_oreb + opp_tov) AS DOUBLE) AS y FROM live) GROUP BY season"))
def symmetry_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("fta") - F.col("opp_fta")
    y = (F.col("fga") - F.col("oreb") + F.col("tov")) - (F.col("opp_fga") - F.col("opp_oreb") + F.col("opp_tov"))
    return live(spark, sf_dir).groupBy("season").agg(r(-E.ratio(F.sum(x * y), F.sum(x * x)), "k", 5))


@query("g29_home_advantage", with_team("SELECT season, CAST(month(game_date) AS INTEGER) AS month, count(*) AS games, round(avg(margin), 6) AS margin, round(avg(CAST(margin > 0 AS INTEGER)), 6) AS win, round(avg(CASE WHEN abs(margin) <= 5 THEN margin END), 6) AS close FROM live WHERE is_home GROUP BY ALL"))
def home_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).where("is_home").groupBy("season", F.month("game_date").alias("month"))
    return rows.agg(F.count("*").alias("games"), r(F.avg("margin"), "margin"), r(F.avg((F.col("margin") > 0).cast("int")), "win"), r(F.avg(F.when(F.abs("margin") <= 5, F.col("margin"))), "close"))


@query("g30_imbalance", with_team("SELECT season, team_id, count(*) FILTER (WHERE is_home) AS home, count(*) FILTER (WHERE NOT is_home) AS away FROM team GROUP BY ALL"))
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.team_games(spark, sf_dir).groupBy("season", "team_id").agg(F.count_if("is_home").alias("home"), F.count_if(~F.col("is_home")).alias("away"))


@query("g33_pick_rates", with_team("SELECT edge, count(*) FILTER (WHERE a <> 0) AS n, round(avg(CASE WHEN a <> 0 THEN CAST(sign(p) = sign(a) AS INTEGER) END), 6) AS hit FROM (SELECT unnest([0, 2, 3, 5]) AS edge), (SELECT CAST(pts - 90 AS DOUBLE) AS p, CAST(margin AS DOUBLE) AS a FROM live) WHERE abs(p) >= edge GROUP BY edge"))
def pick_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).select((F.col("pts") - 90).cast("double").alias("p"), F.col("margin").cast("double").alias("a"), F.explode(F.array(*map(F.lit, (0, 2, 3, 5)))).alias("edge"))
    hit = F.when(F.col("a") != 0, (F.signum("p") == F.signum("a")).cast("int"))
    return rows.where(F.abs("p") >= F.col("edge")).groupBy("edge").agg(F.count(hit).alias("n"), r(F.avg(hit), "hit"))


@query("g35_p29_sanity", with_team("SELECT season, count(*) AS n, count(*) FILTER (WHERE fgm > fga) AS bad_fg, count(*) FILTER (WHERE ftm > fta) AS bad_ft, count(*) FILTER (WHERE pts <> 2 * fgm + fg3m + ftm) AS bad_pts, round(abs(avg(off_efg_pct) - avg(def_efg_pct)), 6) AS asymmetry FROM fact GROUP BY season"))
def sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = {"bad_fg": F.col("fgm") > F.col("fga"), "bad_ft": F.col("ftm") > F.col("fta"), "bad_pts": F.col("pts") != 2 * F.col("fgm") + F.col("fg3m") + F.col("ftm")}
    return fact(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in bad.items()], r(F.abs(F.avg("off_efg_pct") - F.avg("def_efg_pct")), "asymmetry"))


@query(
    "m1_ols",
    with_team("""SELECT round((sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz), 3) AS b_efg, round((szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz), 3) AS b_tov
    FROM (SELECT covar_pop(margin, efg_d) AS sxy, covar_pop(margin, tov_d) AS szy, var_pop(efg_d) AS sxx, var_pop(tov_d) AS szz, covar_pop(efg_d, tov_d) AS sxz FROM live)"""),
)
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.fit(live(spark, sf_dir), ["efg_d", "tov_d"], "margin")["beta"]
    return spark.createDataFrame([(round(float(b[1]), 3), round(float(b[2]), 3))], "b_efg double, b_tov double")


FORM = """, f AS (SELECT *, avg(margin) OVER n AS m, CASE WHEN count(margin) OVER n >= 3 THEN var_samp(margin) OVER n END AS v FROM live WINDOW n AS (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)),
g AS (SELECT game_id, team_id, season, margin, CASE WHEN v IS NOT NULL THEN m END AS m, v FROM f),
s AS (SELECT avg(v) AS v0, var_pop(m) AS s0, avg(m) AS m0 FROM g WHERE season < '1999_00')"""


@query(
    "m4_shrunk_form",
    with_team(f"""{FORM} SELECT game_id, team_id, round(m0 + coalesce(sig / nullif(sig + v / ne, 0), 0) * (m - m0), 4) AS form FROM
    (SELECT *, greatest(s0 - v0 / ne, 0) AS sig FROM (SELECT *, least(greatest(v0 / nullif(s0, 0), 1), 15) AS ne FROM g, s WHERE season >= '1999_00'))"""),
)
def shrunk_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.causal_means(live(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"], ["margin"], 15, 3).withColumn("margin_roll", F.when(F.col("margin_var").isNotNull(), F.col("margin_roll")))
    out = L.shrunk_form(rows.where("season < '1999_00'"), rows.where("season >= '1999_00'"), "form", "margin_roll", "margin_var")
    return out.select("game_id", "team_id", r("form", places=4))


@query("m11_seed_mapping", with_team(", t AS (SELECT season, team_id, CAST(sum(CAST(margin > 0 AS INTEGER)) AS DOUBLE) AS wins, avg(margin) AS net FROM live GROUP BY ALL) SELECT season, round(regr_slope(net, wins), 4) AS slope, round(regr_intercept(net, wins), 4) AS intercept, round(regr_r2(net, wins), 4) AS r2 FROM t GROUP BY season"))
def seed_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = live(spark, sf_dir).groupBy("season", "team_id").agg(F.sum((F.col("margin") > 0).cast("int")).cast("double").alias("wins"), F.avg("margin").alias("net"))
    return t.groupBy("season").agg(r(F.regr_slope("net", "wins"), "slope", 4), r(F.regr_intercept("net", "wins"), "intercept", 4), r(F.regr_r2("net", "wins"), "r2", 4))


PHI = """phi AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS u FROM (SELECT *, p / 12.0 AS z FROM (SELECT season, CAST(margin AS DOUBLE) AS a, CAST(pts - 90 AS DOUBLE) AS p FROM live))),
prob AS (SELECT *, least(greatest(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 1e-6), 1 - 1e-6) AS w, CAST(a > 0 AS DOUBLE) AS y FROM (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * (u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429))))) AS tail FROM phi))"""


WALKED = ["efg_d", "tov_d", "oreb_d", "ftr_d"]


@query(
    "m3_walk_forward",
    with_team(
        f""", f AS (SELECT season, CAST(margin AS DOUBLE) AS margin, {', '.join(f'avg({c}) OVER w AS {c}' for c in WALKED)} FROM live WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    whole AS (SELECT season, [margin, 1.0, {', '.join(WALKED)}] AS x FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in WALKED)}),
    numbered AS (SELECT season, row_number() OVER (ORDER BY season) AS k FROM (SELECT DISTINCT season FROM whole)),
    src AS (SELECT t.season, x FROM numbered t JOIN whole p ON p.season < t.season WHERE t.k > 3), {ols_sql("src", "season", WALKED)},
    wide AS (SELECT season, {', '.join(f"max(beta) FILTER (WHERE factor = '{c}') AS b_{c}" for c in ['intercept', *WALKED])} FROM ols WHERE n >= 6 GROUP BY season),
    said AS (SELECT season, margin AS a, b_intercept + {' + '.join(f'b_{c} * {c}' for c in WALKED)} AS p FROM f JOIN wide USING (season)),
    {PHI.replace("SELECT season, CAST(margin AS DOUBLE) AS a, CAST(pts - 90 AS DOUBLE) AS p FROM live", "SELECT * FROM said WHERE p IS NOT NULL")}
    SELECT season, count(*) AS n, round(avg(abs(p - a)), 5) AS mae, round(sqrt(avg((p - a) * (p - a))), 5) AS rmse, round(avg(CAST((p > 0) = (a > 0) AS INTEGER)), 5) AS accuracy, round(avg(-(y * ln(w) + (1 - y) * ln(1 - w))), 5) AS log_loss, round(avg((w - y) * (w - y)), 5) AS brier FROM prob GROUP BY season"""
    ),
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.causal_means(live(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"], WALKED, least=1)
    said = L.walk_forward(rows, "season", [f"{c}_exp" for c in WALKED], "margin", burn_in=3)
    return L.metrics(said, "prediction", "margin", by=["season"]).select("season", "n", *[r(c, places=5) for c in ("mae", "rmse", "accuracy", "log_loss", "brier")])



@query(
    "g23_p22_metrics",
    with_team(f", {PHI} SELECT season, count(*) AS n, round(avg(abs(p - a)), 5) AS mae, round(sqrt(avg((p - a) * (p - a))), 5) AS rmse, round(avg(CAST((p > 0) = (a > 0) AS INTEGER)), 5) AS accuracy, round(avg(-(y * ln(w) + (1 - y) * ln(1 - w))), 5) AS log_loss, round(avg((w - y) * (w - y)), 5) AS brier FROM prob GROUP BY season"),
)
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).select("season", F.col("margin").cast("double").alias("a"), (F.col("pts") - 90).cast("double").alias("p"))
    return L.metrics(rows, "p", "a", by=["season"]).select("season", "n", *[r(c, places=5) for c in ("mae", "rmse", "accuracy", "log_loss", "brier")])


@query(
    "g18_expected_wins",
    with_team(f", {PHI.replace('season, CAST(margin AS DOUBLE)', 'season, team_id, CAST(margin AS DOUBLE)')} SELECT season, team_id, round(sum(w), 5) AS expected, CAST(sum(y) AS BIGINT) AS wins FROM prob GROUP BY season, team_id"),
)
def expected_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).withColumn("w", E.win_probability(F.col("pts") - 90, 12.0))
    return rows.groupBy("season", "team_id").agg(r(F.sum("w"), "expected", 5), F.sum((F.col("margin") > 0).cast("int")).alias("wins"))


def league_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home_games in leagues of 30 teams: a league's games are those of a range of numbers, so a season of it is bounded."""
    g = home_games(spark, sf_dir)
    league = F.floor(F.col("game_id").cast("long") / 65_536).cast("int")
    host = F.col("home_id") % 30
    return g.withColumns({"league": league, "home_id": host, "away_id": (host + 1 + F.col("away_id") % 29) % 30})


@query("q7_team_kalman")
def team_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.team_kalman(league_games(spark, sf_dir), by=("season", "league"))


#: Settings of the team filter that are tried: drift, noise and first variance.
KALMAN_GRID = [{"q": q, "r": v, "p0": p} for q in (0.002, 0.01, 0.03, 0.08) for v in (110.0, 130.0, 150.0, 170.0) for p in (4.0, 9.0, 16.0)]


@query("m12_kalman_grid")
def kalman_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every season, the setting of least loss over the seasons before it, and how it does in its own."""
    games = S.kalman_grid(league_games(spark, sf_dir), KALMAN_GRID, by=("season", "league"))
    seasons = games.groupBy("season", "setting").agg((F.sum(F.col("nll") * F.col("n")) / F.sum("n")).alias("nll"), (F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae"), F.sum("n").alias("n"))
    settings = spark.createDataFrame([(k, s["q"], s["r"], s["p0"]) for k, s in enumerate(KALMAN_GRID)], "setting int, q double, r double, p0 double")
    return S.chosen_before(seasons, "season").drop("loss").join(seasons, ["season", "setting"]).join(F.broadcast(settings), "setting")


@query("q9_player_filter")
def player_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ou_filter(B.player_log(spark, sf_dir), "person_id", "game_date", "score", "minutes", 0.02, 0.9e6, 3.5e7, 2000.0)


@query(
    "q9_player_days",
    with_player(
        """, d AS (SELECT person_id, game_date, coalesce(sum(minutes) FILTER (WHERE score IS NOT NULL AND minutes > 0), 0) / 3.5e7 AS w, coalesce(sum(score * minutes) FILTER (WHERE score IS NOT NULL AND minutes > 0), 0) / 3.5e7 AS y FROM log GROUP BY person_id, game_date),
    o AS (SELECT *, row_number() OVER p AS n, exp(-0.02 * (game_date - lag(game_date) OVER p)) AS keep FROM d WINDOW p AS (PARTITION BY person_id ORDER BY game_date)),
    f AS (SELECT person_id, game_date, n, 2000.0::DOUBLE AS pred, 0.9e6::DOUBLE AS pred_var, (2000.0 / 0.9e6 + y) / (1 / 0.9e6 + w) AS level, 1 / (1 / 0.9e6 + w) AS level_var FROM o WHERE n = 1
        UNION ALL SELECT person_id, game_date, n, pred, pred_var, (pred / pred_var + y) / (1 / pred_var + w), 1 / (1 / pred_var + w)
        FROM (SELECT o.person_id, o.game_date, o.n, o.w, o.y, 2000 + keep * (level - 2000) AS pred, keep * keep * level_var + 0.9e6 * (1 - keep * keep) AS pred_var FROM f JOIN o ON o.person_id = f.person_id AND o.n = f.n + 1))
    SELECT person_id, game_date, round(pred, 4) AS pred, round(pred_var, 2) AS pred_var, round(level, 4) AS level, round(level_var, 2) AS level_var FROM f"""
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def player_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The player filter by day: what was foreseen before the day's first row, and the level after its last."""
    rows = S.ou_filter(B.player_log(spark, sf_dir), "person_id", "game_date", "score", "minutes", 0.02, 0.9e6, 3.5e7, 2000.0)
    days = rows.groupBy("person_id", "game_date").agg(F.max_by("pred", "pred_var").alias("pred"), F.max("pred_var").alias("pred_var"), F.min_by("level", "level_var").alias("level"), F.min("level_var").alias("level_var"))
    return days.select("person_id", "game_date", r("pred", places=4), r("pred_var", places=2), r("level", places=4), r("level_var", places=2))


#: Half-lives in days, stationary variances and noise constants of the player filter that are tried.
OU_GRID = [(float(h), s, c) for h in (1, 3, 15, 60, 240) for s in (1e4, 1e5, 1e6, 1e7) for c in (3e7, 1e8, 3e8, 1e9)]


def ou_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """setting, week, nll, n of all settings, around the mean value by minutes."""
    log = B.player_log(spark, sf_dir).withColumn("week", F.date_trunc("week", "game_date").cast("date").cast("string"))
    mu = log.where("score is not null").agg(F.sum(F.col("score") * F.col("minutes")) / F.sum("minutes")).first()[0]
    return S.ou_likelihood(log, "person_id", "game_date", "score", "minutes", "week", [(0.6931471805599453 / h, s, c) for h, s, c in OU_GRID], float(mu or 0.0))


def ou_settings(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, *s) for k, s in enumerate(OU_GRID)], "setting int, half_life double, sigma2 double, c double"))


@query(
    "m13_ou_profile",
    with_player(
        """, seen AS (SELECT person_id, game_date, CAST(score AS DOUBLE) AS y, CAST(minutes AS DOUBLE) AS m, game_id FROM log WHERE score IS NOT NULL AND minutes > 0), mean AS (SELECT sum(y * m) / sum(m) AS mu FROM seen),
    o AS (SELECT *, row_number() OVER p AS n, game_date - lag(game_date) OVER p AS gap FROM seen WINDOW p AS (PARTITION BY person_id ORDER BY game_date, m, game_id)),
    s AS (SELECT h, s2, c FROM (VALUES (1.0::DOUBLE), (3), (15), (60), (240)) AS a(h), (VALUES (1e4), (1e5), (1e6), (1e7)) AS b(s2), (VALUES (3e7), (1e8), (3e8), (1e9)) AS d(c)),
    f AS (SELECT person_id, n, h, s2, c, mu, mu + s2 / (s2 + c / m) * (y - mu) AS level, s2 * (1 - s2 / (s2 + c / m)) AS v, 0.5 * (ln(2 * pi() * (s2 + c / m)) + (y - mu) * (y - mu) / (s2 + c / m)) AS term FROM o, s, mean WHERE n = 1
        UNION ALL SELECT person_id, n, h, s2, c, mu, pred + pv / (pv + c / m) * (y - pred), pv * (1 - pv / (pv + c / m)), 0.5 * (ln(2 * pi() * (pv + c / m)) + (y - pred) * (y - pred) / (pv + c / m))
        FROM (SELECT o.person_id, o.n, h, s2, c, mu, y, m, mu + exp(-ln(2) / h * gap) * (level - mu) AS pred, exp(-2 * ln(2) / h * gap) * v + s2 * (1 - exp(-2 * ln(2) / h * gap)) AS pv FROM f JOIN o ON o.person_id = f.person_id AND o.n = f.n + 1)),
    total AS (SELECT h, s2, c, sum(term) AS nll, count(*) AS n FROM f GROUP BY h, s2, c)
    SELECT h AS half_life, round(nll, 2) AS nll, s2 AS sigma2, c, n FROM total QUALIFY row_number() OVER (PARTITION BY h ORDER BY nll, s2, c) = 1"""
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def ou_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood's profile over the half-life: for each, the best of the other two parameters."""
    total = ou_scores(spark, sf_dir).groupBy("setting").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n")).join(ou_settings(spark), "setting")
    return total.groupBy("half_life").agg(F.min(F.struct("nll", "sigma2", "c", "n")).alias("b")).select("half_life", r("b.nll", "nll", 2), "b.sigma2", "b.c", "b.n")


@query("m13_ou_walk_forward")
def ou_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every week, the parameters that were most likely over the weeks before it, and their loss in it."""
    scores = ou_scores(spark, sf_dir)
    found = S.chosen_before(scores, "week").drop("loss").join(scores, ["week", "setting"]).join(ou_settings(spark), "setting")
    return found.select("week", "half_life", "sigma2", "c", (F.col("nll") / F.col("n")).alias("mean_nll"), "n")


def ou_model(spark: SparkSession, sf_dir: str) -> OuModel:
    log = B.player_log(spark, sf_dir).withColumn("week", F.date_trunc("week", "game_date").cast("date").cast("string"))
    return OuModel(log.withColumns({"score": F.col("score").cast("double"), "minutes": F.col("minutes").cast("double")}), "person_id", "game_date", "score", "minutes", "week")


@query("m13_ou_fit")
def ou_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's most likely parameters, by a search, each with its 95 % interval from the profile likelihood."""
    model = ou_model(spark, sf_dir)
    best = model.fit()
    rows = [(name, *x, best.value) for name, x in zip(NAMES, model.intervals(best), strict=True)]
    return spark.createDataFrame(rows, "parameter string, estimate double, low double, high double, nll double")


@query("m13_ou_fit_walk_forward")
def ou_fit_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every week, parameters fitted on the weeks before it, each fit from where the last one ended."""
    return ou_model(spark, sf_dir).walk_forward()


@query("l6_set_operations", with_player("SELECT person_id FROM log WHERE status = 'played' INTERSECT SELECT person_id FROM log WHERE status = 'inactive' EXCEPT SELECT person_id FROM log WHERE status = 'dnp_coach'"))
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir)
    who = lambda s: log.where(F.col("status") == s).select("person_id")
    return who("played").intersect(who("inactive")).subtract(who("dnp_coach"))


@query("s23_missing_games", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey", "left_anti")


@query(
    "l5_replace_slice",
    "SELECT c_custkey AS team_id, n AS season, CAST(round(w * 100) AS BIGINT) AS total FROM (SELECT c_custkey, c_nationkey AS n, c_acctbal AS w FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT s_suppkey, 3, avg(s_acctbal) FROM supplier GROUP BY s_suppkey)",
)
def replace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_nationkey").alias("season"), F.col("c_acctbal").alias("w"))
    new = B.table(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("team_id")).agg(F.avg("s_acctbal").alias("w")).withColumn("season", F.lit(3))
    kept = old.join(F.broadcast(new.select("season").distinct()), "season", "left_anti")  # a season or so
    return kept.unionByName(new).select("team_id", "season", F.round(F.col("w") * 100).cast("long").alias("total"))


@query("t6_cosine_top_k", "SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 6")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that grow with the table: every hundredth vector against all."""
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return X.nearest(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 6).withColumn("score", F.round("score", 4))


STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP)


@query(
    "t4_tf_idf",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL),
    t AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 4096), x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS v FROM c JOIN t USING (term)),
    n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM x GROUP BY doc_id), y AS (SELECT doc_id, count(*) AS terms, round(max(v / norm), 5) AS top, round(sum(v / norm), 3) AS total FROM x JOIN n USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(terms, 0) AS terms, top, total FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN y USING (doc_id)""",
)
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many terms as the operator has by default, and a row for documents without any of them: 0 terms, no weights."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    weighed = X.tf_idf(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("terms"), r(F.max("weight"), "top", 5), r(F.sum("weight"), "total", 3))
    return docs.select("doc_id").distinct().join(weighed, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))


@query(
    "t2_t3_chunks",
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)(#{1,3} )', E'\\1\x01\\2', 'g'), E'\x01') AS parts FROM documents),
    q AS (SELECT doc_id, CASE WHEN parts[1] = '' AND len(parts) > 1 THEN parts[2:] ELSE parts END AS parts FROM p), s AS (SELECT doc_id, unnest(parts) AS part, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS section FROM q),
    h AS (SELECT doc_id, section, trim(regexp_extract(part, '^#{1,3} +([^\n]*)', 1)) AS heading, regexp_replace(regexp_replace(part, '^#{1,3} +[^\n]*\n?', ''), '^\s+|\s+$', '', 'g') AS body FROM s),
    f AS (SELECT doc_id, section, CASE WHEN heading <> '' THEN heading ELSE '(start)' END AS heading, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM h),
    w AS (SELECT doc_id, section, heading, list_reduce(list_transform(ps, lambda x: {'done': CAST([] AS VARCHAR[]), 'now': x}), lambda a, b: CASE WHEN length(a.now) + 1 + length(b.now) > 1100 THEN {'done': list_append(a.done, a.now), 'now': right(a.now, 200) || chr(10) || b.now} ELSE {'done': a.done, 'now': a.now || chr(10) || b.now} END) AS s FROM f WHERE len(ps) > 0),
    c AS (SELECT doc_id, section, heading, list_append(s.done, s.now) AS bodies FROM w)
    SELECT doc_id, section, heading, CAST(generate_subscripts(bodies, 1) - 1 AS INTEGER) AS chunk, unnest(bodies) AS body FROM c""",
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunks(B.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", separator="\n")


@query("l3_extremes", with_player("(SELECT person_id, best FROM (SELECT person_id, max(score) AS best FROM log GROUP BY person_id HAVING max(score) IS NOT NULL) ORDER BY best DESC, person_id LIMIT 3) UNION ALL (SELECT person_id, best FROM (SELECT person_id, max(score) AS best FROM log GROUP BY person_id HAVING max(score) IS NOT NULL) ORDER BY best, person_id LIMIT 3)"))
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = B.player_log(spark, sf_dir).groupBy("person_id").agg(F.max("score").alias("best")).where("best is not null")
    return best.orderBy(F.desc("best"), "person_id").limit(3).unionByName(best.orderBy("best", "person_id").limit(3))


@query("q6_next_event", "SELECT event_id, lead(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS next_material FROM events")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    material = F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id"))
    ahead = W.partitionBy("user_id").orderBy("ts").rowsBetween(1, W.unboundedFollowing)
    return B.table(spark, sf_dir, "events").select("event_id", F.first(material, ignorenulls=True).over(ahead).alias("next_material"))
