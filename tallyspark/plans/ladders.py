"""Model comparisons on game-level rows: the ladder, the market, sweeps, interactions, combinations, weights and form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import boosting as G
from tallyspark.operators import ladder as D
from tallyspark.operators import linear as L
from tallyspark.operators import normality as N
from tallyspark.operators import pairing as P
from tallyspark.operators import statespace as K
from tallyspark.operators import trailing as T
from tallyspark.operators.sparse import kept
from tallyspark.plans.base import ols_sql, query, with_team
from tallyspark.plans.factors import live, r, with_venue
from tallyspark.plans.models import league_games
from tallyspark.sources import boxscores as B

FACTORS = ["efg_d", "oreb_d", "tov_d", "ftmfga_d"]
LEVELS = ["off_efg_pct", "off_orb_pct", "pace"]
CONTEXT = ["rest_diff", "b2b_diff", "miles_diff"]
DIFFS = [f"d_{c}" for c in FACTORS]
LADDER = {"M0": ["seed_diff"], "M1": DIFFS, "M2": [*DIFFS, *CONTEXT], "M3": [*DIFFS, *CONTEXT, "shrunk_form"]}
#: Rows that a season's training and test need.
LEAST = {"least_train": 100, "least_test": 10}


def game_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per game that counts: seeds, trailing factor differences, context, form of both sides, the market's line.

    A ladder reads it several times, so it is cut off from the tables that it is made of.
    """
    rows = T.causal_means(live(spark, sf_dir).where("not is_neutral"), ["season", "team_id"], ["game_date", "game_id"], [*FACTORS, *LEVELS, "margin"], 15, 2)
    way = T.travel(with_venue(spark, sf_dir), ["season", "team_id"], ["game_date", "game_id"]).select("game_id", "team_id", F.least(F.coalesce("rest_days", F.lit(7)), F.lit(7)).alias("rest"), F.col("is_b2b").alias("b2b"), "miles_7d")
    seeds = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), (F.col("s_acctbal") / 1000).alias("seed"))
    before = F.row_number().over(W.partitionBy("season", "team_id").orderBy("game_date", "game_id")) - 1
    rows = rows.withColumn("before", before).join(way, ["game_id", "team_id"]).join(seeds, "team_id")
    sides = ["team_id", "margin", "seed", "rest", "b2b", "miles_7d", "before", "margin_exp", "margin_roll", "margin_var", *[f"{c}_exp" for c in (*FACTORS, *LEVELS)], *[f"{c}_roll" for c in FACTORS]]
    g = P.game_level(rows, sides, include_neutral=False)
    gap = lambda c: F.col(f"home_{c}") - F.col(f"away_{c}")
    margin, number = F.col("home_margin").cast("double"), F.col("game_id").cast("long")
    line = F.when(number % 10 != 3, F.round(0.5 * margin + number % 13 - 6))
    return kept(g.select(
        "game_id", "season", "game_date", margin.alias("margin"), line.alias("line"), F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), F.least("home_before", "away_before").alias("before"),
        gap("seed").alias("seed_diff"), gap("rest").cast("double").alias("rest_diff"), gap("b2b").cast("double").alias("b2b_diff"), (gap("miles_7d") / 1000).alias("miles_diff"),
        *[gap(f"{c}_exp").alias(f"d_{c}") for c in FACTORS], *[gap(f"{c}_roll").alias(f"roll_{c}") for c in FACTORS], *[F.col(f"{s}_{c}_exp").alias(f"{s}_{c}") for s in ("home", "away") for c in LEVELS],
        F.col("home_margin_roll").alias("form_home"), F.col("away_margin_roll").alias("form_away"), F.col("home_margin_var").alias("form_home_var"), F.col("away_margin_var").alias("form_away_var"), F.col("home_margin_exp").alias("base_home"), F.col("away_margin_exp").alias("base_away"),
    ))


@query("m3_ladder")
def m3_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M0 (seed), M1 (four factors), M2 (and context), M3 (and shrunk form) on the same rows of each season."""
    said = D.ladder(game_table(spark, sf_dir), "season", LADDER, "margin", **LEAST)
    return D.judged(D.long_form(said, list(LADDER), ["season", "margin"]), "margin", ["model", "season"])


SEED = "seeded AS (SELECT a.game_id, a.season, CAST(a.margin AS DOUBLE) AS margin, (x.s_acctbal - y.s_acctbal) / 1000 AS d FROM live a JOIN live b ON a.game_id = b.game_id AND a.is_home AND NOT b.is_home JOIN supplier x ON x.s_suppkey = a.team_id JOIN supplier y ON y.s_suppkey = b.team_id WHERE NOT a.is_neutral)"


@query(
    "m3_seed_walk_forward",
    with_team(f", {SEED}, f AS (SELECT t.season, regr_slope(p.margin, p.d) AS s, regr_intercept(p.margin, p.d) AS i FROM (SELECT DISTINCT season FROM seeded) t JOIN seeded p ON p.season < t.season GROUP BY t.season) SELECT season, count(*) AS n, round(avg(abs(margin - i - s * d)), 5) AS mae FROM seeded JOIN f USING (season) GROUP BY season HAVING season > (SELECT DISTINCT season FROM seeded ORDER BY season LIMIT 1 OFFSET 2)"),
)
def seed_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of the ladder by itself: every season from a regression on the seeds of all earlier ones."""
    said = L.walk_forward(game_table(spark, sf_dir).select("season", "margin", "seed_diff"), "season", ["seed_diff"], "margin", 3)
    return said.groupBy("season").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("margin") - F.col("prediction"))), "mae", 5))


@query("m5_market")
def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sets of features against the market's line, on the games that have one, by the size of the line."""
    sets = {"four": DIFFS, "rolling": [f"roll_{c}" for c in FACTORS], "context": LADDER["M2"], "form": LADDER["M3"], "seeded": [*LADDER["M3"], "seed_diff"]}
    said = D.ladder(game_table(spark, sf_dir), "season", sets, "margin", **LEAST).where("line is not null").withColumn("pred_market", F.col("line"))
    bucket = F.when(F.abs("line") < 5, "close").when(F.abs("line") < 15, "middle").otherwise("wide")
    long = D.long_form(said.withColumn("bucket", bucket), [*sets, "market"], ["season", "bucket", "margin", "line"])
    error, theirs = F.abs(F.col("prediction") - F.col("margin")), F.abs(F.col("line") - F.col("margin"))
    return long.groupBy("model", "bucket").agg(F.count("*").alias("n"), F.avg(error).alias("mae"), F.avg(theirs).alias("market_mae"), F.avg((error < theirs).cast("double")).alias("closer"))


@query("m23_matchup")
def matchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether products of both teams' styles help beyond the four factors in seasons not seen: errors in and out of sample."""
    rows = game_table(spark, sf_dir)
    early = rows.where("season < '1995_96'").agg(*[f(f"home_{c}").alias(f"{n}_{c}") for c in LEVELS for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = lambda side, c: (F.col(f"{side}_{c}") - F.lit(early[f"m_{c}"])) / F.lit(early[f"s_{c}"])
    efg, orb, pace = LEVELS
    products = {"h_orb_a_efg": z("home", orb) * z("away", efg), "a_orb_h_efg": z("away", orb) * z("home", efg), "h_orb_a_pace": z("home", orb) * z("away", pace), "a_orb_h_pace": z("away", orb) * z("home", pace), "paces": z("home", pace) * z("away", pace), "pace_gap": F.pow(z("home", pace) - z("away", pace), 2)}
    rows = rows.withColumns(products)
    models = {"additive": DIFFS, "interactions": [*DIFFS, *products]}
    said = D.ladder(rows, "season", models, "margin", **LEAST)
    out = D.judged(D.long_form(said, list(models), ["season", "margin"]), "margin", ["model", "season"]).withColumn("sample", F.lit("later"))
    fitted = rows.where("season < '1995_96'").dropna(subset=[*DIFFS, *products])
    for m, fs in models.items():
        fit = L.fit(fitted, fs, "margin")
        fitted = fitted.withColumns({f"pred_{m}": L.predicted(fit["beta"], fs), f"sd_{m}": F.lit(float(np.sqrt(fit["sigma2"])))})
    own = D.judged(D.long_form(fitted, list(models), ["season", "margin"]), "margin", ["model", "season"]).withColumn("sample", F.lit("own"))
    return out.unionByName(own)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder's predictions and the filter's, on the games that all of them judge."""
    said = D.ladder(game_table(spark, sf_dir), "season", LADDER, "margin", **LEAST)
    filtered = K.team_kalman(league_games(spark, sf_dir), by=("season", "league")).select("game_id", F.col("pred").alias("pred_filter"), F.col("pred_var").alias("filter_var"))
    return said.join(filtered, "game_id").withColumn("sd_filter", F.sqrt("filter_var"))


@query("m25_combinations")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 and the filter by themselves, their mean, weighted by precision, stacked by regression on earlier seasons, and
    the filter as the seed that M3 takes over from as games are played."""
    rows = universe(spark, sf_dir)
    past = W.orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    errors = rows.groupBy("season").agg(F.sum(F.pow(F.col("pred_M3") - F.col("margin"), 2)).alias("e"), F.count("*").alias("k"))
    known = errors.select("season", (F.sum("e").over(past) / F.sum("k").over(past)).alias("mse")).where("mse is not null")  # a row per season
    rows = rows.join(F.broadcast(known), "season")
    w = (1 / F.col("filter_var")) / (1 / F.col("filter_var") + 1 / F.col("mse"))
    share = F.when(F.col("before") > 5, F.col("before") / (F.col("before") + 12.0)).otherwise(0.0)
    rows = rows.withColumns({"pred_mean": (F.col("pred_M3") + F.col("pred_filter")) / 2, "pred_precision": w * F.col("pred_filter") + (1 - w) * F.col("pred_M3"), "pred_filter_as_seed": (1 - share) * F.col("pred_filter") + share * F.col("pred_M3")})
    rows = L.walk_forward(rows, "season", ["pred_M3", "pred_filter"], "margin", 1).withColumnRenamed("prediction", "pred_stacked")
    models = ["M3", "filter", "mean", "precision", "stacked", "filter_as_seed"]
    return D.judged(D.long_form(rows.drop("sd_M3", "sd_filter"), models, ["season", "margin"]), "margin", ["model", "season"])


@query("m25_m36_common_universe")
def common_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder, the filter and the market on identical rows, by season."""
    rows = universe(spark, sf_dir).where("line is not null").withColumn("pred_market", F.col("line"))
    return D.judged(D.long_form(rows, [*LADDER, "filter", "market"], ["season", "margin"]), "margin", ["model", "season"])


ERA = "CASE WHEN season < '1995_96' THEN 'early' ELSE 'late' END"


@query(
    "m31_standardised_by_era",
    with_team(
        f""", g AS (SELECT *, {ERA} AS era FROM live WHERE is_home),
    src AS (SELECT era, [CAST(margin AS DOUBLE), 1.0, {', '.join(f'({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0)' for c in FACTORS)}] AS x FROM g WINDOW w AS (PARTITION BY era)),
    whole AS (SELECT * FROM src WHERE len(list_filter(x, lambda v: v IS NULL)) = 0), {ols_sql("whole", "era", FACTORS)} SELECT era, factor, round(beta, 4) AS beta, round(se, 4) AS se, n FROM ols"""
    ),
)
def standardised_by_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin on all four standardised factor differences, with standard errors, era by era."""
    rows = live(spark, sf_dir).where("is_home").withColumn("era", F.expr(ERA))
    means = rows.groupBy("era").agg(*[f(c).alias(f"{n}_{c}") for c in FACTORS for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    standard = rows.join(F.broadcast(means), "era").select("era", "margin", *[E.ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias(c) for c in FACTORS])  # a row per era
    out = []
    for block in L.gram(standard, FACTORS, "margin", by=["era"]).collect():
        fit = L.solve(block, len(FACTORS))
        out += [(block["era"], name, round(float(b), 4), round(float(s), 4), fit["n"]) for name, b, s in zip(["intercept", *FACTORS], fit["beta"], fit["se"], strict=True)]
    return spark.createDataFrame(out, "era string, factor string, beta double, se double, n long")


@query(
    "m15_accounting_weights",
    with_team(
        f""", g AS (SELECT season, [CAST(margin AS DOUBLE), 1.0, {', '.join(FACTORS)}] AS x FROM live WHERE is_home AND {' AND '.join(f'{c} IS NOT NULL' for c in FACTORS)}),
    src AS (SELECT t.season, x FROM (SELECT DISTINCT season FROM g) t JOIN g p ON p.season < t.season), {ols_sql("src", "season", FACTORS)}
    SELECT season, factor, round(beta, 3) AS weight, round(se, 3) AS se, n FROM ols WHERE n > 6"""
    ),
)
def accounting_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per unit of each factor difference, for every season from a regression on all seasons before it."""
    blocks = sorted(L.gram(live(spark, sf_dir).where("is_home"), FACTORS, "margin", by=["season"]).collect(), key=lambda b: b["season"])
    seen: dict[str, float] = {}
    out = []
    for block in blocks:
        if seen and seen["n"] > len(FACTORS) + 2:
            fit = L.solve(seen, len(FACTORS))
            out += [(block["season"], name, round(float(b), 3), round(float(s), 3), int(seen["n"])) for name, b, s in zip(["intercept", *FACTORS], fit["beta"], fit["se"], strict=True)]
        values = {k: float(v or 0.0) for k, v in block.asDict().items() if k != "season"}
        seen = {k: seen.get(k, 0.0) + v for k, v in values.items()}
    return spark.createDataFrame(out, "season string, factor string, weight double, se double, n long")


@query(
    "m16_pass_through",
    with_team(""", t AS (SELECT team_id, CAST(left(season, 4) AS INTEGER) AS y, avg(off_orb_pct) AS rate, CAST(count(*) AS DOUBLE) AS w FROM live GROUP BY team_id, season),
    p AS (SELECT 'persistence' AS level, b.rate AS x, a.rate AS y, a.w FROM t a JOIN t b ON a.team_id = b.team_id AND b.y = a.y - 1 WHERE a.rate IS NOT NULL AND b.rate IS NOT NULL
        UNION ALL SELECT 'game', oreb_d, CAST(margin AS DOUBLE), 1.0 FROM live WHERE is_home AND oreb_d IS NOT NULL),
    s AS (SELECT level, count(*) AS n, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM p GROUP BY level),
    b AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM s)
    SELECT level, round(slope, 5) AS slope, round(sqrt(greatest(yy - (y - slope * x) / w * y - slope * xy, 0) / (n - 2) * w / (w * xx - x * x)), 5) AS se, n FROM b"""),
)
def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far offensive rebounding persists: a team's season on its last (weighted by games), and a game's margin on it."""
    seasons = live(spark, sf_dir).groupBy("team_id", "season").agg(F.avg("off_orb_pct").alias("rate"), F.count("*").cast("double").alias("games")).withColumn("y", E.season_start("season"))
    last = seasons.select("team_id", (F.col("y") + 1).alias("y"), F.col("rate").alias("last"))
    fits = [("persistence", L.fit(seasons.join(last.hint("merge"), ["team_id", "y"]), ["last"], "rate", "games")), ("game", L.fit(live(spark, sf_dir).where("is_home"), ["oreb_d"], "margin"))]
    return spark.createDataFrame([(name, round(float(f["beta"][1]), 5), round(float(f["se"][1]), 5), int(f["n"])) for name, f in fits], "level string, slope double, se double, n long")


@query("m26_design_gaps")
def design_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each choice of design is worth: attempts or makes for the fourth factor, recent or whole seasons, with pace,
    with form; each against the four factors as they are, on the same rows."""
    rows = live(spark, sf_dir).where("not is_neutral")
    more = P.game_level(T.causal_means(rows, ["season", "team_id"], ["game_date", "game_id"], ["ftr_d", "pace"], 15, 2), ["ftr_d_exp", "pace_exp"], include_neutral=False)
    table = game_table(spark, sf_dir).join(more.select("game_id", (F.col("home_ftr_d_exp") - F.col("away_ftr_d_exp")).alias("d_ftr_d"), (F.col("home_pace_exp") - F.col("away_pace_exp")).alias("pace_diff")).hint("merge"), "game_id")
    models = {"as_is": DIFFS, "attempts": [*DIFFS[:3], "d_ftr_d"], "recent": [f"roll_{c}" for c in FACTORS], "pace": [*DIFFS, "pace_diff"], "form": [*DIFFS, "shrunk_form"]}
    out = D.judged(D.long_form(D.ladder(table, "season", models, "margin", **LEAST), list(models), ["season", "margin"]), "margin", ["model", "season"])
    return out.withColumn("gain", F.max(F.when(F.col("model") == "as_is", F.col("mae"))).over(W.partitionBy("season")) - F.col("mae")).select("model", "season", "n", "mae", "gain")


HALF_LIVES = (2, 5, 10, 20)


@query(
    "m28_half_lives",
    with_team(""", held AS (SELECT *, coalesce(list(CAST(margin AS DOUBLE)) OVER (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS past FROM live WHERE NOT is_neutral),
    formed AS (SELECT game_id, season, is_home, CAST(margin AS DOUBLE) AS margin, h, list_sum(list_transform(range(1, len(past) + 1), lambda i: past[len(past) + 1 - i] * power(0.5, (i - 1.0) / h))) / list_sum(list_transform(range(1, len(past) + 1), lambda i: power(0.5, (i - 1.0) / h))) AS form
        FROM held, (VALUES (2), (5), (10), (20)) AS t(h) WHERE len(past) >= 2),
    x AS (SELECT a.season, a.h, a.margin, a.form - b.form AS x FROM formed a JOIN formed b ON a.game_id = b.game_id AND a.h = b.h AND a.is_home AND NOT b.is_home),
    numbered AS (SELECT season, row_number() OVER (ORDER BY season) AS k FROM (SELECT DISTINCT season FROM x)),
    fits AS (SELECT n.season, p.h, regr_slope(p.margin, p.x) AS s, regr_intercept(p.margin, p.x) AS i FROM numbered n JOIN x p ON p.season < n.season WHERE k > 2 GROUP BY n.season, p.h HAVING count(*) >= 3),
    judged AS (SELECT season, h, count(*) AS n, avg(abs(margin - i - s * x)) AS mae FROM x JOIN fits USING (season, h) GROUP BY season, h),
    lagged AS (SELECT *, lag(mae) OVER (PARTITION BY h ORDER BY season) AS before FROM judged)
    SELECT season, h AS half_life, n, round(before, 6) AS "inner", round(mae, 6) AS mae FROM lagged WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY season ORDER BY before, h) = 1"""),
)
def half_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form that fades with a half-life of 2 to 20 games: for each season, the half-life that did best in the one before it,
    fitted on those before that, and its error in the season."""
    rows = live(spark, sf_dir).where("not is_neutral").withColumn("m", F.col("margin").cast("double"))
    keys, order = ["season", "team_id"], ["game_date", "game_id"]
    formed = rows
    for h in HALF_LIVES:
        formed = T.weighted_form(formed, keys, order, "m", 0.5 ** (1 / h), 20, 2).withColumnRenamed("form", f"form_{h}")
    g = P.game_level(formed, ["margin", *[f"form_{h}" for h in HALF_LIVES]], include_neutral=False)
    table = g.select("season", "game_id", F.col("home_margin").cast("double").alias("margin"), *[(F.col(f"home_form_{h}") - F.col(f"away_form_{h}")).alias(f"x{h}") for h in HALF_LIVES]).dropna()
    said = D.each_alone(table, "season", [f"x{h}" for h in HALF_LIVES], "margin", 2).select("season", F.substring("model", 2, 9).cast("int").alias("half_life"), F.abs(F.col("prediction") - F.col("margin")).alias("e"))
    said = said.groupBy("season", "half_life").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
    before = F.lag("mae").over(W.partitionBy("half_life").orderBy("season"))
    best = F.row_number().over(W.partitionBy("season").orderBy("inner", "half_life"))
    return said.withColumn("inner", before).where("inner is not null").withColumn("_b", best).where("_b = 1").select("season", "half_life", "n", r("inner"), r("mae"))


@query("m29_filter_skill")
def filter_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The player filter beside the last 10 games' mean and the career mean: error, skill over the noise floor, and how
    often a value falls within one and two deviations of what the filter foresaw."""
    log = B.player_log(spark, sf_dir).where("score is not null").groupBy("person_id", "game_date").agg(F.avg("score").alias("score"), F.sum("minutes").cast("double").alias("minutes"))
    noise = 3.5e7
    said = K.ou_filter(log, "person_id", "game_date", "score", "minutes", 0.02, 0.9e6, noise, 2000.0)
    w = W.partitionBy("person_id").orderBy("game_date")
    rows = said.withColumns({"last": F.avg("score").over(w.rowsBetween(-10, -1)), "career": F.avg("score").over(w.rowsBetween(W.unboundedPreceding, -1)), "sd": F.sqrt(F.col("pred_var") + noise / F.col("minutes")), "week": F.date_trunc("week", "game_date").cast("date").cast("string")}).where("last is not null")
    z = F.abs(F.col("score") - F.col("pred")) / F.col("sd")
    error = lambda c: F.avg(F.pow(F.col(c) - F.col("score"), 2))
    out = rows.groupBy("week").agg(F.count("*").alias("n"), error("pred").alias("filter"), error("last").alias("last"), error("career").alias("career"), F.avg(noise / F.col("minutes")).alias("floor"), F.avg((z < 1).cast("double")).alias("within_1"), F.avg((z < 2).cast("double")).alias("within_2"))
    skill = lambda c: 1 - E.ratio(F.col(c) - F.col("floor"), F.col("career") - F.col("floor"))
    return out.select("week", "n", *[F.sqrt(c).alias(f"rmse_{c}") for c in ("filter", "last", "career")], skill("filter").alias("filter_skill"), skill("last").alias("last_skill"), "within_1", "within_2")


@query("m19_boosting")
def boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for the margin and for the chance of a win, on 14 features of earlier seasons, judged on later ones.

    Early games have no trailing features; the trees learn where such rows go. A tenth of the earlier games tells when to
    stop. log_loss is that of the chances, market_mae that of the line where there is one.
    """
    names = ["seed_diff", *DIFFS, *[f"roll_{c}" for c in FACTORS], *CONTEXT, "form_home", "form_away"]
    rows = game_table(spark, sf_dir).select("season", "game_id", "margin", "line", (F.col("margin") > 0).cast("double").alias("won"), *names, (F.crc32("game_id") % 10 == 0).alias("held"))
    early, late = rows.where("season < '1996_97'"), rows.where("season >= '1996_97'")
    options = {"trees": 12, "depth": 3, "rate": 0.2, "least": 20, "held": "held", "patience": 4}
    late = G.fit(early, names, "margin", **options).predict(late, "margin_said")
    late = G.fit(early, names, "won", logistic=True, **options).predict(late, "chance")
    p = F.least(F.greatest("chance", F.lit(1e-6)), F.lit(1 - 1e-6))
    return late.groupBy("season").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("margin") - F.col("margin_said"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("margin") - F.col("margin_said"), F.lit(2)))).alias("rmse"),
        F.avg(-(F.col("won") * F.log(p) + (1 - F.col("won")) * F.log(1 - p))).alias("log_loss"), F.avg(F.abs(F.col("margin") - F.col("line"))).alias("market_mae"),
    )


def without(k: int, last: str, now: str) -> str:
    """SQL that holds variable `k` of correlations `last` (season, i, j, r) fixed."""
    return f"{now} AS (SELECT a.season, a.i, a.j, (a.r - p.r * q.r) / sqrt((1 - p.r * p.r) * (1 - q.r * q.r)) AS r FROM {last} a JOIN {last} p ON p.season = a.season AND p.i = a.i AND p.j = {k} JOIN {last} q ON q.season = a.season AND q.i = a.j AND q.j = {k} WHERE a.i < {k} AND a.j < {k})"


@query(
    "g20_partial_correlations",
    with_team(f""", v AS (SELECT season, [CAST(margin AS DOUBLE), efg_d, tov_d, oreb_d, ftmfga_d] AS x FROM live WHERE efg_d IS NOT NULL AND tov_d IS NOT NULL AND oreb_d IS NOT NULL AND ftmfga_d IS NOT NULL),
    c0 AS (SELECT season, i, j, corr(x[i], x[j]) AS r, count(*) AS n FROM v, range(1, 6) AS a(i), range(1, 6) AS b(j) GROUP BY season, i, j),
    {without(5, "c0", "c1")}, {without(4, "c1", "c2")}, {without(3, "c2", "c3")}
    SELECT c3.season, n, round(c3.r, 6) AS partial FROM c3 JOIN c0 ON c0.season = c3.season AND c0.i = 1 AND c0.j = 2 WHERE c3.i = 1 AND c3.j = 2"""),
)
def partial_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin and effective shooting with turnovers, rebounds and free throws held fixed, by season."""
    return D.partial_correlations(live(spark, sf_dir), "margin", "efg_d", ["tov_d", "oreb_d", "ftmfga_d"], ["season"]).select("season", "n", r("partial"))


@query(
    "g21_normality",
    with_team("SELECT season, count(*) AS n, round(count(*) / 6.0 * (power(skew, 2) + power(kurt, 2) / 4), 3) AS jarque_bera FROM (SELECT season, z, avg(z * z * z) OVER (PARTITION BY season) AS skew, avg(z * z * z * z) OVER (PARTITION BY season) - 3 AS kurt FROM (SELECT season, (margin - avg(margin) OVER w) / nullif(stddev_pop(margin) OVER w, 0) AS z FROM (SELECT season, CAST(margin AS DOUBLE) AS margin FROM live WHERE is_home) WINDOW w AS (PARTITION BY season))) GROUP BY season, skew, kurt"),
)
def normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jarque and Bera's statistic of the margins, by season: from skewness and kurtosis, so one aggregate does."""
    rows = live(spark, sf_dir).where("is_home").groupBy("season").agg(F.count("*").alias("n"), F.skewness("margin").alias("s"), F.kurtosis("margin").alias("k"))
    return rows.select("season", "n", r(F.col("n") / 6 * (F.pow("s", F.lit(2)) + F.pow("k", F.lit(2)) / 4), "jarque_bera", 3))


@query(
    "g21_anderson_darling",
    with_team(""", x AS (SELECT season, CAST(margin AS DOUBLE) AS v, count(*) AS m FROM live WHERE is_home GROUP BY ALL),
    g AS (SELECT season, sum(m) AS n, sum(m * v) / sum(m) AS mean FROM x GROUP BY season),
    s AS (SELECT season, sqrt(sum(m * (v - mean) * (v - mean)) / (min(n) - 1)) AS sd FROM x JOIN g USING (season) GROUP BY season HAVING sum(m * (v - mean) * (v - mean)) > 0),
    z AS (SELECT season, m, n, mean, sd, (v - mean) / sd AS z, sum(m) OVER (PARTITION BY season ORDER BY v) - m AS a FROM x JOIN g USING (season) JOIN s USING (season)),
    t AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: CASE WHEN z = 0 THEN 0.0 ELSE exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) END)) AS half FROM z),
    p AS (SELECT *, 0.5 + sign(z) * half AS below, 0.5 - sign(z) * half AS above FROM t)
    SELECT season, CAST(min(n) AS BIGINT) AS n, round(min(mean), 6) AS mean, round(min(sd), 6) AS sd, round(-min(n) - sum(m * (2 * a + m) * ln(below) + m * (2 * n - 2 * a - m) * ln(above)) / min(n), 4) AS anderson,
           round(0.787 / (1 + 4.0 / min(n) - 25.0 / (min(n) * min(n))), 3) AS anderson_5
    FROM p GROUP BY season HAVING min(n) >= 8"""),
)
def anderson_darling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anderson and Darling's statistic of the margins by season, with its 5 % point."""
    rows = N.normality(live(spark, sf_dir).where("is_home"), ["season"], "margin").where("anderson is not null")
    return rows.select("season", "n", r("mean", places=6), r("sd", places=6), r("anderson", places=4), "anderson_5")


@query("g21_shapiro_wilk")
def shapiro_wilk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro and Wilk's statistic of each team's winning share, by season, and its p-value."""
    shares = live(spark, sf_dir).groupBy("season", "team_id").agg(F.avg((F.col("margin") > 0).cast("double")).alias("share"))
    return N.normality(shares, ["season"], "share").select("season", "n", "shapiro_w", "shapiro_p")


@query("m17_shot_quality")
def shot_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of a make by a constant, by zone, by a logistic regression and by boosted trees, from the shots before a
    day and judged on those after: log-loss, Brier score, and the calibration error over 20 bins of the chance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tallyspark.plans.scalars import shots

    names = ["d", "d2", "is_three", "is_rim"]
    rows = shots(spark, sf_dir).select("event_id", F.col("ts").cast("date").alias("day"), "zone", F.col("made").cast("double").alias("made"), F.col("d").cast("double").alias("d"), (F.col("d") * F.col("d")).cast("double").alias("d2"), F.col("three").cast("double").alias("is_three"), (F.col("zone") == "rim").cast("double").alias("is_rim"))
    train, test = rows.where("day < date'2024-01-20'"), rows.where("day >= date'2024-01-20'")
    zones = train.groupBy("zone").agg(F.avg("made").alias("p_zone"))
    test = test.crossJoin(F.broadcast(train.agg(F.avg("made").alias("p_constant")))).join(F.broadcast(zones), "zone")  # one row; a row per zone
    for name, model in (("logistic", LogisticRegression(featuresCol="x", labelCol="made", regParam=1e-3)), ("trees", GBTClassifier(featuresCol="x", labelCol="made", maxIter=8, maxDepth=3, seed=5))):
        fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), model]).fit(train)
        test = fitted.transform(test).withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    arms = ("constant", "zone", "logistic", "trees")
    long = test.select("made", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.least(F.greatest(F.col(f"p_{m}"), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p")) for m in arms])).alias("m")).select("made", "m.*")
    bins = long.groupBy("model", F.floor(F.col("p") * 20).alias("bin")).agg(F.count("*").alias("k"), F.abs(F.avg("p") - F.avg("made")).alias("gap"), F.sum(-(F.col("made") * F.log("p") + (1 - F.col("made")) * F.log(1 - F.col("p")))).alias("loss"), F.sum(F.pow(F.col("p") - F.col("made"), 2)).alias("brier"))
    share = lambda c: F.sum(c) / F.sum("k")
    return bins.groupBy("model").agg(F.sum("k").alias("n"), share("loss").alias("log_loss"), share("brier").alias("brier"), share(F.col("gap") * F.col("k")).alias("calibration"))
