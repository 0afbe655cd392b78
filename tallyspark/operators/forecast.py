"""Forecasts that blend a prior with what a season has shown, market ratings and preseason projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import linear as L
from tallyspark.operators.sparse import solved

#: The unknown of the home term beside the teams'.
HOME = -(1 << 62)


def blend(prior: str | Column, current: str | Column, n: str | Column, k: float | Column) -> Column:
    """(1 - a) prior + a current with a = n / (n + k); where there is no current value, the prior alone."""
    p, c, games = E.col(prior), E.col(current), E.col(n)
    a = F.when(c.isNull(), 0.0).otherwise(games / (games + (F.lit(k) if isinstance(k, (int, float)) else k)))
    return (1 - a) * p + a * F.coalesce(c, F.lit(0.0))


def linear_blend(prior: str | Column, current: str | Column, n: str | Column, full: float = 20.0) -> Column:
    """As blend, with a growing in proportion until `full` games."""
    a = F.when(E.col(current).isNull(), 0.0).otherwise(F.least(E.col(n) / full, F.lit(1.0)))
    return (1 - a) * E.col(prior) + a * F.coalesce(E.col(current), F.lit(0.0))


def prior_strength(train: DataFrame, entity: list[str], value: str) -> DataFrame:
    """k: game variance within entities over the variance of their means, from 1 to 60. One row."""
    per = train.groupBy(*entity).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return per.agg(F.least(F.greatest(E.ratio(F.avg("v"), F.var_pop("m")), F.lit(1.0)), F.lit(60.0)).alias("k"))


def frozen_forecasts(games: DataFrame, ratings: DataFrame, at: list[int], home: float, sigma: float) -> DataFrame:
    """Season wins seen after X games, for every X: wins banked plus the chances of the rest with ratings of that moment.

    games: season, game_id, game_date, team_id, opp_team_id, is_home, margin (two rows a game). ratings: season, team_id,
    game_number, rating after it. Returns season, team_id, x, banked, expected. A team with fewer games keeps its last rating.
    """
    w = W.partitionBy("season", "team_id").orderBy("game_date", "game_id")
    numbered = games.withColumn("n", F.row_number().over(w))
    xs = F.explode(F.array(*map(F.lit, at))).alias("x")
    frozen = ratings.select("season", "team_id", "game_number", "rating", xs).where("game_number <= x").groupBy("season", "team_id", "x").agg(F.max_by("rating", "game_number").alias("rating"))
    every = numbered.select("season", "team_id", "opp_team_id", "is_home", "margin", "n", xs)
    own = every.join(frozen, ["season", "team_id", "x"], "left")
    other = frozen.select("season", F.col("team_id").alias("opp_team_id"), "x", F.col("rating").alias("theirs"))
    rows = own.join(other, ["season", "opp_team_id", "x"], "left")
    edge = F.coalesce("rating", F.lit(0.0)) - F.coalesce("theirs", F.lit(0.0)) + F.when(F.col("is_home"), home).otherwise(-home)
    done = F.col("n") <= F.col("x")
    return rows.groupBy("season", "team_id", "x").agg(F.sum(F.when(done, (F.col("margin") > 0).cast("double")).otherwise(0.0)).alias("banked"), F.sum(F.when(done, (F.col("margin") > 0).cast("double")).otherwise(E.win_probability(edge, sigma))).alias("expected"))


def market_ratings(lines: DataFrame, ridge: float = 1.0, small: int = 2000) -> DataFrame:
    """team_id and rating implied by lines (home_id, away_id, line): ridge least squares, the home term free.

    The normal equations are sums per pair of teams that met. They are solved where they lie (see sparse.solved).
    """
    met = lines.where("line is not null").groupBy("home_id", "away_id").agg(F.count("*").cast("double").alias("n"), F.sum("line").cast("double").alias("s"))
    entry = lambda team, sign: F.struct(team.cast("long").alias("c"), F.lit(sign).alias("v"))
    own = F.array(entry(F.col("home_id"), 1.0), entry(F.col("away_id"), -1.0), F.struct(F.lit(HOME).alias("c"), F.lit(1.0).alias("v")))
    cells = met.select("n", "s", own.alias("x"))
    gram = cells.select("n", F.explode("x").alias("a"), "x").select("n", "a", F.explode("x").alias("b")).groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("n") * F.col("a.v") * F.col("b.v")).alias("g"))
    right = cells.select("s", F.explode("x").alias("a")).groupBy(F.col("a.c").alias("i")).agg(F.sum(F.col("s") * F.col("a.v")).alias("b"))
    penalty = F.when(F.col("i") == HOME, 0.0).otherwise(float(ridge))
    return solved(gram, right.withColumn("penalty", penalty), small=small).where(F.col("i") != HOME).select(F.col("i").alias("team_id"), F.col("x").alias("rating"))


def project_minutes(players: DataFrame, share: str, team: list[str], cap: float = 38.0) -> DataFrame:
    """`share` of each team brought to a total of 5, no one above cap / 48; what is cut off goes to the others once more."""
    total = F.sum(share).over(W.partitionBy(*team))
    first = players.withColumn("_s", F.least(5 * F.col(share) / total, F.lit(cap / 48)))
    open_ = F.when(F.col("_s") < cap / 48, F.col("_s")).otherwise(0.0)
    spare = 5 - F.sum("_s").over(W.partitionBy(*team))
    grown = F.col("_s") + F.coalesce(E.ratio(open_, F.sum(open_).over(W.partitionBy(*team))), F.lit(0.0)) * spare
    return first.withColumn("minutes_share", grown).drop("_s")


def age_pairs(bios: DataFrame, seasons: DataFrame) -> DataFrame:
    """Players' seasons with last season's values (`_p` and, two back, `_p2`) by two equi-joins on shifted seasons."""
    back = lambda years, mark: seasons.select("person_id", E.season_shift("season", years).alias("season"), F.col("v").alias(f"v{mark}"), F.col("mpg").alias(f"mpg{mark}"))
    out = seasons.join(back(1, "_p"), ["person_id", "season"], "left").join(back(2, "_p2"), ["person_id", "season"], "left").join(bios, "person_id", "left")
    median = F.median("age").over(W.partitionBy("season"))
    return out.withColumns({"rookie": F.col("v_p").isNull().cast("int"), "age": F.coalesce("age", median)})


def project_values(frame: DataFrame, season: str, features: list[str], target: str, burn_in: int = 2) -> DataFrame:
    """Each season's target predicted from all earlier seasons; features without a value count as 0."""
    return L.walk_forward(frame.na.fill(0.0, features), season, features, target, burn_in)


def paired_test(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, mean difference and t of paired values."""
    d = F.col(a) - F.col(b)
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), E.ratio(F.avg(d) * F.sqrt(F.count(d)), F.stddev_samp(d)).alias("t"))


def bootstrap_mean(rows: DataFrame, value: str, key: str, times: int = 200) -> DataFrame:
    """Mean, and its 2.5 % and 97.5 % points over Poisson resamples: weights drawn from a hash, so one aggregate suffices."""
    # the inverse of the distribution of mean 1, to the last term that 30 bits can tell from 1
    terms = [math.exp(-1) / math.factorial(k) for k in range(14)]
    poisson = lambda x: sum(((x >= sum(terms[: k + 1])).cast("int") for k in range(13)), F.lit(0))
    draws = rows.select(value, key, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("i")).withColumn("w", poisson((F.pmod(F.xxhash64(key, "i"), F.lit(1 << 30)) + 0.5) / (1 << 30)))
    means = draws.groupBy("i").agg(E.ratio(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    points = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(points).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))  # a row each


def logistic(rows: DataFrame, features: list[str], label: str, c: float = 1.0):
    """A fitted MLlib pipeline: standardised features, L2 with strength 1 / (c n), free intercept."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    held = rows.dropna(subset=[*features, label]).select(*features, F.col(label).cast("double").alias(label))
    n = held.count()
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False)]
    return Pipeline(stages=stages).fit(held)
