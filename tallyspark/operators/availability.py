"""What the players who sit out are worth: as-of values of absences, summed by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators.asof import asof

PLAYER = ["person_id", "season"]


def running(log: DataFrame, value: str, by: list[str], order: list[str], k: float = 0.0, toward: float | Column = 0.0) -> DataFrame:
    """Played rows with `n` and `mean`: the value's mean up to and including the row, shrunk by k rows worth `toward`."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = log.where(F.col(value).isNotNull())
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return rows.withColumns({"n": n, "mean": (total + F.lit(k) * toward) / (n + F.lit(k))})


def valued_absences(log: DataFrame, absent: Column, value: str, time: str, k: float = 0.0) -> DataFrame:
    """Absent rows with `value_asof`: the player's shrunk mean strictly before, else last season's mean, else 0."""
    means = running(log, value, PLAYER, [time], k).select(*PLAYER, time, "mean")
    found = asof(log.where(absent), means, PLAYER, time, ["mean"])
    last = log.where(F.col(value).isNotNull()).groupBy("person_id", E.season_shift("season", 1).alias("season")).agg(F.avg(value).alias("_last"))
    out = found.join(last, PLAYER, "left")
    return out.withColumn("value_asof", F.coalesce("mean", "_last", F.lit(0.0))).drop("mean", "_last")


def side_difference(valued: DataFrame, group: list[str], value: str) -> DataFrame:
    """home_out, away_out and diff (home minus away) of the values by group; a side without absences is 0."""
    side = lambda home: F.coalesce(F.sum(F.when(F.col("is_home") == F.lit(home), F.col(value))), F.lit(0.0))
    return valued.groupBy(*group).agg(side(True).alias("home_out"), side(False).alias("away_out")).withColumn("diff", F.col("home_out") - F.col("away_out"))


def depletion(rows: DataFrame, group: list[str], value: str, available: Column, top: int = 9, tie: str = "person_id") -> DataFrame:
    """full minus present: the sums of the `top` values of everyone and of those available."""
    every = F.row_number().over(W.partitionBy(*group).orderBy(F.desc_nulls_last(value), tie))
    flagged = rows.withColumn("_here", available)
    here = F.row_number().over(W.partitionBy(*group, "_here").orderBy(F.desc_nulls_last(value), tie))
    ranked = flagged.withColumns({"_every": every, "_among": here})
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))
    out = ranked.groupBy(*group).agg(part(F.col("_every") <= top).alias("full"), part(F.col("_here") & (F.col("_among") <= top)).alias("present"))
    return out.withColumn("depletion", F.col("full") - F.col("present"))


def absent_not_listed(inactive: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return inactive.join(listed, on, "left_anti")


def player_seasons(log: DataFrame) -> DataFrame:
    """Minutes, games, main team (most minutes, then the smaller id), minutes per game and seasons before."""
    per_team = log.groupBy("person_id", "season", "team_id").agg(F.sum("minutes").alias("m"), F.count("minutes").alias("g"))
    out = per_team.groupBy("person_id", "season").agg(F.sum("m").alias("minutes"), F.sum("g").alias("gp"), F.max_by("team_id", F.struct(F.coalesce("m", F.lit(0)), -F.col("team_id"))).alias("main_team"))
    prior = F.row_number().over(W.partitionBy("person_id").orderBy("season")) - 1
    return out.withColumns({"mpg": E.ratio("minutes", "gp"), "n_prior": prior})


def opening_roster(log: DataFrame, order: list[str]) -> DataFrame:
    """Who is with a team in its first game of a season; one row per person, played rows before absences."""
    first = log.groupBy("season", "team_id").agg(F.min("game_date").alias("game_date"))
    rows = log.join(first, ["season", "team_id", "game_date"], "left_semi")
    w = W.partitionBy("season", "team_id", "person_id").orderBy((F.col("status") != "played").cast("int"), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
