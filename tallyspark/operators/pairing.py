"""Team-game rows and their opponents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E

COUNTS = ["fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "tov", "pts"]


def with_opponent(teams: DataFrame, counts: list[str] = COUNTS, game: str = "game_id", team: str = "team_id", names: tuple[str, ...] = ()) -> DataFrame:
    """Each row of a two-row game beside the other: `opp_` columns. One shuffle by game; a game of any other size raises.

    The count that the check needs and the other row come from windows over the same partitioning.
    """
    carried = [team, *names, *counts]
    both = W.partitionBy(game).orderBy(team).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    other = W.partitionBy(game).orderBy(team)
    sized = teams.withColumn("_n", F.count("*").over(both))
    bad = F.raise_error(F.concat(F.lit("game without exactly two rows: "), F.col(game).cast("string")))
    pick = lambda c: F.when(F.col("_n") == 2, F.coalesce(F.lead(c).over(other), F.lag(c).over(other))).otherwise(bad.cast(teams.schema[c].dataType))
    return sized.withColumns({f"opp_{c}": pick(c) for c in carried}).drop("_n")


def with_factors(paired: DataFrame) -> DataFrame:
    return paired.withColumns(E.four_factors())


def differentials(paired: DataFrame) -> DataFrame:
    """Factor differences of a row with factors (turnovers with the sign that more is better), and the game's pace."""
    d = lambda k: F.col(f"off_{k}") - F.col(f"def_{k}")
    made = {"efg_d": d("efg_pct"), "oreb_d": d("orb_pct"), "tov_d": -d("tov_pct"), "ftr_d": d("ft_rate")}
    made["ftmfga_d"] = E.ratio("ftm", "fga") - E.ratio("opp_ftm", "opp_fga")
    made["pace"] = (E.possessions() + E.possessions("opp_")) / 2
    return paired.withColumns(made)


def composite(df: DataFrame, weights: dict[str, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """The weighted sum of z-scores (population deviation) over all rows, or within `by`, as `composite`."""
    weights = weights or {"efg_d": 0.40, "tov_d": 0.25, "oreb_d": 0.20, "ftr_d": 0.15}
    stats = [f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if by:
        joined = df.join(df.groupBy(*by).agg(*stats), by)
    else:  # one row, so it is broadcast whatever the size of df
        joined = df.crossJoin(F.broadcast(df.agg(*stats)))
    total = sum((w * E.ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c, w in weights.items()), F.lit(0.0))
    return joined.withColumn("composite", total).select(*df.columns, "composite")


def game_level(teams: DataFrame, columns: list[str], include_neutral: bool = True) -> DataFrame:
    """One row per game: home_ and away_ columns. In a neutral game, the first team by abbreviation stands as home."""
    rows = teams if include_neutral else teams.where(~F.col("is_neutral"))
    first = F.row_number().over(W.partitionBy("game_id").orderBy(F.desc("is_home"), "team_abbr", "team_id"))
    sided = rows.withColumn("_home", first == 1)
    side = lambda c, home: F.max(F.when(F.col("_home") == F.lit(home), F.col(c)))
    made = [side(c, home).alias(f"{name}_{c}") for home, name in ((True, "home"), (False, "away")) for c in columns]
    return sided.groupBy("game_id", "game_date", "season", "is_neutral").agg(*made)


def without_canceled(teams: DataFrame) -> DataFrame:
    """Drop 0-0 games."""
    return teams.where(~((F.col("pts") == 0) & (F.col("opp_pts") == 0)))
