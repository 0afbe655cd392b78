"""Trailing features that never see the row they describe, unless they say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E


def at_least(value: Column, counted: str | Column, frame: WindowSpec, least: int) -> Column:
    """`value`, null until the frame holds `least` rows where `counted` isn't null."""
    return F.when(F.count(counted).over(frame) >= least, value)


def causal_means(df: DataFrame, by: list[str], order: list[str], values: list[str], window: int = 15, least: int = 5) -> DataFrame:
    """For each value: `_exp` the mean of all earlier rows, `_roll` and `_var` mean and sample variance of the last ones."""
    w = W.partitionBy(*by).orderBy(*order)
    before, near = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(-window, -1)
    made = {}
    for v in values:
        made[f"{v}_exp"] = F.avg(v).over(before)
        made[f"{v}_roll"] = at_least(F.avg(v).over(near), v, near, least)
        made[f"{v}_var"] = at_least(F.var_samp(v).over(near), v, near, least)
    return df.withColumns(made)


def full_window_mean(value: str, frame: WindowSpec, size: int) -> Column:
    return F.when(F.count(value).over(frame) == size, F.avg(value).over(frame))


def travel(df: DataFrame, by: list[str], order: list[str], date: str = "game_date", lat: str = "lat", lon: str = "lon", offset: str = "utc") -> DataFrame:
    """rest_days, is_b2b, leg_miles, tz_shift, is_opener and miles_7d (this leg and those of the 6 days before)."""
    w = W.partitionBy(*by).orderBy(*order)
    past = lambda c: F.lag(c).over(w)
    leg = F.coalesce(E.haversine(past(lat), past(lon), F.col(lat), F.col(lon)), F.lit(0.0))
    made = df.withColumns({"rest_days": F.datediff(F.col(date), past(date)), "leg_miles": leg, "tz_shift": F.coalesce(F.col(offset) - past(offset), F.lit(0))})
    made = made.withColumns({"is_b2b": F.coalesce((F.col("rest_days") == 1).cast("int"), F.lit(0)), "is_opener": F.col("rest_days").isNull().cast("int")})
    days = F.datediff(F.col(date), F.lit("1970-01-01"))
    week = W.partitionBy(*by).orderBy(days).rangeBetween(-6, 0)
    return made.withColumn("miles_7d", F.sum("leg_miles").over(week))


def signed_streak(df: DataFrame, by: list[str], order: list[str], flag: str, out: str) -> DataFrame:
    """The length of the run of equal flags up to this row, negative where the flag is false."""
    w = W.partitionBy(*by).orderBy(*order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    island = df.withColumn("_change", change).withColumn("_island", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.row_number().over(W.partitionBy(*by, "_island").orderBy(*order))
    return island.withColumn(out, F.when(F.col(flag), run).otherwise(-run)).drop("_change", "_island")


def missed_streak(df: DataFrame, by: list[str], order: list[str], played: str, out: str) -> DataFrame:
    """How many rows in a row before this one were not played; null before the first played one."""
    w = W.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col(played), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    return numbered.withColumn(out, F.col("_n") - 1 - last).drop("_n")


def form_frames(df: DataFrame, by: list[str], season: str, order: list[str], value: str, sizes: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """Means of the last rows (several sizes), of the career and of the season so far, and the number of earlier rows."""
    career = W.partitionBy(*by).orderBy(*order)
    own = W.partitionBy(*by, season).orderBy(*order)
    made = {f"{value}_l{n}": F.avg(value).over(career.rowsBetween(-n, -1)) for n in sizes}
    made[f"{value}_career"] = F.avg(value).over(career.rowsBetween(W.unboundedPreceding, -1))
    made[f"{value}_season"] = F.avg(value).over(own.rowsBetween(W.unboundedPreceding, -1))
    made["n_prior"] = F.count(value).over(career.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumns(made)


def weighted_form(df: DataFrame, by: list[str], order: list[str], value: str, rate: float, size: int = 20, least: int = 5) -> DataFrame:
    """The mean of the last `size` rows with weights rate**age, over the rows that are there, as `form`."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-size, -1)
    past = df.withColumn("_past", F.reverse(F.collect_list(value).over(w)))
    weights = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pow(F.lit(rate), i))
    pairs = F.zip_with("_past", F.slice(weights, F.lit(1), F.size("_past")), lambda x, k: x * k)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = E.ratio(total(pairs), total(F.slice(weights, F.lit(1), F.size("_past"))))
    return past.withColumn("form", F.when(F.size("_past") >= least, out)).drop("_past")


def history_arrays(df: DataFrame, by: list[str], order: list[str], values: list[str], size: int = 20) -> DataFrame:
    """`history`: the last `size` rows' values, oldest first, filled up with zeros in front; `mask`: 1 where a row is."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-size, -1)
    past = df.withColumn("_h", F.collect_list(F.array(*[F.col(v).cast("double") for v in values])).over(w))
    empty = F.array_repeat(F.array(*[F.lit(0.0)] * len(values)), F.lit(size) - F.size("_h"))
    mask = F.concat(F.array_repeat(F.lit(0), F.lit(size) - F.size("_h")), F.array_repeat(F.lit(1), F.size("_h")))
    return past.withColumns({"mask": mask, "history": F.concat(empty, F.col("_h"))}).drop("_h")


def daily_baseline(daily: DataFrame, date: str, sums: list[str], days: int = 365) -> DataFrame:
    """`trail_` sums of the `days` days before each day, that day excluded. `daily` has one row per day."""
    number = F.datediff(F.col(date), F.lit("1970-01-01"))
    # the days are bucketed so that no task holds the whole history: a day's frame is its own bucket and the one before
    bucketed = daily.withColumn("_d", number).withColumn("_b", F.floor(F.col("_d") / days))
    both = bucketed.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1))).withColumn("_own", F.col("_b") == F.floor(F.col("_d") / days))
    w = W.partitionBy("_b").orderBy("_d").rangeBetween(-days, -1)
    made = both.withColumns({f"trail_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})
    return made.where("_own").drop("_d", "_b", "_own")
