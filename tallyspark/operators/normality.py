"""Tests of normality from order statistics, by group.

Equal values are added up first; ranks come from a range partition of the different values, with the counts of earlier
parts as offsets. So a group of any size is dealt over tasks, and a very frequent value is one row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyspark.operators.sparse import kept

#: Ranks of equal values whose expected order statistics are added up together.
CHUNK = 100_000
#: Fixed values of Royston's approximation (AS R94): the last two weights, then mean and deviation of the transformed
#: statistic for up to 11 values (polynomials in n) and for more (in ln n).
LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW_LIMIT, FEW_MEAN, FEW_SD = (-2.273, 0.459), (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
MANY_MEAN, MANY_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: The Anderson-Darling statistic's 5 % point for large samples.
ANDERSON_5 = 0.787


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """`left` with the other columns of `right`; a null group is one like any other."""
    more = [F.col(f"r.{c}") for c in right.columns if c not in by]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *more)


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by`, `value`, m (how often it is there), before (how many values of the group are smaller), part. Nulls and NaN go."""
    number = F.col(value).cast("double")
    runs = df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*by, number.alias(value)).agg(F.count("*").alias("m"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = kept(runs.repartitionByRange(parts, *by, value).withColumn("part", F.spark_partition_id()))
    counts = runs.groupBy(*by, "part").agg(F.sum("m").alias("_here"))
    offsets = counts.select(*by, "part", (F.sum("_here").over(W.partitionBy(*by).orderBy("part")) - F.col("_here")).alias("_start"))  # a row per group and part
    inside = F.sum("m").over(W.partitionBy(*by, "part").orderBy(value)) - F.col("m")
    return joined(runs.withColumn("_inside", inside), F.broadcast(offsets), [*by, "part"]).select(*by, value, "m", (F.col("_start") + F.col("_inside")).alias("before"), "part")


def pair(*names: str) -> StructType:
    return StructType([StructField(c, DoubleType()) for c in names])


@F.pandas_udf(pair("low", "high"))
def log_tails(z: pd.Series) -> pd.DataFrame:
    """Logs of the normal distribution function below and above z."""

    def log_below(x: float) -> float:
        half = 0.5 * math.erfc(-x / math.sqrt(2))
        return math.log(half) if half > 1e-300 else -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi)

    return pd.DataFrame({"low": [log_below(x) for x in z], "high": [log_below(-x) for x in z]})


@F.pandas_udf(pair("first", "second"))
def expected_sums(before: pd.Series, m: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of the expected order statistics of ranks before + 1 to before + m of n, and of their squares."""
    quantile = NormalDist().inv_cdf
    first, second = [], []
    for a, k, size in zip(before.tolist(), m.tolist(), n.tolist(), strict=True):
        q = np.array([quantile((i - 0.375) / (size + 0.25)) for i in range(a + 1, a + k + 1)])
        first.append(q.sum())
        second.append((q * q).sum())
    return pd.DataFrame({"first": first, "second": second})


def shapiro_wilk(n: int, squares: float, product: float, spread: float, outer: float, inner: float) -> tuple[float, float]:
    """W and its p-value. squares: of the expected order statistics; product: with the values; spread: sum of squares about
    the mean; outer: largest less smallest value; inner: the same of those next to them."""
    poly = lambda c, x: sum(v * x**k for k, v in enumerate(c))
    q = NormalDist().inv_cdf
    top, next_ = q((n - 0.375) / (n + 0.25)), q((n - 1.375) / (n + 0.25))
    if n == 3:
        total = math.sqrt(0.5) * outer
    else:
        u = 1 / math.sqrt(n)
        last = top / math.sqrt(squares) + poly(LAST, u)
        if n > 5:
            but_one = next_ / math.sqrt(squares) + poly(LAST_BUT_ONE, u)
            scale = math.sqrt((squares - 2 * top**2 - 2 * next_**2) / (1 - 2 * last**2 - 2 * but_one**2))
            total = (product - top * outer - next_ * inner) / scale + last * outer + but_one * inner
        else:
            scale = math.sqrt((squares - 2 * top**2) / (1 - 2 * last**2))
            total = (product - top * outer) / scale + last * outer
    w = min(total * total / spread, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        limit = poly(FEW_LIMIT, n)
        if y >= limit:
            return w, 1e-99
        y, mean, sd = -math.log(limit - y), poly(FEW_MEAN, n), math.exp(poly(FEW_SD, n))
    else:
        mean, sd = poly(MANY_MEAN, math.log(n)), math.exp(poly(MANY_SD, math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def normality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`by`, n, mean, sd, shapiro_w, shapiro_p (3 values or more), anderson, anderson_5 (its 5 % point; 8 or more).

    Null where there are too few values or all are equal. A Shapiro-Wilk p-value of more than 5000 values is an
    extrapolation.
    """
    runs = kept(ranked(df, by, value))
    moments = runs.groupBy(*by).agg(F.sum("m").alias("n"), (F.sum(F.col(value) * F.col("m")) / F.sum("m")).alias("mean"))
    known = joined(runs, F.broadcast(moments), by)  # a row per group
    spread = known.groupBy(*by).agg(F.sum(F.col("m") * F.pow(F.col(value) - F.col("mean"), F.lit(2))).alias("spread"))
    rows = joined(known, F.broadcast(spread), by)
    rows = rows.withColumn("tails", log_tails(F.try_divide(F.col(value) - F.col("mean"), F.sqrt(F.try_divide("spread", F.col("n") - 1)))))
    m, a, n = F.col("m"), F.col("before"), F.col("n")
    # rank i counts 2 i - 1 times below and 2 (n - i) + 1 times above; a run of equal values has the sums in closed form
    darling = F.sum(m * (2 * a + m) * F.col("tails.low") + m * (2 * n - 2 * a - m) * F.col("tails.high"))
    holds = lambda rank: F.max(F.when((a < rank) & (rank <= a + m), F.col(value)))
    first = rows.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("spread").alias("spread"), darling.alias("darling"), holds(F.lit(1)).alias("x1"), holds(F.lit(2)).alias("x2"), holds(n - 1).alias("y2"), holds(n).alias("y1"))
    pieces = known.select(*by, value, "n", "before", "m", F.explode(F.sequence(F.lit(0), F.floor((m - 1) / CHUNK))).alias("k"))
    pieces = pieces.select(*by, value, "n", (F.col("before") + F.col("k") * CHUNK).alias("before"), F.least(F.lit(CHUNK), m - F.col("k") * CHUNK).alias("m"))
    sums = pieces.withColumn("s", expected_sums("before", "m", "n")).groupBy(*by).agg(F.sum("s.second").alias("squares"), F.sum(F.col("s.first") * F.col(value)).alias("product"))

    @F.pandas_udf(pair("w", "p"))
    def shapiro(n: pd.Series, squares: pd.Series, product: pd.Series, spread: pd.Series, outer: pd.Series, inner: pd.Series) -> pd.DataFrame:
        found = [shapiro_wilk(int(r[0]), *r[1:]) if r[0] >= 3 and r[3] > 0 else (None, None) for r in zip(n, squares, product, spread, outer, inner, strict=True)]
        return pd.DataFrame(found, columns=["w", "p"])

    both = joined(first, sums, by).withColumn("shapiro", shapiro("n", "squares", "product", "spread", F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")))
    enough = (n >= 8) & (F.col("spread") > 0)
    return both.select(
        *by, "n", "mean", F.sqrt(F.try_divide("spread", n - 1)).alias("sd"), F.col("shapiro.w").alias("shapiro_w"), F.col("shapiro.p").alias("shapiro_p"),
        F.when(enough, -n - F.try_divide("darling", n)).alias("anderson"), F.when(enough, F.round(F.try_divide(F.lit(ANDERSON_5), 1 + 4 / n - 25 / (n * n)), 3)).alias("anderson_5"),
    )
