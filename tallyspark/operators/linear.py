"""Least squares by normal equations: the sums are one distributed aggregate, the solve is as small as the columns are few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E


def gram(df: DataFrame, features: list[str], target: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The sums of all products of (1, features, target), as columns g_i_j, and n; rows with a null among them are left out."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in [*features, target])]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    rows = df.dropna(subset=[*features, target, *([weight] if weight else [])])
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count("*").alias("n"), *sums)


def solve(row, p: int, ridge: float = 0.0) -> dict:
    """Coefficients (the intercept first, never penalised), standard errors and residual variance of one gram row."""
    full = np.zeros((p + 2, p + 2))
    for i in range(p + 2):
        for j in range(i, p + 2):
            full[i, j] = full[j, i] = row[f"g_{i}_{j}"] or 0.0
    a, b, yy, n = full[: p + 1, : p + 1], full[: p + 1, p + 1], full[p + 1, p + 1], row["n"]
    penalty = ridge * np.eye(p + 1)
    penalty[0, 0] = 0
    beta = np.linalg.lstsq(a + penalty, b, rcond=None)[0]
    rest = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)
    sigma2 = rest / max(n - p - 1, 1)
    return {"beta": beta, "se": np.sqrt(np.clip(np.diag(np.linalg.pinv(a + penalty)) * sigma2, 0, None)), "sigma2": sigma2, "n": n}


def fit(df: DataFrame, features: list[str], target: str, weight: str | None = None, ridge: float = 0.0) -> dict:
    return solve(gram(df, features, target, weight).first(), len(features), ridge)


def predicted(beta: np.ndarray, features: list[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], features, strict=True)), F.lit(float(beta[0])))


def walk_forward(df: DataFrame, fold: str, features: list[str], target: str, burn_in: int = 3, ridge: float = 0.0, least: int = 0) -> DataFrame:
    """Each fold predicted by a fit on all earlier ones. The sums are taken once per fold and added up on the driver.

    `df` with `prediction`, for folds after the burn-in with `least` training rows or more. Folds are few (seasons).
    """
    p = len(features)
    blocks = sorted(gram(df, features, target, by=[fold]).collect(), key=lambda r: r[fold])
    names = [c for c in blocks[0].asDict() if c.startswith("g_") or c == "n"] if blocks else []
    seen, fits = dict.fromkeys(names, 0.0), []
    for k, block in enumerate(blocks):
        if k >= burn_in and seen["n"] >= max(least, p + 2):
            fits.append((block[fold], [float(x) for x in solve(seen, p, ridge)["beta"]]))
        seen = {c: seen[c] + (block[c] or 0.0) for c in names}
    spark = df.sparkSession
    betas = spark.createDataFrame(fits, f"{fold} {df.schema[fold].dataType.simpleString()}, _beta array<double>")
    joined = df.join(F.broadcast(betas), fold)  # a row per fold
    value = sum((F.col("_beta")[i + 1] * F.col(c) for i, c in enumerate(features)), F.col("_beta")[0])
    return joined.withColumn("prediction", value).drop("_beta")


def shrunk_form(train: DataFrame, test: DataFrame, value: str, mean: str, var: str, window: int = 15) -> DataFrame:
    """`test` with the form `mean` shrunk by empirical Bayes from `train`: signal variance over signal and noise.

    The effective number of games is the mean of the variances over the variance of the means, from 1 to `window`.
    """
    stats = train.agg(F.avg(var).alias("_v"), F.var_pop(mean).alias("_s"), F.avg(mean).alias("_m"))
    joined = test.crossJoin(F.broadcast(stats))  # one row
    n = F.least(F.greatest(E.ratio("_v", "_s"), F.lit(1.0)), F.lit(float(window)))
    signal = F.greatest(F.col("_s") - F.col("_v") / n, F.lit(0.0))
    weight = E.ratio(signal, signal + F.col(var) / n)
    return joined.withColumn(value, F.col("_m") + F.coalesce(weight, F.lit(0.0)) * (F.col(mean) - F.col("_m"))).drop("_v", "_s", "_m")


def metrics(rows: DataFrame, prediction: str, actual: str, sigma: float = 12.0, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, accuracy, log_loss and brier of margin predictions; a prediction of 0 is no win."""
    p, y = E.win_probability(prediction, sigma), (F.col(actual) > 0).cast("double")
    error = F.col(prediction) - F.col(actual)
    made = [
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(((F.col(prediction) > 0) == (F.col(actual) > 0)).cast("double")).alias("accuracy"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
    ]
    rows = rows.where(F.col(prediction).isNotNull() & F.col(actual).isNotNull())
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*made)
