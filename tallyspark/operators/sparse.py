"""Symmetric linear systems whose matrix is a table of cells: small ones in one piece, large ones by conjugate gradients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage: a checkpoint where the session has a folder for them, else kept by the executors."""
    context, at = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if at and not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def solved(gram: DataFrame, right: DataFrame, small: int = 2000, steps: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """i, x with (gram + diag(penalty)) x = b; gram: i, j, g; right: i, b, penalty.

    Up to `small` unknowns, the cells come to the driver, which is at most the square of that. Beyond it, see
    `solved_each`.
    """
    spark = right.sparkSession
    held = right.limit(small + 1).collect()
    if len(held) <= small:
        at = {r["i"]: k for k, r in enumerate(sorted(held, key=lambda r: r["i"]))}
        a, b = np.zeros((len(at), len(at))), np.zeros(len(at))
        for r in held:
            b[at[r["i"]]], a[at[r["i"]], at[r["i"]]] = r["b"], r["penalty"]
        for r in gram.collect():
            a[at[r["i"]], at[r["j"]]] += r["g"]
        x = np.linalg.lstsq(a, b, rcond=None)[0] if len(b) else b
        return spark.createDataFrame([(i, float(x[k])) for i, k in at.items()], f"i {right.schema['i'].dataType.simpleString()}, x double")
    return by_gradients(gram.withColumn("system", F.lit(0)), right.withColumn("system", F.lit(0)), "system", steps, tolerance).drop("system")


def solved_each(gram: DataFrame, right: DataFrame, system: str, small: int = 2000, steps: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """system, i, x for many systems; gram: system, i, j, g; right: system, i, b, penalty.

    Where no system has more than `small` unknowns, each is solved in one task, the systems side by side; else all take
    the steps of conjugate gradients together.
    """
    largest = right.groupBy(system).count().agg(F.max("count")).first()[0] or 0
    if largest > small:
        return by_gradients(gram, right, system, steps, tolerance)
    name, unknown = (right.schema[c].dataType.simpleString() for c in (system, "i"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.j.isna()
        sides, cells = rows[own], rows[~own]
        at = pd.Index(sides.i)
        a = np.zeros((len(at), len(at)))
        np.add.at(a, (at.get_indexer(cells.i), at.get_indexer(cells.j)), cells.g.to_numpy(float))
        x = np.linalg.lstsq(a + np.diag(sides.penalty.to_numpy(float)), sides.g.to_numpy(float), rcond=None)[0]
        return pd.DataFrame({system: sides[system], "i": sides.i, "x": x})

    # one table for both: a row without j is a right side
    both = gram.select(system, "i", "j", "g", F.lit(0.0).alias("penalty")).unionByName(right.select(system, "i", F.lit(None).cast(unknown).alias("j"), F.col("b").alias("g"), "penalty"))
    return both.groupBy(system).applyInPandas(solve, f"{system} {name}, i {unknown}, x double")


def by_gradients(gram: DataFrame, right: DataFrame, system: str, steps: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """Conjugate gradients for all systems at once; raises if one hasn't come to its end after `steps`.

    The cells stay where they are: a step multiplies them with a vector by one join and one aggregate, and what comes
    back are two sums per system. Each step is cut with checkpoint() where the session has a checkpoint folder.
    """
    spark = right.sparkSession
    kind = right.schema[system].dataType.simpleString()
    cells = kept(gram)
    state = right.select(system, "i", "penalty", F.lit(0.0).alias("x"), F.col("b").cast("double").alias("r"), F.col("b").cast("double").alias("p"))
    state = kept(state)

    def total(value: Column) -> dict:
        return {r[0]: float(r[1] or 0.0) for r in state.groupBy(system).agg(F.sum(value)).collect()}

    def spread(values: dict, name: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(values.items()), f"{system} {kind}, {name} double"))  # a row per system

    size = first = total(F.col("r") * F.col("r"))
    done = lambda: all(size[s] <= tolerance * tolerance * first[s] for s in first)
    for _ in range(steps):
        if done():
            break
        moved = cells.join(state.select(system, F.col("i").alias("j"), "p").hint("merge"), [system, "j"]).groupBy(system, "i").agg(F.sum(F.col("g") * F.col("p")).alias("q"))
        state = state.join(moved.hint("merge"), [system, "i"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)) + F.col("penalty") * F.col("p"))
        state = kept(state)
        across = total(F.col("p") * F.col("q"))
        state = state.join(spread({s: size[s] / across[s] if across[s] else 0.0 for s in size}, "_length"), system)
        state = state.withColumns({"x": F.col("x") + F.col("_length") * F.col("p"), "r": F.col("r") - F.col("_length") * F.col("q")}).drop("_length")
        before, size = size, total(F.col("r") * F.col("r"))
        state = state.join(spread({s: size[s] / before[s] if before[s] else 0.0 for s in size}, "_turn"), system).withColumn("p", F.col("r") + F.col("_turn") * F.col("p")).drop("q", "_turn")
    else:
        if not done():
            raise ArithmeticError(f"not solved after {steps} steps")
    return state.select(system, "i", "x")
