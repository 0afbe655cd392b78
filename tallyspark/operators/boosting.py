"""Gradient boosting on histograms, with missing values as such.

Features are cut into bins once; a missing value has a bin of its own. A level of a tree is one pass: each task adds up
gradients by node, feature and bin, and only those sums come back. Every split learns the side to which missing values go,
and may part the missing from the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.sparse import kept

#: Trees after which predictions are written down, so that a pass applies a bounded number of trees.
WRITTEN = 8


@dataclass
class Tree:
    """Nodes in order of growth. feature: -1 for a leaf; a row goes left if its bin is at most `cut`, or missing (0) with `missing_left`."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node] = feature, cut, missing_left, len(self.feature)
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.missing_left, True), (self.left, 0), (self.value, 0.0)):
            column += [empty, empty]
        return len(self.feature) - 2, len(self.feature) - 1

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, missing, left = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left))
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while len(rows := rows[feature[at[rows]] >= 0]):
            node = at[rows]
            code = codes[rows, feature[node]]
            goes_left = np.where(code == 0, missing[node], code <= cut[node])
            at[rows] = left[node] + ~goes_left
        return at

    def predicted(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(codes)]


def bin_edges(df: DataFrame, features: list[str], bins: int = 64) -> list[np.ndarray]:
    """Each feature's upper bin edges: its different quantiles, from one aggregate. Nulls and NaN play no part."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be from 2 to 255")
    at = [k / bins for k in range(1, bins)]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    row = df.agg(*[F.percentile_approx(number(c), at, 10_000).alias(f"e{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(row[k] or [], float)) for k in range(len(features))]


def binned(df: DataFrame, features: list[str], edges: list[np.ndarray], more: list[Column]) -> DataFrame:
    """codes (a byte per feature: 0 for missing, else 1 + the number of edges below the value) and the columns `more`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(edges)), np.uint8)
            for k, edge in enumerate(edges):
                x = batch.column(k).to_numpy(zero_copy_only=False).astype(float)
                codes[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edge, x, "left"))
            cells = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([cells, *batch.columns[len(edges) :]], ["codes", *batch.schema.names[len(edges) :]])

    rows = df.select(*[F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(features)], *more)
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema[len(features) :])
    return rows.mapInArrow(run, f"codes binary{', ' if kinds else ''}{kinds}")


def codes_of(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features)


def best_split(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing_left) from sums by feature and bin; the first of equal gains. None if nothing gains.

    If a node has no missing value of the feature, later ones go with the larger side.
    """
    g, h, n = gradient[0].sum(), weight[0].sum(), count[0].sum()
    options = []
    for missing_left in (False, True):
        extra = (lambda x: x[:, :1]) if missing_left else (lambda x: 0 * x[:, :1])
        gl, hl, nl = (np.cumsum(x[:, 1:], axis=1) + extra(x) for x in (gradient, weight, count))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
        options.append(np.where((nl >= least) & (n - nl >= least), gain, -np.inf))
    gain = np.stack(options, axis=2)
    at = np.unravel_index(np.nanargmax(np.where(np.isnan(gain), -np.inf, gain)), gain.shape)
    if not gain[at] > 1e-12:
        return None
    feature, cut, missing_left = int(at[0]), int(at[1]) + 1, bool(at[2])
    if count[feature, 0] == 0:
        below = count[feature, 1 : cut + 1].sum()
        missing_left = bool(below >= n - below)
    return float(gain[at]), feature, cut, missing_left


@dataclass
class Boosted:
    """A fitted model. logistic: predictions are chances, else values."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    logistic: bool
    losses: list[float]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predicted(codes) for t in self.trees), np.zeros(len(codes)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """`df` with the prediction; rows with missing features have one too. A column `out` of `df` is replaced."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # as large as its trees
        names = [c for c in df.columns if c != out]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                raw = model.raw(codes_of(batch.column(0), len(model.features)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-raw)) if model.logistic else raw)], [*batch.schema.names[1:], out])

        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
        return binned(df, self.features, self.edges, [F.col(c) for c in names]).mapInArrow(run, f"{kinds}, `{out}` double")


def fit(df: DataFrame, features: list[str], target: str, trees: int = 100, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: int = 20, bins: int = 64, logistic: bool = False, held: str | None = None, patience: int = 10) -> Boosted:
    """Boosted trees for `target` (a number; 0 or 1 if logistic). Rows without a target are left out.

    held: a boolean column; its rows are not fitted on, and no tree is added once their loss hasn't fallen for `patience`
    trees (the trees after the best are dropped). least: rows that a side of a split needs. An empty table gives a model
    of base 0. losses: the mean loss before each tree, of the held rows if there are any, and after the last.
    """
    rows = df.where(F.col(target).isNotNull())
    held_out = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    edges = bin_edges(rows.where(~held_out), features, bins)
    width, many = bins + 1, len(features)
    data = kept(binned(rows, features, edges, [F.col(target).cast("double").alias("y"), held_out.alias("held"), F.lit(0.0).alias("raw")]))
    mean = data.where("not held").agg(F.avg("y")).first()[0]
    start = 0.0 if mean is None else float(np.log(mean / (1 - mean)) if logistic and 0 < mean < 1 else mean)
    model = Boosted(list(features), edges, start, [], logistic, [])
    context, written = df.sparkSession.sparkContext, 0
    data = data.withColumn("raw", F.lit(start))

    def sums_of(tree: Tree, nodes: list[int], new: list[Tree]) -> dict:
        """Sums by cell (node, feature, bin) over the rows of `nodes`; -1: loss, -2: held loss, with counts."""
        shared = context.broadcast((tree, nodes, new))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, nodes, new = shared.value
            size = len(nodes) * many * width
            total, place = np.zeros((3, size)), np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            loss, seen = np.zeros(2), np.zeros(2)
            for batch in batches:
                codes = codes_of(batch.column(0), many)
                y, held, raw = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                raw = raw + sum((t.predicted(codes) for t in new), np.zeros(len(codes)))
                p = 1 / (1 + np.exp(-raw)) if logistic else raw
                each = np.logaddexp(0, raw) - y * raw if logistic else (y - raw) ** 2
                for k in (0, 1):
                    loss[k] += each[held == bool(k)].sum()
                    seen[k] += (held == bool(k)).sum()
                at = place[tree.nodes_of(codes)]
                own = np.flatnonzero((at >= 0) & ~held.astype(bool))
                cell = ((at[own, None] * many + np.arange(many)) * width + codes[own]).ravel()
                for k, x in enumerate((p - y, p * (1 - p) if logistic else np.ones(len(y)), np.ones(len(y)))):
                    total[k] += np.bincount(cell, np.repeat(x[own], many), size)
            used = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], used)), *(pa.array(np.append(x, total[k, used])) for k, x in enumerate((loss, np.zeros(2), seen)))], ["cell", "g", "h", "n"])

        got = data.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()
        return {r[0]: r[1:] for r in got}

    best = (np.inf, 0)
    for _ in range(trees):
        tree, open_ = Tree(), [0]
        for level in range(depth + 1):
            sums = sums_of(tree, open_, model.trees[written:])
            if level == 0:
                loss = sums.get(-2 if held else -1, (0.0, 0.0, 0.0))
                model.losses.append(loss[0] / loss[2] if loss[2] else 0.0)
            table = np.zeros((3, len(open_) * many * width))
            for cell, values in sums.items():
                if cell >= 0:
                    table[:, cell] = values
            table = table.reshape(3, len(open_), many, width)
            after = []
            for k, node in enumerate(open_):
                g, h, n = table[:, k]
                tree.value[node] = float(-rate * g[0].sum() / (h[0].sum() + l2)) if n[0].sum() else 0.0
                found = best_split(g, h, n, l2, least) if level < depth and n[0].sum() else None
                if found:
                    after += tree.split(node, *found[1:])
            open_ = after
            if not open_:
                break
        if held and model.losses[-1] < best[0] - 1e-12:
            best = model.losses[-1], len(model.trees)
        if held and len(model.trees) - best[1] >= patience:
            break
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        if len(model.trees) - written >= WRITTEN:
            shared = context.broadcast(model.trees[written:])

            def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    codes = codes_of(batch.column(0), many)
                    raw = batch.column(3).to_numpy() + sum(t.predicted(codes) for t in shared.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw)], ["codes", "y", "held", "raw"])

            data, written = kept(data.mapInArrow(add, "codes binary, y double, held boolean, raw double")), len(model.trees)
    last = sums_of(Tree(), [], model.trees[written:]).get(-2 if held else -1, (0.0, 0.0, 0.0))
    model.losses.append(last[0] / last[2] if last[2] else 0.0)
    if held:
        if model.losses[-1] < best[0]:
            best = model.losses[-1], len(model.trees)
        model.trees = model.trees[: best[1]]
    return model
