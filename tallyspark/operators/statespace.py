"""State-space filters: levels that drift or revert, learnt from one observation after the other.

The recursions run in numpy over groups that Spark deals out. Teams that play one another are one group, a season of one
league, so `by` must name groups of a bounded number of teams and games. Players don't meet, so they are dealt into
buckets by hash, and a step of the loop takes the next row of every player of a bucket. All settings of a grid are
filtered in the same pass, side by side in one array.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of players that a bucket has on average.
BUCKET_ROWS = 100_000


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the rows need."""
    return max(8, df.count() // BUCKET_ROWS)


def in_buckets(df: DataFrame, entity: str, buckets: int | None = None) -> DataFrame:
    """`df` with `_bucket`: entities dealt by hash, into as many buckets as the rows need or as are asked for."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(entity), F.lit(buckets or bucket_count(df))))


class Histories:
    """The rows of many entities, each in order of time: their days, values, minutes, and the rows of each step."""

    def __init__(self, rows: pd.DataFrame, entity: str, date: str, value: str, minutes: str):
        self.rows = rows.sort_values([entity, date, minutes], kind="stable").reset_index(drop=True)
        self.days = days = pd.to_datetime(self.rows[date]).to_numpy().astype("datetime64[D]").astype(np.int64)
        code = pd.factorize(self.rows[entity])[0]
        new = np.flatnonzero(np.diff(code, prepend=-1))
        self.step = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        self.gap = np.where(self.step > 0, np.diff(days, prepend=days[:1]), 0).astype(float)
        self.minutes = self.rows[minutes].to_numpy(float)
        self.show(value)
        by_step = np.argsort(self.step, kind="stable")
        self.steps = np.split(by_step, np.cumsum(np.bincount(self.step))[:-1]) if len(code) else []

    def show(self, value: str) -> None:
        """From now on the column `value` is what is seen."""
        self.value = self.rows[value].to_numpy(float)
        self.seen = ~np.isnan(self.value) & (self.minutes > 0)

    def filtered(self, lam: np.ndarray, sigma2: np.ndarray, c: np.ndarray, mu: float) -> np.ndarray:
        """(settings, rows, 4): level and variance before each row and after it, for each setting."""
        lam, sigma2, c = (np.asarray(x, float)[:, None] for x in (lam, sigma2, c))
        out = np.empty((len(lam), len(self.rows), 4))
        for rows in self.steps:  # the rows before these are each entity's last
            if self.step[rows[0]] == 0:
                level, var = np.full((len(lam), len(rows)), mu), np.broadcast_to(sigma2, (len(lam), len(rows)))
            else:
                keep = np.exp(-lam * self.gap[rows])
                level, var = out[:, rows - 1, 2], out[:, rows - 1, 3]
                level, var = mu + keep * (level - mu), keep * keep * var + sigma2 * (1 - keep * keep)
            out[:, rows, 0], out[:, rows, 1] = level, var
            with np.errstate(divide="ignore", invalid="ignore"):
                trust = np.where(self.seen[rows], var / (var + c / self.minutes[rows]), 0.0)
            out[:, rows, 2] = level + trust * np.where(self.seen[rows], self.value[rows] - level, 0.0)
            out[:, rows, 3] = (1 - trust) * var
        return out


def ou_filter(df: DataFrame, entity: str, date: str, value: str, minutes: str, lam: float, sigma2: float, c: float, mu: float) -> DataFrame:
    """A mean-reverting level observed with noise c / minutes: pred, pred_var (before the row), level, level_var (after).

    The level reverts to `mu` at rate `lam` a day with stationary variance `sigma2`. A row without a value or without
    minutes changes nothing but the passing of time. A row's step costs the same however many entities a bucket has, so
    an entity with very many rows takes time, not memory beyond its rows.
    """
    schema = f"{entity} {df.schema[entity].dataType.simpleString()}, {date} date, {value} double, {minutes} double, pred double, pred_var double, level double, level_var double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = Histories(rows.drop(columns="_bucket"), entity, date, value, minutes)
        out = h.filtered([lam], [sigma2], [c], mu)[0]
        return pd.concat([h.rows, pd.DataFrame(out, columns=["pred", "pred_var", "level", "level_var"])], axis=1)

    typed = df.selectExpr(entity, f"cast({date} as date) {date}", f"cast({value} as double) {value}", f"cast({minutes} as double) {minutes}")
    return in_buckets(typed, entity).groupBy("_bucket").applyInPandas(run, schema)


def ou_likelihood(df: DataFrame, entity: str, date: str, value: str, minutes: str, period: str, settings: list[tuple[float, float, float]], mu: float) -> DataFrame:
    """How well settings (lam, sigma2, c) foresee the values: setting (its number), `period`, nll (a sum), n.

    A row's term looks at earlier rows only, so the terms of the periods up to any fold add up to the likelihood that a
    fit on those would have. Settings are filtered side by side; what leaves a task is one row per setting and period.
    """
    return scored(dealt(df, entity, date, [value], minutes, period), [settings], [mu]).select("setting", F.col("period").alias(period), "nll", "n")


def dealt(df: DataFrame, entity: str, date: str, values: list[str], minutes: str, period: str) -> DataFrame:
    """The rows of `df` that show something of `values`, packed for `scored`: a row for each bucket and set of values that are seen together.

    parts: the numbers of these values. periods: all of the bucket, those without a value too. sizes: how many entities
    have a row in each step. gaps: the different numbers of days between rows. gap (which of them lies before the row),
    inverse (of the minutes), code (which of `periods`) and shown (a line for each part): the rows step by step, where
    entities of more rows come first. A row that shows nothing
    lets time pass only, which the next row's gap does as well, so it is left out. weighted and weight (sums of the values
    by minutes, and of minutes), mean and square (sum of squares around it), one for each part. Buckets are spread evenly.
    """
    kind = df.schema[period].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = Histories(rows.drop(columns="_bucket"), entity, date, values[0], minutes)
        code, names = pd.factorize(h.rows[period], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names.tolist()]
        own = pd.factorize(h.rows[entity])[0]
        days = h.days
        shown, masks = [], {}
        for k, value in enumerate(values):
            h.show(value)
            shown.append(h.value)
            masks.setdefault(h.seen.tobytes(), (h.seen, []))[1].append(k)
        out = []
        for seen, parts in masks.values():
            at = np.flatnonzero(seen)
            first = np.flatnonzero(np.diff(own[at], prepend=-2))
            length = np.diff(np.append(first, len(at)))
            step = np.arange(len(at)) - np.repeat(first, length)
            gap = np.where(step > 0, np.diff(days[at], prepend=days[at][:1]), 0)
            place = np.lexsort((np.repeat(np.argsort(np.argsort(-length, kind="stable")), length), step))
            rows_at = at[place]
            y, m = np.array([shown[k][rows_at] for k in parts]), h.minutes[rows_at]
            gaps, gap = np.unique(gap[place], return_inverse=True)
            mean = y.mean(1) if len(at) else np.zeros(len(parts))
            out.append(
                (parts, names, np.bincount(step).astype("i4").tobytes(), gaps.astype("f8").tobytes(), gap.astype("i4").tobytes(), (1 / m).tobytes(), code[rows_at].astype("i4").tobytes(), y.tobytes(), len(at), (y @ m).tolist(), float(m.sum()), mean.tolist(), ((y - mean[:, None]) ** 2).sum(1).tolist())
            )
        return pd.DataFrame(out, columns=["parts", "periods", "sizes", "gaps", "gap", "inverse", "code", "shown", "n", "weighted", "weight", "mean", "square"])

    typed = df.selectExpr(entity, f"cast({date} as date) {date}", f"cast({minutes} as double) {minutes}", period, *(f"cast({v} as double) {v}" for v in values))
    buckets = bucket_count(typed)
    schema = f"parts array<int>, periods array<{kind}>, sizes binary, gaps binary, gap binary, inverse binary, code binary, shown binary, n long, weighted array<double>, weight double, mean array<double>, square array<double>"
    return in_buckets(typed, entity, buckets).groupBy("_bucket").applyInPandas(run, schema).repartition(buckets)


#: Values that a step of `terms` works on at once, about: a few arrays of them fit in a CPU's cache.
STEP_VALUES = 32_000


def terms(sizes: np.ndarray, gaps: np.ndarray, gap: np.ndarray, inverse: np.ndarray, shown: np.ndarray, lam: np.ndarray, sigma2: np.ndarray, c: np.ndarray, mu: float) -> np.ndarray:
    """(settings, rows): each row's negative log-likelihood; the rows as `dealt` has them."""
    many, most = len(lam), int(sizes.max(initial=0))
    keeps = np.exp(-lam[:, None] * gaps)
    off, noise, sigma2, out = shown - mu, c[:, None], sigma2[:, None], np.empty((many, len(shown)))
    level, var, room = np.zeros((many, most)), np.empty((many, most)), np.empty((3, many * most))
    var[:] = sigma2
    begin = 0
    for step, m in enumerate(sizes.tolist()):
        own = slice(begin, begin + m)
        begin += m
        d, v, o = level[:, :m], var[:, :m], out[:, own]
        k, t, g = (x[: many * m].reshape(many, m) for x in room)
        if step:  # level and variance before the row: d is the level less mu
            np.take(keeps, gap[own], axis=1, out=k, mode="clip")
            d *= k
            k *= k
            v *= k
            k *= sigma2
            np.subtract(sigma2, k, out=k)
            v += k
        np.multiply(noise, inverse[own], out=k)
        np.add(v, k, out=t)
        np.divide(v, t, out=g)
        np.subtract(off[own], d, out=o)
        np.multiply(g, k, out=v)  # (1 - g) * v
        g *= o
        d += g
        o *= o
        o /= t
        np.log(t, out=t)
        o += t
    out += math.log(2 * math.pi)
    out *= 0.5
    return out


def scored(packed: DataFrame, settings: list[list[tuple[float, float, float]]], mu: list[float]) -> DataFrame:
    """part, setting, period, nll (a sum), n: how well each part's `settings` foresee its values around its `mu`.

    packed: of `dealt`. A task takes one bucket after the other, and a few settings at a time hold its memory down.
    """
    kind = packed.schema["periods"].dataType.elementType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in (b for frame in frames for b in frame.itertuples()):
            sizes, gaps, gap, inverse, code, shown = (np.frombuffer(x, t) for x, t in ((b.sizes, "i4"), (b.gaps, "f8"), (b.gap, "i4"), (b.inverse, "f8"), (b.code, "i4"), (b.shown, "f8")))
            gap, code = gap.astype(np.intp), code.astype(np.intp)
            count = np.bincount(code, minlength=len(b.periods))
            here = np.flatnonzero(count)
            for part, values in zip(b.parts, shown.reshape(len(b.parts), -1), strict=True):
                asked = np.array(settings[part], float).reshape(-1, 3)
                many = max(1, min(16, STEP_VALUES // max(sizes.max(initial=1), 1)))
                for k in range(0, len(asked), many):
                    sums = [np.bincount(code, line, len(count))[here] for line in terms(sizes, gaps, gap, inverse, values, *asked[k : k + many].T, mu[part])]
                    yield pd.DataFrame({"part": part, "setting": np.repeat(np.arange(k, k + len(sums)), len(here)), "period": np.tile(np.asarray(b.periods)[here], len(sums)), "nll": np.concatenate(sums), "n": np.tile(count[here], len(sums))})

    sums = packed.mapInPandas(run, f"part int, setting int, period {kind}, nll double, n long")
    return sums.groupBy("part", "setting", "period").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))


def chosen_before(scores: DataFrame, period: str, loss: Column | str = "nll", burn_in: int = 1) -> DataFrame:
    """Of each period, the setting of least total `loss` over all earlier periods: `period`, setting, loss (of those)."""
    earlier = W.partitionBy("setting").orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    known = scores.select("setting", period, F.sum(loss).over(earlier).alias("loss"), F.count("*").over(earlier).alias("_periods")).where(F.col("_periods") >= burn_in)
    best = F.row_number().over(W.partitionBy(period).orderBy("loss", "setting"))
    return known.withColumn("_best", best).where("_best = 1").select(period, "setting", "loss")


class Beliefs:
    """Correlated Gaussian levels, for many settings at once: mean (settings, levels), covariance between all levels.

    Every step adds `drift` to each level's own variance. That adds up along the diagonal only, so it is kept as a count
    of steps and enters where a column is looked at.
    """

    def __init__(self, mean: np.ndarray, variance: np.ndarray, drift: np.ndarray):
        self.mean, self.drift, self.steps = mean.astype(float), drift, 0
        self.spread = np.zeros((*mean.shape, mean.shape[1]))
        self.spread[:, np.arange(mean.shape[1]), np.arange(mean.shape[1])] = variance

    def expect(self, columns: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of weighted sums (a row of `weights` each) of levels: mean, covariance, and covariance with all levels."""
        reach = self.spread[:, :, columns] @ weights.T
        reach[:, columns] += self.steps * self.drift[:, columns, None] * weights.T
        return self.mean[:, columns] @ weights.T, weights @ reach[:, columns], reach

    def learn(self, surprise: np.ndarray, total: np.ndarray, reach: np.ndarray) -> None:
        """Take in sums that came out `surprise` off, where `total` is their covariance with noise."""
        pull = np.linalg.solve(total, np.swapaxes(reach, 1, 2))
        self.mean += np.einsum("sk,skn->sn", surprise, pull)
        self.spread -= reach @ pull


#: Teams that a group of games may have: the covariance of all pairs is held for each setting.
MOST_TEAMS = 2000


def in_order(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A league's games in order, its teams, and each game's home and away team by number. More than MOST_TEAMS raise."""
    rows = rows.sort_values(["game_date", "game_id"], kind="stable")
    teams, code = np.unique(np.concatenate([rows.home_id.to_numpy(), rows.away_id.to_numpy()]), return_inverse=True)
    if len(teams) > MOST_TEAMS:
        raise ValueError(f"a group of {len(teams)} teams: part the games by league")
    return rows, teams, code[: len(rows)], code[len(rows) :]


def margins_foreseen(rows: pd.DataFrame, seeds: dict, q: np.ndarray, r: np.ndarray, p0: np.ndarray, home: float) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The games in order, and their predicted margins and variances: (games, settings). The last level is the home term."""
    rows, teams, hosts, guests = in_order(rows)
    n, many = len(teams), len(q)
    start = np.array([*(seeds.get(t, 0.0) for t in teams), home])
    variance, drift = np.repeat(p0[:, None], n + 1, 1), np.repeat(q[:, None], n + 1, 1)
    variance[:, n], drift[:, n] = 1.0, 0.0
    state = Beliefs(np.tile(start, (many, 1)), variance, drift)
    sums = np.array([[1.0, -1.0, 1.0]])
    said, spread = np.empty((len(rows), many)), np.empty((len(rows), many))
    for k, (i, j, z) in enumerate(zip(hosts.tolist(), guests.tolist(), rows.margin.to_numpy(float), strict=True)):
        state.steps += 1
        mean, within, reach = state.expect([i, j, n], sums)
        total = within + r[:, None, None]
        said[k], spread[k] = mean[:, 0], total[:, 0, 0]
        if not math.isnan(z):
            state.learn(z - mean, total, reach)
    return rows, said, spread


def typed_games(games: DataFrame, by: list[str], more: Iterable[str] = ()) -> DataFrame:
    return games.select(*by, "game_id", "game_date", "home_id", "away_id", F.col("margin").cast("double").alias("margin"), *(F.col(c).cast("double").alias(c) for c in more))


def keyed(games: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {games.schema[c].dataType.simpleString()}" for c in by)


def team_kalman(games: DataFrame, seed: DataFrame | None = None, q: float = 0.5, r: float = 140.0, p0: float = 30.0, home: float = 2.5, by: tuple[str, ...] = ("season",)) -> DataFrame:
    """Ratings of all teams of a group `by` and one home term, updated game by game: `by`, game_id, pred, pred_var.

    games: `by`, game_id, game_date, home_id, away_id, margin (null: not played yet). seed: `by`, team_id, rating.
    Every team's variance grows by q with every game of its group. A group is one task's: a season of a league.
    """
    by = list(by)

    def run(rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        names = ["game_id", "pred", "pred_var"]
        if not len(rows):
            return pd.DataFrame(columns=[*by, *names])
        given = dict(zip(seeds.team_id, seeds.rating, strict=True)) if len(seeds) else {}
        rows, said, spread = margins_foreseen(rows, given, np.array([q]), np.array([r]), np.array([p0]), home)
        return rows[[*by, "game_id"]].assign(pred=said[:, 0], pred_var=spread[:, 0])

    seeds = seed if seed is not None else games.sparkSession.createDataFrame([], f"{keyed(games, by)}, team_id long, rating double")
    schema = f"{keyed(games, by)}, game_id string, pred double, pred_var double"
    return typed_games(games, by).groupBy(*by).cogroup(seeds.groupBy(*by)).applyInPandas(run, schema)


def kalman_grid(games: DataFrame, grid: list[dict], home: float = 2.5, by: tuple[str, ...] = ("season",)) -> DataFrame:
    """How every setting of `grid` (q, r, p0) foresees each group's margins: `by`, setting, nll and mae (means), n."""
    by = list(by)
    q, r, p0 = (np.array([s[c] for s in grid], float) for c in ("q", "r", "p0"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.iloc[0][by]
        rows, said, spread = margins_foreseen(rows, {}, q, r, p0, home)
        off = rows.margin.to_numpy()[:, None] - said
        nll = 0.5 * (np.log(2 * math.pi * spread) + off**2 / spread)
        return pd.DataFrame({**{c: group[c] for c in by}, "setting": np.arange(len(grid)), "nll": nll.mean(0), "mae": np.abs(off).mean(0), "n": len(rows)})

    return typed_games(games.where("margin is not null"), by).groupBy(*by).applyInPandas(run, f"{keyed(games, by)}, setting int, nll double, mae double, n long")


def factor_kalman(games: DataFrame, factors: list[str], means: list[float], sds: list[float], weights: list[float], home: float, margin_var: float, q: float = 0.01, r: float = 1.0, p0: float = 1.0, margin_noise: float | None = None, by: tuple[str, ...] = ("season",)) -> DataFrame:
    """One level per team and factor, learnt jointly from each game's factor differences: `by`, game_id, pred, pred_var.

    A game shows the home levels less the away levels in standard units, with noise `r`; the margin foreseen is those
    differences by `weights` plus `home`. With `margin_noise`, the margin itself is one more observation of the levels.
    """
    by, many = list(by), len(factors)
    w = np.array(weights, float)
    apart = np.hstack([np.eye(many), -np.eye(many)])
    seen = apart if margin_noise is None else np.vstack([apart, w @ apart])
    noise = np.diag([r] * many + ([] if margin_noise is None else [margin_noise]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, teams, hosts, guests = in_order(rows)
        n = len(teams) * many
        state = Beliefs(np.zeros((1, n)), np.full((1, n), p0), np.full((1, n), q))
        y = (rows[factors].to_numpy(float) - np.array(means)) / np.array(sds)
        z = rows.margin.to_numpy(float) - home
        said, spread = np.empty(len(rows)), np.empty(len(rows))
        for k, (i, j) in enumerate(zip(hosts.tolist(), guests.tolist(), strict=True)):
            state.steps += 1
            mean, within, reach = state.expect([*range(i * many, i * many + many), *range(j * many, j * many + many)], seen)
            said[k] = w @ mean[0, :many] + home
            spread[k] = w @ within[0, :many, :many] @ w + margin_var
            shown = y[k] if margin_noise is None else np.append(y[k], z[k])
            if not np.isnan(shown).any():
                state.learn(shown - mean, within + noise, reach)
        return rows[[*by, "game_id"]].assign(pred=said, pred_var=spread)

    return typed_games(games, by, factors).groupBy(*by).applyInPandas(run, f"{keyed(games, by)}, game_id string, pred double, pred_var double")
