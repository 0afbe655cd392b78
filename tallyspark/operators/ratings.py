"""Regularised player ratings from stints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators.sparse import kept, solved, solved_each


def design(stints: DataFrame) -> DataFrame:
    """Two rows per stint, one per offence: row, y (points per 100), w (possessions), off, def (line-ups), home.

    Stints of equal line-ups are added up first; a weighted fit doesn't change by that, and has far fewer rows.
    """
    side = lambda o, d, home: F.struct(F.col(f"{o}_lineup").alias("off"), F.col(f"{d}_lineup").alias("def"), F.col(f"{o}_pts").cast("double").alias("pts"), F.col(f"{o}_poss").cast("double").alias("poss"), F.lit(home).alias("home"))
    rows = stints.select(F.explode(F.array(side("home", "away", 1.0), side("away", "home", 0.0))).alias("s")).select("s.*").where("poss > 0")
    sums = rows.groupBy("off", "def", "home").agg(F.sum("pts").alias("pts"), F.sum("poss").alias("w"))
    return sums.withColumn("y", 100 * F.col("pts") / F.col("w")).drop("pts")


def ridge_ratings(rows: DataFrame, ridge: float, prior: DataFrame | None = None, small: int = 2000) -> DataFrame:
    """person_id, offence, defence (points saved per 100) by weighted ridge regression towards a prior.

    The Gram matrix is one aggregate over pairs of the 12 entries of each row, and is solved where it lies once there are
    many players (see sparse.solved). prior: person_id, offence, defence. Intercept and home term are free.
    """
    entry = lambda kind, sign: lambda p: F.struct(F.concat(F.lit(kind), p.cast("string")).alias("c"), F.lit(sign).alias("v"))
    fixed = F.array(F.struct(F.lit("1").alias("c"), F.lit(1.0).alias("v")), F.struct(F.lit("home").alias("c"), F.col("home").alias("v")))
    cells = rows.select("y", "w", F.concat(F.transform("off", entry("o", 1.0)), F.transform("def", entry("d", -1.0)), fixed).alias("x"))
    pair = cells.select("w", F.explode("x").alias("a"), "x").select("w", "a", F.explode("x").alias("b"))
    gram = pair.groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("g"))
    right = cells.select("w", "y", F.explode("x").alias("a")).groupBy(F.col("a.c").alias("i")).agg(F.sum(F.col("w") * F.col("y") * F.col("a.v")).alias("b"))
    kind = F.substring("i", 1, 1)
    right = right.withColumn("penalty", F.when(F.col("i").isin("1", "home"), 0.0).otherwise(float(ridge)))
    if prior is not None:
        known = prior.select(F.explode(F.array(*[F.struct(F.concat(F.lit(k), F.col("person_id").cast("string")).alias("i"), F.col(c).cast("double").alias("start")) for k, c in (("o", "offence"), ("d", "defence"))])).alias("p")).select("p.*")
        right = right.join(known.hint("merge"), "i", "left").withColumn("b", F.col("b") + F.col("penalty") * F.coalesce("start", F.lit(0.0))).drop("start")
    beta = solved(gram, right, small=small).where(~F.col("i").isin("1", "home"))
    side = lambda k: F.coalesce(F.max(F.when(kind == k, F.col("x"))), F.lit(0.0))
    return beta.groupBy(F.expr("cast(substring(i, 2) as long)").alias("person_id")).agg(side("o").alias("offence"), side("d").alias("defence"))


def decayed(stints: DataFrame, date: str, on: str, half_life: float, window: int) -> DataFrame:
    """Stints of the `window` days before a date with their possessions and points weighted down by age."""
    age = F.datediff(F.lit(on).cast("date"), F.col(date))
    rows = stints.where((age > 0) & (age <= window))
    w = E.decay(F.datediff(F.lit(on).cast("date"), F.col(date)), half_life)
    return rows.withColumns({c: F.col(c) * w for c in ("home_pts", "away_pts", "home_poss", "away_poss")})


def pair_sums(stints: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Stints by group and line-ups: `by`, off, def, home, w, wy, wyy (sums of weight, weight x y and weight x y^2), n.

    y is points per 100 possessions, the weight possessions, times `weight` where it is given.
    """
    more = F.lit(1.0) if weight is None else weight
    side = lambda o, d, home: F.struct(F.col(f"{o}_lineup").alias("off"), F.col(f"{d}_lineup").alias("def"), F.col(f"{o}_pts").cast("double").alias("pts"), F.col(f"{o}_poss").cast("double").alias("poss"), F.lit(home).alias("home"))
    rows = stints.select(*by, more.alias("k"), F.explode(F.array(side("home", "away", 1.0), side("away", "home", 0.0))).alias("s")).select(*by, "k", "s.*").where("poss > 0")
    y = 100 * F.col("pts") / F.col("poss")
    w = F.col("k") * F.col("poss")
    return rows.groupBy(*by, "off", "def", "home").agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.count("*").alias("n"))


def gram_cells(sums: DataFrame, by: list[str]) -> DataFrame:
    """`by`, i, j (i <= j), g, n: sums of weighted products of the columns o<player>, d<player>, 1, home and y; one aggregate.

    What `pair_sums` adds up has one design row, so only the cell of y with itself needs more than the mean of y.
    """
    entry = lambda kind, sign: lambda p: F.struct(F.concat(F.lit(kind), p.cast("string")).alias("c"), F.lit(sign).alias("v"))
    one = lambda name, value: F.struct(F.lit(name).alias("c"), value.cast("double").alias("v"))
    x = F.concat(F.transform("off", entry("o", 1.0)), F.transform("def", entry("d", -1.0)), F.array(one("1", F.lit(1.0)), one("home", F.col("home")), one("y", F.col("wy") / F.col("w"))))
    pair = sums.select(*by, "w", "n", (F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")).alias("more"), x.alias("x")).select(*by, "w", "n", "more", F.explode("x").alias("a"), "x")
    pair = pair.select(*by, "w", "n", "more", "a", F.explode("x").alias("b")).where("a.c <= b.c")
    g = F.col("w") * F.col("a.v") * F.col("b.v") + F.when((F.col("a.c") == "y") & (F.col("b.c") == "y"), F.col("more")).otherwise(0.0)
    return pair.groupBy(*by, F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(g).alias("g"), F.sum("n").alias("n"))


def system_of(cells: DataFrame, system: str, ridge: Column, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """gram (system, i, j, g) and right (system, i, b, penalty) of `gram_cells`; prior: system, i, start."""
    inner = cells.where("i <> 'y' and j <> 'y'")
    gram = inner.select(system, "i", "j", "g").unionByName(inner.where("i <> j").select(system, F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    right = cells.where("j = 'y' and i <> 'y'").select(system, "i", F.col("g").alias("b"), F.when(F.col("i").isin("1", "home"), 0.0).otherwise(ridge).alias("penalty"))
    if prior is not None:
        right = right.join(prior.hint("merge"), [system, "i"], "left").withColumn("b", F.col("b") + F.col("penalty") * F.coalesce("start", F.lit(0.0))).drop("start")
    return gram, right


def ridge_by_folds(stints: DataFrame, game: str, ridges: list[float], folds: int = 5, small: int = 2000) -> DataFrame:
    """ridge, weighted_mse, folds: how ridges foresee games that they were not fitted on.

    A game lies in one fold by a hash of its id, so a stint never foretells itself. The stints are read once, for the
    cells of each fold; a fold's system is the sum of the others' cells, and its error follows from its own: with
    coefficients x, yy - 2 x'b + x'Gx.
    """
    dealt = stints.withColumn("_fold", F.pmod(F.xxhash64(F.col(game).cast("string")), F.lit(folds)).cast("int"))
    cells = kept(gram_cells(pair_sums(dealt, ["_fold"]), ["_fold"]))
    others = F.expr(f"filter(sequence(0, {folds - 1}), f -> f <> _fold)")
    train = cells.select(F.explode(others).alias("_held"), "i", "j", "g").groupBy("_held", "i", "j").agg(F.sum("g").alias("g"))
    train = train.select(F.explode(F.expr(f"transform(sequence(0, {len(ridges) - 1}), k -> _held * {len(ridges)} + k)")).alias("system"), "i", "j", "g")
    ridge = F.element_at(F.array(*map(F.lit, map(float, ridges))), F.col("system") % len(ridges) + 1)
    x = solved_each(*system_of(train, "system", ridge), "system", small).withColumn("_fold", F.floor(F.col("system") / len(ridges)).cast("int"))
    x = kept(x.unionByName(cells.select("_fold").distinct().select(F.explode(F.expr(f"transform(sequence(0, {len(ridges) - 1}), k -> _fold * {len(ridges)} + k)")).alias("system"), F.lit("y").alias("i"), F.lit(-1.0).alias("x"), "_fold")))
    both = cells.withColumn("twice", F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)).join(x.select("_fold", "i", "system", F.col("x").alias("xi")), ["_fold", "i"])
    both = both.join(x.select("system", F.col("i").alias("j"), F.col("x").alias("xj")), ["system", "j"])
    # a player who is in the held fold alone has no coefficient, which counts as 0: the inner joins leave such cells out
    error = both.groupBy(F.col("system") % len(ridges)).agg(F.sum(F.col("g") * F.col("twice") * F.col("xi") * F.col("xj")).alias("sse")).toDF("k", "sse")
    weight = cells.where("i = '1' and j = '1'").agg(F.sum("g").alias("weight"), F.count("*").alias("folds"))
    ridge = F.element_at(F.array(*map(F.lit, map(float, ridges))), F.col("k").cast("int") + 1)
    return error.crossJoin(F.broadcast(weight)).select(ridge.alias("ridge"), (F.col("sse") / F.col("weight")).alias("weighted_mse"), F.col("folds").cast("int").alias("folds"))  # one row


def asof_cells(stints: DataFrame, date: str, first: str, half_life: float | None = None, window: int | None = None, step: int = 7, last: str | None = None) -> DataFrame:
    """asof, i, j, g, n: the cells of the stints before each cut-off, weighted down by age, from dated blocks.

    Cut-offs lie `step` days apart from `first` to `last` (the first after the last stint, unless given). Stints are added
    up once, by the block between two cut-offs that they lie in, weighted as of the block's end. A cut-off takes the
    blocks of the last `window` days (all, if None), each weighted down by its own age: no week reads the history again.
    """
    if window is not None and window % step:
        raise ValueError("the window must be a whole number of steps")
    age = F.datediff(F.col(date), F.lit(first).cast("date"))
    block = F.floor(age / step).cast("int") + 1  # of the cut-off that ends it
    old = F.lit(first).cast("date") + 0
    end = F.date_add(old, block * step)
    weight = F.lit(1.0) if half_life is None else E.decay(F.datediff(end, F.col(date)), half_life)
    dated = stints.where(F.col(date).isNotNull()).withColumns({"_block": block, "_weight": weight})
    cells = kept(gram_cells(pair_sums(dated, ["_block"], F.col("_weight")), ["_block"]))
    upto = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) / step if last else None
    if upto is None:
        end_block = cells.agg(F.max("_block")).first()[0]
        upto = F.lit(0 if end_block is None else end_block)
    upto = F.floor(upto).cast("int")
    reach = upto if window is None else F.least(upto, F.col("_block") + (window // step - 1))
    start = F.greatest(F.col("_block"), F.lit(0))
    spread = cells.where(start <= reach).withColumn("_cut", F.explode(F.sequence(start, reach)))
    fade = F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), (F.col("_cut") - F.col("_block")) * step / half_life)
    return spread.groupBy(F.date_add(old, F.col("_cut") * step).alias("asof"), "i", "j").agg(F.sum(F.col("g") * fade).alias("g"), F.sum("n").alias("n"))


def asof_ratings(cells: DataFrame, ridge: float, prior: DataFrame | None = None, least: int = 1, small: int = 2000) -> DataFrame:
    """Ratings as of each cut-off of `asof_cells`: asof, person_id, offence, defence, off_poss, def_poss, intercept, home, n_rows.

    prior: asof, person_id, offence, defence (points per 100). off_poss, def_poss: the weighted possessions behind a
    rating. Cut-offs with fewer than `least` rows (one for each side of a stint that had the ball) have none. A player without rows before a
    cut-off has no rating there.
    """
    cells = kept(cells)
    counts = cells.where("i = '1' and j = '1'").select("asof", F.col("n").alias("n_rows")).where(F.col("n_rows") >= least)
    cells = cells.join(F.broadcast(counts.select("asof")), "asof")  # a row per cut-off
    start = None
    if prior is not None:
        side = lambda k, c, sign: F.struct(F.concat(F.lit(k), F.col("person_id").cast("string")).alias("i"), (sign * F.col(c)).cast("double").alias("start"))
        start = prior.select("asof", F.explode(F.array(side("o", "offence", 1), side("d", "defence", 1))).alias("p")).select("asof", "p.*")
    x = kept(solved_each(*system_of(cells, "asof", F.lit(float(ridge)), start), "asof", small))
    fixed = x.where("i in ('1', 'home')").groupBy("asof").agg(F.max(F.when(F.col("i") == "1", F.col("x"))).alias("intercept"), F.max(F.when(F.col("i") == "home", F.col("x"))).alias("home"))
    seen = cells.where("i = j and i not in ('1', 'home', 'y')").select("asof", "i", F.col("g").alias("poss"))
    rows = x.where("i not in ('1', 'home')").join(seen, ["asof", "i"])
    side = lambda k, c: F.coalesce(F.max(F.when(F.substring("i", 1, 1) == k, F.col(c))), F.lit(0.0))
    rows = rows.groupBy("asof", F.expr("cast(substring(i, 2) as long)").alias("person_id")).agg(side("o", "x").alias("offence"), side("d", "x").alias("defence"), side("o", "poss").alias("off_poss"), side("d", "poss").alias("def_poss"))
    return rows.join(F.broadcast(fixed), "asof").join(F.broadcast(counts), "asof")


def level_prior(levels: DataFrame, cutoffs: DataFrame, scale: float, split: float = 0.5, lookback: int = 400, step: int = 7) -> DataFrame:
    """A prior from filtered levels: asof, person_id, offence, defence, level (less the mean).

    levels: person_id, game_date, level, minutes. cutoffs: asof, `step` days apart. A player's last level before a
    cut-off, at most `lookback` days old, less the mean of all players' by minutes (1 at least), times `scale`, shared out
    by `split`. Of several rows of a player's day the one with the most minutes counts, then the higher level.
    """
    first = cutoffs.agg(F.min("asof"), F.max("asof")).first()
    if first[0] is None:
        return cutoffs.sparkSession.createDataFrame([], "asof date, person_id long, offence double, defence double, level double")
    day = F.datediff("game_date", F.lit(first[0]))
    known = levels.where("level is not null").select("person_id", "game_date", "level", F.col("minutes").cast("double").alias("minutes"))
    # the first cut-off after the row; only a player's last row before each can be the last before a later one
    known = known.withColumn("cut", F.greatest(F.lit(0), F.floor(day / step).cast("int") + 1))
    newest = F.max(F.struct("game_date", "minutes", "level")).alias("row")
    known = known.groupBy("person_id", "cut").agg(newest).select("person_id", "cut", "row.*")
    reach = F.least(F.lit((first[1] - first[0]).days // step), F.floor((F.datediff("game_date", F.lit(first[0])) + lookback) / step).cast("int"))
    spread = known.where(F.col("cut") <= reach).withColumn("asof", F.explode(F.sequence(F.col("cut"), reach))).groupBy("asof", "person_id").agg(newest)
    rows = spread.select(F.date_add(F.lit(first[0]), F.col("asof") * step).alias("asof"), "person_id", "row.level", F.greatest(F.coalesce("row.minutes", F.lit(0.0)), F.lit(1.0)).alias("w"))
    mean = rows.groupBy("asof").agg((F.sum(F.col("level") * F.col("w")) / F.sum("w")).alias("mean"))
    centred = rows.join(F.broadcast(mean), "asof").join(F.broadcast(cutoffs.select("asof").distinct()), "asof").withColumn("level", F.col("level") - F.col("mean"))  # a row per cut-off
    return centred.select("asof", "person_id", (F.col("level") * scale * split).alias("offence"), (F.col("level") * scale * (1 - split)).alias("defence"), "level")


def prior_scale(ratings: DataFrame, levels: DataFrame, least: float = 2000.0) -> float | None:
    """The slope of ratings on centred levels, pooled over all cut-offs; None without players of both.

    ratings: asof, person_id, offence, defence, off_poss (`least` or more count). levels: asof, person_id, level. Take
    cut-offs before those that the prior will be used for.
    """
    rows = ratings.where(F.col("off_poss") >= least).join(levels.select("asof", "person_id", "level"), ["asof", "person_id"]).select(F.col("level").alias("x"), (F.col("offence") + F.col("defence")).alias("y"))
    row = rows.agg(F.covar_pop("x", "y"), F.var_pop("x")).first()
    return row[0] / row[1] if row[1] else None
