"""Play-by-play operators over events rendered as feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import ratings as R
from tallyspark.operators import sequence as S
from tallyspark.plans.base import query
from tallyspark.sources import boxscores as B


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one game's normalised feed: five kinds of plays of two teams."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = B.table(spark, sf_dir, "events").withColumn("k", k)
    kind = F.when(F.col("event_type").isin("view", "click"), "shot").when(F.col("event_type") == "purchase", "ft").when(F.col("event_type") == "signup", "reb").otherwise("tov")
    made = F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "purchase", F.col("k") % 4 != 0).otherwise(False)
    rows = e.select(
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("game_id"),
        F.col("event_id").alias("feed_pos"),
        F.lit(1).alias("period"),
        ((F.dayofmonth("ts") * 24 + F.hour("ts")) % 720).cast("double").alias("at"),
        (F.col("k") % 2).cast("long").alias("team"),
        (F.col("k") % 10).cast("long").alias("pid"),
        kind.alias("kind"),
        made.alias("made"),
        F.lit(1).alias("n"),
        F.lit(1).alias("m"),
        F.lit(False).alias("technical"),
        F.lit(False).alias("flagrant"),
        (F.col("k") % 3 == 0).alias("is_oreb"),
    )
    return rows.withColumn("pts", F.when(F.col("made"), F.when(F.col("kind") == "shot", 2).otherwise(1)).otherwise(0)).withColumn("is_oreb", F.when(F.col("kind") == "reb", F.col("is_oreb")))


@query(
    "q5_possessions",
    """WITH k AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
    e AS (SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, event_id AS pos, CAST((day(ts) * 24 + hour(ts)) % 720 AS DOUBLE) AS t, CAST(k % 2 AS BIGINT) AS team, k % 10 AS pid,
        CASE WHEN event_type IN ('view', 'click') THEN 'shot' WHEN event_type = 'purchase' THEN 'ft' WHEN event_type = 'signup' THEN 'reb' ELSE 'tov' END AS kind,
        CASE event_type WHEN 'view' THEN true WHEN 'purchase' THEN k % 4 <> 0 ELSE false END AS made, CASE WHEN event_type = 'signup' THEN k % 3 = 0 END AS oreb FROM k),
    a AS (SELECT *, coalesce(kind = 'shot' AND made AND lead(kind) OVER f = 'ft' AND lead(pid) OVER f = pid AND lead(t) OVER f = t, false) AS and1, CASE WHEN kind = 'reb' AND NOT oreb THEN NULL ELSE team END AS own FROM e WINDOW f AS (PARTITION BY game_id ORDER BY pos)),
    b AS (SELECT *, CASE WHEN kind = 'shot' AND made AND NOT and1 THEN 'make' WHEN kind = 'ft' AND made THEN 'ft' WHEN kind = 'tov' THEN 'tov' WHEN kind = 'reb' AND NOT oreb THEN 'dreb' END AS fin,
        coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS off FROM a),
    c AS (SELECT *, lag(fin) OVER f IS NOT NULL AS ended, off <> lag(off) OVER f AS other FROM b WINDOW f AS (PARTITION BY game_id ORDER BY pos)),
    d AS (SELECT *, sum(CAST(coalesce(ended OR other, true) AND NOT (ended AND kind = 'reb') AS INTEGER)) OVER (PARTITION BY game_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS i FROM c),
    g AS (SELECT game_id, i, arg_min_null(off, pos) AS off_team, min(t) AS first_at, max(t) AS end_at, sum(CASE WHEN made THEN CASE kind WHEN 'shot' THEN 2 WHEN 'ft' THEN 1 ELSE 0 END ELSE 0 END) AS points,
        1 + count(*) FILTER (WHERE kind = 'reb' AND oreb) AS n_chances, coalesce(arg_max_null(fin, pos), 'anomaly') AS end_type FROM d WHERE NOT (ended AND kind = 'reb') AND i >= 0 GROUP BY game_id, i)
    SELECT game_id, CAST(i AS BIGINT) AS possession_idx, 1 AS period, off_team, end_at, CAST(points AS BIGINT) AS points, n_chances, end_type,
        coalesce(lag(end_at) OVER w, first_at) AS start_at, coalesce(lag(end_type) OVER w, 'period_start') AS start_type FROM g WINDOW w AS (PARTITION BY game_id ORDER BY i)""",
)
def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.possessions(feed(spark, sf_dir)).drop("events", "flags")


@query(
    "g12_points_reconciled",
    """SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, CAST(sum(CASE event_type WHEN 'view' THEN 2 WHEN 'purchase' THEN CAST(CAST(props->>'$.k' AS INTEGER) % 4 <> 0 AS INTEGER) ELSE 0 END) AS BIGINT) AS points FROM events GROUP BY user_id
    HAVING bool_or(event_type <> 'signup')""",
)
def points_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.possessions(feed(spark, sf_dir)).groupBy("game_id").agg(F.sum("points").alias("points"))


@query(
    "q2_starters",
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS sub, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
    u AS (SELECT user_id, k % 2 AS s, k % 10 AS pid, event_id, CASE WHEN sub THEN 'out' ELSE 'did' END AS w FROM e UNION ALL SELECT user_id, k % 2, (k + 20) % 40, event_id, 'in' FROM e WHERE sub),
    f AS (SELECT user_id, s, pid, min(event_id) FILTER (WHERE w = 'in') AS i, min(event_id) FILTER (WHERE w = 'out') AS o, min(event_id) FILTER (WHERE w = 'did') AS d FROM u WHERE pid <> 0 GROUP BY ALL)
    SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, CASE s WHEN 0 THEN 'home' ELSE 'away' END AS side, CAST(pid AS BIGINT) AS pid FROM f WHERE o < i OR (i IS NULL AND (o IS NOT NULL OR d IS NOT NULL))""",
)
def starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    sub = F.col("event_type") == "error"
    e = B.table(spark, sf_dir, "events").select(
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("game_id"), F.lit(1).alias("period"), F.col("event_id").alias("feed_pos"), F.when(k % 2 == 0, "home").otherwise("away").alias("side"),
        (k % 10).cast("long").alias("pid"), F.when(sub, "sub").otherwise("shot").alias("kind"), F.when(sub, (k + 20) % 40).cast("long").alias("sub_in"),
    )
    return S.period_starters(e).select("game_id", "side", "pid")


def line_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as stints: an order is a game, 40 players by part and supplier number, points by quantity."""
    line = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q"))
    five = lambda base: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (base + i * 7) % 40)
    return line.select(
        F.col("l_orderkey").alias("game_id"), F.col("l_shipdate").cast("date").alias("day"), five(F.col("l_partkey")).alias("home_lineup"), five(F.col("l_suppkey") + 3).alias("away_lineup"),
        F.col("q").alias("home_pts"), (50 - F.col("q")).alias("away_pts"), F.lit(25).alias("home_poss"), F.lit(25).alias("away_poss"),
    )


@query("m14_ridge_ratings")
def ridge_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ridge_ratings(R.design(line_stints(spark, sf_dir)), 200.0)


#: Ridges that are tried, the first cut-off, days between cut-offs, the window and the half-life of as-of ratings.
RIDGES, FIRST_CUT, STEP, WINDOW, HALF_LIFE = [100.0, 500.0, 2000.0, 8000.0], "1992-07-01", 91, 364, 180.0


@query("m14_ridge_by_folds")
def ridge_by_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each ridge foresees games that it wasn't fitted on, over five folds of games."""
    return R.ridge_by_folds(line_stints(spark, sf_dir), "game_id", RIDGES)


def quarter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.asof_cells(line_stints(spark, sf_dir), "day", FIRST_CUT, HALF_LIFE, WINDOW, STEP)


@query("m14_asof_ratings")
def asof_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as of every quarter, drawn towards each player's own level before it.

    A player's level is the mean quantity of a quarter; what a point of it is worth is the slope of unaided ratings on
    levels over the first eight cut-offs, and ratings with the prior begin after them.
    """
    cells = R.kept(quarter_cells(spark, sf_dir))
    line = B.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("person_id"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("game_date"), F.col("l_quantity").cast("double").alias("q"))
    levels = line.groupBy("person_id", "game_date").agg(F.avg("q").alias("level"), F.count("*").cast("double").alias("minutes"))
    cuts = cells.select("asof").distinct()
    bare = F.date_add(F.lit(FIRST_CUT).cast("date"), 8 * STEP)
    early = R.asof_ratings(cells.where(F.col("asof") < bare), 2000.0)
    centred = R.level_prior(levels, cuts, 1.0, step=STEP)
    scale = R.prior_scale(early, centred, least=1.0) or 0.0
    prior = centred.select("asof", "person_id", (F.col("offence") * scale).alias("offence"), (F.col("defence") * scale).alias("defence"))
    return R.asof_ratings(cells.where(F.col("asof") >= bare), 2000.0, prior)


@query(
    "m14_asof_sums",
    f"""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS d, l_partkey AS h, l_suppkey + 3 AS a, CAST(l_quantity AS DOUBLE) AS q, 25.0 AS poss FROM lineitem),
    sides AS (SELECT d, h AS base, 100 * q AS y FROM s UNION ALL SELECT d, a, 100 * (50 - q) FROM s),
    people AS (SELECT d, (base + 7 * unnest(range(0, 5))) % 40 AS person_id, y FROM sides),
    cuts AS (SELECT DATE '{FIRST_CUT}' + CAST({STEP} * c AS INTEGER) AS cut FROM range(0, 40) AS t(c)),
    seen AS (SELECT cut, person_id, power(0.5, (cut - d) / {HALF_LIFE}) AS w, y FROM people JOIN cuts ON d < cut AND d >= cut - {WINDOW}),
    top AS (SELECT max(d) AS d FROM s)
    SELECT cut AS "asof", CAST(person_id AS BIGINT) AS person_id, round(sum(25 * w), 4) AS off_poss, round(sum(w * y) / sum(25 * w), 4) AS per_100, CAST(count(*) AS BIGINT) AS rows_seen
    FROM seen, top WHERE cut <= DATE '{FIRST_CUT}' + CAST({STEP} * (floor((top.d - DATE '{FIRST_CUT}') / {STEP}.0) + 1) AS INTEGER) GROUP BY cut, person_id""",
)
def asof_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each player's rating rests on: weighted possessions, points per 100 of them while on the floor, and rows."""
    own = quarter_cells(spark, sf_dir).where("substring(i, 1, 1) = 'o' and (j = i or j = 'y')")
    rows = own.groupBy("asof", F.expr("cast(substring(i, 2) as long)").alias("person_id")).agg(F.max(F.when(F.col("j") == "y", F.col("g"))).alias("y"), F.max(F.when(F.col("j") != "y", F.col("g"))).alias("w"), F.max("n").alias("rows_seen"))
    return rows.select("asof", "person_id", F.round("w", 4).alias("off_poss"), F.round(F.col("y") / F.col("w"), 4).alias("per_100"), "rows_seen")
