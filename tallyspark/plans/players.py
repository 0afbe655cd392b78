"""Player-games: as-of valuation, availability, seasons, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import asof as A
from tallyspark.operators import availability as V
from tallyspark.operators import trailing as T
from tallyspark.plans.base import query, with_player
from tallyspark.plans.factors import r
from tallyspark.sources import boxscores as B

MEANS = "means AS (SELECT person_id, season, ts, sum(score) OVER w AS s, count(score) OVER w AS n FROM log WHERE score IS NOT NULL WINDOW w AS (PARTITION BY person_id, season ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
OUT = f"""{MEANS}, last AS (SELECT person_id, CAST(CAST(left(season, 4) AS INTEGER) + 1 AS VARCHAR) || '_' || lpad(CAST((CAST(left(season, 4) AS INTEGER) + 2) % 100 AS VARCHAR), 2, '0') AS season, avg(score) AS last FROM log WHERE score IS NOT NULL GROUP BY ALL),
valued AS (SELECT o.*, coalesce((m.s + 0.0) / (m.n + K), last, 0.0) AS value FROM (SELECT * FROM log WHERE status = 'inactive') o
ASOF LEFT JOIN means m ON o.person_id = m.person_id AND o.season = m.season AND o.ts > m.ts LEFT JOIN last ON o.person_id = last.person_id AND o.season = last.season)"""


@query("j8_strict_asof", with_player(f", {MEANS} SELECT o.game_id, o.person_id, round((m.s + 0.0) / m.n, 6) AS mean FROM (SELECT * FROM log WHERE status = 'inactive') o ASOF LEFT JOIN means m ON o.person_id = m.person_id AND o.season = m.season AND o.ts > m.ts"))
def strict_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir)
    means = V.running(log, "score", V.PLAYER, ["ts"]).select(*V.PLAYER, "ts", "mean")
    return A.asof(log.where("status = 'inactive'"), means, V.PLAYER, "ts", ["mean"]).select("game_id", "person_id", r("mean"))


@query(
    "j9_nonstrict_asof",
    with_player(", d AS (SELECT person_id, game_date, max(minutes) AS m FROM log WHERE minutes IS NOT NULL GROUP BY ALL) SELECT o.game_id, o.person_id, d.m AS minutes_asof FROM (SELECT * FROM log WHERE status <> 'played') o ASOF LEFT JOIN d ON o.person_id = d.person_id AND o.game_date >= d.game_date"),
)
def nonstrict_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir)
    daily = log.where("minutes is not null").groupBy("person_id", "game_date").agg(F.max("minutes").alias("minutes_asof"))
    return A.asof(log.where("status <> 'played'"), daily, ["person_id"], "game_date", ["minutes_asof"], strict=False).select("game_id", "person_id", "minutes_asof")


@query("j10_latest_snapshot", with_player("SELECT game_id, person_id, score FROM log WHERE game_date = (SELECT max(game_date) FROM log WHERE game_date <= DATE '2024-01-17')"))
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_snapshot(B.player_log(spark, sf_dir), "game_date", "2024-01-17").select("game_id", "person_id", "score")


SIDES = "SELECT game_date, team_id, round(coalesce(sum(CASE WHEN is_home THEN value END), 0), 3) AS home_out, round(coalesce(sum(CASE WHEN NOT is_home THEN value END), 0), 3) AS away_out, round(coalesce(sum(CASE WHEN is_home THEN value END), 0) - coalesce(sum(CASE WHEN NOT is_home THEN value END), 0), 3) AS diff FROM valued GROUP BY game_date, team_id"


def sides(spark: SparkSession, sf_dir: str, k: float) -> DataFrame:
    valued = V.valued_absences(B.player_log(spark, sf_dir), F.col("status") == "inactive", "score", "ts", k)
    return V.side_difference(valued, ["game_date", "team_id"], "value_asof").select("game_date", "team_id", *[r(c, places=3) for c in ("home_out", "away_out", "diff")])


@query("g3_j11_availability", with_player(f", {OUT.replace('K', '0')} {SIDES}"))
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir, 0.0)


@query("g4_shrunk_availability", with_player(f", {OUT.replace('K', '12')} {SIDES}"))
def shrunk_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir, 12.0)


@query(
    "g5_w10_depletion",
    with_player(""", a AS (SELECT *, row_number() OVER (PARTITION BY game_date, team_id ORDER BY v DESC NULLS LAST, person_id) AS e, row_number() OVER (PARTITION BY game_date, team_id, here ORDER BY v DESC NULLS LAST, person_id) AS h
    FROM (SELECT game_date, team_id, person_id, bool_or(status = 'played') AS here, CAST(max(coalesce(score, 100)) AS DOUBLE) AS v FROM log GROUP BY ALL))
    SELECT game_date, team_id, coalesce(sum(v) FILTER (WHERE e <= 3), 0.0) AS "full", coalesce(sum(v) FILTER (WHERE here AND h <= 3), 0.0) AS present, coalesce(sum(v) FILTER (WHERE e <= 3), 0.0) - coalesce(sum(v) FILTER (WHERE here AND h <= 3), 0.0) AS depletion FROM a GROUP BY game_date, team_id"""),
)
def depletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.player_log(spark, sf_dir).groupBy("game_date", "team_id", "person_id").agg(F.bool_or(F.col("status") == "played").alias("here"), F.max(F.coalesce("score", F.lit(100))).cast("double").alias("v"))
    return V.depletion(rows, ["game_date", "team_id"], "v", F.col("here"), top=3)


@query("j13_absent_not_listed", with_player("SELECT game_id, person_id FROM log a WHERE status = 'inactive' AND NOT EXISTS (SELECT 1 FROM log b WHERE b.status = 'played' AND a.person_id = b.person_id AND a.game_date = b.game_date)"))
def absent_not_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir)
    return V.absent_not_listed(log.where("status = 'inactive'"), log.where("status = 'played'"), ["person_id", "game_date"]).select("game_id", "person_id")


@query("j14_usable_games", with_player("SELECT game_id, team_id FROM log WHERE team_id IN (SELECT team_id FROM log GROUP BY team_id HAVING count(*) FILTER (WHERE status = 'played') >= 3)"))
def usable_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir)
    teams = log.groupBy("team_id").agg(F.count_if(F.col("status") == "played").alias("n")).where("n >= 3")
    return log.join(teams, "team_id", "left_semi").select("game_id", "team_id")


@query("j15_conflicts", with_player("SELECT count(*) AS conflicts FROM (SELECT DISTINCT person_id, game_date FROM log WHERE status = 'played') JOIN (SELECT DISTINCT person_id, game_date FROM log WHERE status = 'inactive') USING (person_id, game_date)"))
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir).select("person_id", "game_date", "status")
    by = log.groupBy("person_id", "game_date").agg(F.bool_or(F.col("status") == "played").alias("p"), F.bool_or(F.col("status") == "inactive").alias("i"))
    return by.agg(F.count_if(F.col("p") & F.col("i")).alias("conflicts"))


@query(
    "w8_missed_streak",
    with_player(""", n AS (SELECT *, row_number() OVER (PARTITION BY person_id, season ORDER BY ts) AS gn FROM log)
    SELECT game_id, person_id, CAST(gn - 1 - max(CASE WHEN status = 'played' THEN gn END) OVER (PARTITION BY person_id, season ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS missed FROM n"""),
)
def missed_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.player_log(spark, sf_dir).withColumn("p", F.col("status") == "played")
    return T.missed_streak(rows, V.PLAYER, ["ts"], "p", "missed").select("game_id", "person_id", "missed")


@query(
    "w5_running_mean",
    with_player("""SELECT game_id, person_id, round(avg(score) OVER (PARTITION BY person_id, season ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS incl,
    round(avg(score) OVER (PARTITION BY person_id, season ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS excl FROM log"""),
)
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy(*V.PLAYER).orderBy("ts")
    log = B.player_log(spark, sf_dir)
    return log.select("game_id", "person_id", r(F.avg("score").over(w.rowsBetween(W.unboundedPreceding, 0)), "incl"), r(F.avg("score").over(w.rowsBetween(W.unboundedPreceding, -1)), "excl"))


@query("w11_expected_minutes", with_player("SELECT game_id, person_id, round(avg(minutes) OVER (PARTITION BY person_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS expected FROM log"))
def expected_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("person_id").orderBy("ts").rowsBetween(-19, 0)
    return B.player_log(spark, sf_dir).select("game_id", "person_id", r(F.avg("minutes").over(w), "expected"))


@query(
    "w12_form_frames",
    with_player(f"""SELECT game_id, {', '.join(f'round(avg(score) OVER (PARTITION BY person_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS score_l{n}' for n in (5, 10, 15, 20))},
    round(avg(score) OVER (PARTITION BY person_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS score_career,
    round(avg(score) OVER (PARTITION BY person_id, season ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS score_season,
    count(score) OVER (PARTITION BY person_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM log"""),
)
def form_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.form_frames(B.player_log(spark, sf_dir), ["person_id"], "season", ["ts"], "score")
    return rows.select("game_id", *[r(f"score_{x}") for x in ("l5", "l10", "l15", "l20", "career", "season")], "n_prior")


@query(
    "g14_player_seasons",
    with_player(""", t AS (SELECT person_id, season, team_id, CAST(sum(minutes) AS BIGINT) AS m, count(minutes) AS g FROM log GROUP BY ALL)
    SELECT person_id, season, minutes, gp, main_team, round(minutes / nullif(gp, 0), 6) AS mpg, CAST(row_number() OVER (PARTITION BY person_id ORDER BY season) - 1 AS INTEGER) AS n_prior FROM
    (SELECT person_id, season, CAST(sum(m) AS BIGINT) AS minutes, CAST(sum(g) AS BIGINT) AS gp, arg_max(team_id, (coalesce(m, 0), -team_id)) AS main_team FROM t GROUP BY ALL)"""),
)
def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.player_seasons(B.player_log(spark, sf_dir)).withColumn("mpg", r("mpg"))


@query(
    "g15_opening_roster",
    with_player("""SELECT season, team_id, person_id, status FROM (SELECT *, row_number() OVER (PARTITION BY season, team_id, person_id ORDER BY CAST(status <> 'played' AS INTEGER), ts) AS n
    FROM log l WHERE game_date = (SELECT min(game_date) FROM log m WHERE m.season = l.season AND m.team_id = l.team_id)) WHERE n = 1"""),
)
def opening_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.opening_roster(B.player_log(spark, sf_dir), ["ts"]).select("season", "team_id", "person_id", "status")


@query(
    "w14_average_rank",
    with_player(""", t AS (SELECT team_id, person_id, CAST(count(score) AS BIGINT) AS n FROM log GROUP BY ALL)
    SELECT team_id, person_id, n, rank() OVER (PARTITION BY team_id ORDER BY n DESC) + (count(*) OVER (PARTITION BY team_id, n) - 1) / 2.0 AS avg_rank, CAST(rank() OVER (PARTITION BY team_id ORDER BY n DESC) AS INTEGER) AS min_rank FROM t"""),
)
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.player_log(spark, sf_dir).groupBy("team_id", "person_id").agg(F.count("score").alias("n"))
    rank = F.rank().over(W.partitionBy("team_id").orderBy(F.desc("n")))
    return rows.select("team_id", "person_id", "n", (rank + (F.count("*").over(W.partitionBy("team_id", "n")) - 1) / 2.0).cast("double").alias("avg_rank"), rank.alias("min_rank"))


@query("w17_last_row", with_player("SELECT person_id, game_id, score FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ts DESC, game_id DESC) AS n FROM log) WHERE n = 1"))
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("game_id", "score"), F.struct("ts", "game_id"))  # an aggregate: no sort of the history
    return B.player_log(spark, sf_dir).groupBy("person_id").agg(last.alias("x")).select("person_id", "x.game_id", "x.score")


@query("w20_w22_calendar", with_player("SELECT season, CAST(unnest(generate_series(min(game_date) + INTERVAL 14 DAYS, max(game_date), INTERVAL 7 DAYS)) AS DATE) AS cutoff FROM log GROUP BY season"))
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = B.player_log(spark, sf_dir).groupBy("season").agg(F.min("game_date").alias("a"), F.max("game_date").alias("b"))
    days = days.withColumn("a", F.date_add("a", 14)).where("a <= b")
    return days.select("season", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("cutoff"))


@query("p6_game_score", "SELECT event_id, round(v + 0.4 * k - 0.7 * (k % 7) - 0.4 * (k % 5 - k % 3) + 0.7 * (k % 4) + 0.3 * (k % 6) + k % 2 + 0.7 * (k % 8) + 0.7 * (k % 9) - 0.4 * (k % 10) - k % 11, 6) AS score FROM (SELECT event_id, value AS v, CAST(props->>'$.k' AS INTEGER) AS k FROM events)")
def game_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    names = {"fga": 7, "fta": 5, "ftm": 3, "oreb": 4, "dreb": 6, "stl": 2, "ast": 8, "blk": 9, "pf": 10, "tov": 11}
    rows = B.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("pts"), k.alias("fgm"), *[(k % n).alias(c) for c, n in names.items()])
    return rows.select("event_id", r(E.game_score(), "score"))


@query("l2_leaders", with_player("SELECT person_id, n, mean FROM (SELECT person_id, count(score) AS n, round(avg(score), 4) AS mean FROM log GROUP BY person_id HAVING count(score) >= 5) ORDER BY mean DESC, person_id LIMIT 10"))
def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.player_log(spark, sf_dir).groupBy("person_id").agg(F.count("score").alias("n"), r(F.avg("score"), "mean", 4))
    return rows.where("n >= 5").orderBy(F.desc("mean"), "person_id").limit(10)


@query("g27_counts", with_player("SELECT season, status, count(*) AS n, count(DISTINCT person_id) AS people, min(score) AS low, max(score) AS high, bool_and(is_home) AS all_home, bool_or(is_home) AS any_home FROM log GROUP BY season, status"))
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.player_log(spark, sf_dir).groupBy("season", "status").agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("people"), F.min("score").alias("low"), F.max("score").alias("high"), F.bool_and("is_home").alias("all_home"), F.bool_or("is_home").alias("any_home"))


@query("p24_decay", with_player("SELECT person_id, round(sum(score * power(0.5, date_diff('day', game_date, DATE '2024-01-31') / 10.0)) / sum(power(0.5, date_diff('day', game_date, DATE '2024-01-31') / 10.0)), 5) AS rating FROM log WHERE score IS NOT NULL GROUP BY person_id"))
def decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = E.decay(F.datediff(F.lit("2024-01-31").cast("date"), F.col("game_date")), 10.0)
    rows = B.player_log(spark, sf_dir).where("score is not null").withColumn("w", weight)
    return rows.groupBy("person_id").agg(r(F.sum(F.col("score") * F.col("w")) / F.sum("w"), "rating", 5))
