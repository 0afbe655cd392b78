"""Weighted availability, channels, components, decisions and model comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import asof as A
from tallyspark.operators import availability as V
from tallyspark.operators import likelihood as M
from tallyspark.operators import linear as L
from tallyspark.operators import names as N
from tallyspark.operators import pairing as P
from tallyspark.operators import sequence as S
from tallyspark.operators import statespace as K
from tallyspark.operators import trailing as T
from tallyspark.operators.likelihood import OuModel
from tallyspark.operators.sparse import kept
from tallyspark.plans.base import query, with_player, with_team
from tallyspark.plans.factors import live, r
from tallyspark.plans.models import league_games
from tallyspark.plans.plays import feed
from tallyspark.sources import boxscores as B


@query(
    "s14_awards",
    """SELECT person_id, season, max(tier) AS tier FROM (SELECT o_custkey AS person_id, CAST(year(o_orderdate) AS VARCHAR) || '_' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season,
    CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END AS tier FROM orders) WHERE tier IS NOT NULL GROUP BY ALL""",
)
def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award names through a dictionary, seasons such as 1999-00 normalised, tiers cast, one row per person and season."""
    tiers = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}
    tier = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])[F.col("o_orderpriority")]
    year = F.year("o_orderdate")
    raw = F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.replace(raw, F.lit("-"), F.lit("_")).alias("season"), tier.alias("tier"))
    return rows.where("tier is not null").groupBy("person_id", "season").agg(F.max("tier").alias("tier"))


RATED = """rating AS (SELECT person_id, season, ts, avg(score) OVER (PARTITION BY person_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v, minutes AS m FROM log WHERE score IS NOT NULL)"""


@query(
    "g6_rating_availability",
    with_player(f""", {RATED}, o AS (SELECT * FROM log WHERE status = 'inactive'), j AS (SELECT o.*, greatest(coalesce(r.v, 1500) - 1500, 0) * coalesce(r.m, 10) / 40.0 AS value FROM o ASOF LEFT JOIN rating r ON o.person_id = r.person_id AND o.ts > r.ts)
    SELECT game_date, team_id, round(sum(CASE WHEN is_home THEN value ELSE -value END), 7) AS diff FROM j GROUP BY game_date, team_id"""),
)
def rating_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absences worth their rating above replacement level times their share of minutes."""
    log = B.player_log(spark, sf_dir)
    w = W.partitionBy("person_id").orderBy("ts").rowsBetween(-9, 0)
    rating = log.where("score is not null").select("person_id", "ts", F.avg("score").over(w).alias("v"), F.col("minutes").alias("m"))
    out = A.asof(log.where("status = 'inactive'"), rating, ["person_id"], "ts", ["v", "m"])
    value = F.greatest(F.coalesce("v", F.lit(1500.0)) - 1500, F.lit(0.0)) * F.coalesce("m", F.lit(10)) / 40.0
    return out.groupBy("game_date", "team_id").agg(r(F.sum(F.when(F.col("is_home"), value).otherwise(-value)), "diff", 7))


@query(
    "g7_honour_availability",
    with_player(", h AS (SELECT user_id AS person_id, max(CAST(props->>'$.k' AS INTEGER)) AS honour FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT game_date, team_id, CAST(sum(coalesce(honour, 0)) AS BIGINT) AS out FROM log LEFT JOIN h USING (person_id) WHERE status = 'inactive' GROUP BY game_date, team_id"),
)
def honour_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    honours = B.table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("person_id")).agg(F.max(k).alias("honour"))
    out = B.player_log(spark, sf_dir).where("status = 'inactive'").join(honours, "person_id", "left")
    return out.groupBy("game_date", "team_id").agg(F.sum(F.coalesce("honour", F.lit(0))).alias("out"))


@query("g8_filter_availability")
def filter_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absences worth the filter's level the day before, with its variance, by side."""
    log = B.player_log(spark, sf_dir)
    played = log.where("status = 'played'").groupBy("person_id", "game_date").agg(F.avg("score").alias("score"), F.sum("minutes").alias("minutes"))
    levels = K.ou_filter(played, "person_id", "game_date", "score", "minutes", 0.02, 0.9e6, 3.5e7, 2000.0).select("person_id", "game_date", "level", "level_var")
    out = A.asof(log.where("status = 'inactive'"), levels, ["person_id"], "game_date", ["level", "level_var"])
    valued = out.withColumns({"value": F.coalesce("level", F.lit(2000.0)), "variance": F.coalesce("level_var", F.lit(0.9e6))})
    return V.side_difference(valued, ["game_date", "team_id"], "value").join(valued.groupBy("game_date", "team_id").agg(F.sum("variance").alias("variance")), ["game_date", "team_id"])


@query(
    "g10_channels",
    """SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, k % 10 AS pid, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS fga, count(*) FILTER (WHERE event_type = 'view') AS fgm, count(*) FILTER (WHERE event_type = 'purchase') AS fta, count(*) FILTER (WHERE event_type = 'signup') AS reb
    FROM (SELECT *, CAST(CAST(props->>'$.k' AS INTEGER) AS BIGINT) AS k FROM events) WHERE event_type <> 'error' GROUP BY ALL""",
)
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = feed(spark, sf_dir).where("kind <> 'tov'")
    count = lambda c, n: F.count_if(c).alias(n)
    kind = F.col("kind")
    return e.groupBy("game_id", "pid").agg(count(kind == "shot", "fga"), count((kind == "shot") & F.col("made"), "fgm"), count(kind == "ft", "fta"), count(kind == "reb", "reb"))


@query("g11_volume_leaders", with_team("SELECT season, team_id, rate FROM (SELECT season, team_id, round(sum(fg3m) / nullif(sum(fg3a), 0), 6) AS rate, sum(fg3a) AS n FROM live GROUP BY ALL HAVING sum(fg3a) >= 60) QUALIFY row_number() OVER (PARTITION BY season ORDER BY rate DESC, team_id) <= 5"))
def volume_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).groupBy("season", "team_id").agg(F.sum("fg3a").alias("n"), r(E.ratio(F.sum("fg3m"), F.sum("fg3a")), "rate")).where("n >= 60")
    best = F.row_number().over(W.partitionBy("season").orderBy(F.desc("rate"), "team_id"))
    return rows.withColumn("_b", best).where("_b <= 5").select("season", "team_id", "rate")


COMPONENTS = {"scoring": "2 * fgm + fg3m + ftm", "shooting": "-0.7 * fga - 0.4 * (fta - ftm)", "boards": "0.7 * oreb + 0.3 * dreb", "care": "-1.0 * tov"}


@query("p7_components", with_team(f"SELECT game_id, team_id, {', '.join(f'round(CAST({v} AS DOUBLE), 6) AS {k}' for k, v in COMPONENTS.items())}, round(CAST(least(greatest({' + '.join(f'({v})' for v in COMPONENTS.values())}, -20), 120) AS DOUBLE), 6) AS total FROM live"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).withColumns({k: F.expr(f"cast({v} as double)") for k, v in COMPONENTS.items()})
    total = sum((F.col(k) for k in COMPONENTS), F.lit(0.0))
    return rows.select("game_id", "team_id", *[r(k) for k in COMPONENTS], r(F.least(F.greatest(total, F.lit(-20.0)), F.lit(120.0)), "total"))


@query(
    "p25_pricing",
    with_team(", b AS (SELECT season, CAST(sum(fgm) AS DOUBLE) / sum(fga) AS lg FROM live GROUP BY season) SELECT game_id, team_id, round(0.4 * (fgm - lg * fga) / nullif(fga + opp_fga, 0), 6) AS priced FROM live JOIN b USING (season)"),
)
def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice's worth: weight times what it did beyond the league's rate, over the team's chances."""
    rows = live(spark, sf_dir)
    league = rows.groupBy("season").agg(E.ratio(F.sum("fgm"), F.sum("fga")).alias("lg"))
    return rows.join(F.broadcast(league), "season").select("game_id", "team_id", r(0.4 * E.ratio(F.col("fgm") - F.col("lg") * F.col("fga"), F.col("fga") + F.col("opp_fga")), "priced"))


def floor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten players a game, all seen at once, and substitutions at two moments."""
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id")
    games = e.groupBy(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("game_id")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side")
    shot = games.select("game_id", sides).select("game_id", "side", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("pid"), F.lit(10.0).alias("at"), F.lit("shot").alias("kind"), F.lit(None).cast("long").alias("sub_in"), F.lit(2).alias("pts"))
    sub = games.select("game_id", sides).select("game_id", "side", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("pid"))
    sub = sub.select("game_id", "side", "pid", (F.col("pid") * 200).cast("double").alias("at"), F.lit("sub").alias("kind"), (F.col("pid") + 5).alias("sub_in"), F.lit(0).alias("pts"))
    rows = shot.unionByName(sub).withColumn("period", F.lit(1))
    return rows.withColumn("feed_pos", F.row_number().over(W.partitionBy("game_id").orderBy("at", "side", "pid")).cast("long"))


@query("q3_q4_g13_stints", "SELECT g AS game_id, side, CAST(pid AS BIGINT) AS pid, CAST(CASE WHEN pid <= 2 THEN 200 * pid WHEN pid <= 5 THEN 720 ELSE 720 - 200 * (pid - 5) END AS DOUBLE) AS seconds FROM (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 10, '0') AS g FROM events), (SELECT unnest(['home', 'away']) AS side), (SELECT unnest(range(1, 8)) AS pid)")
def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = floor_events(spark, sf_dir)
    return S.lineup_channels(S.stints(events, S.period_starters(events))).select("game_id", "side", "pid", F.col("seconds"))


@query("q3_ambiguous_stints", "SELECT g AS game_id, side, CAST(pid AS BIGINT) AS pid, CAST(CASE WHEN pid <= 2 THEN 200 * pid WHEN pid <= 5 THEN 720 ELSE 720 - 200 * (pid - 5) END AS DOUBLE) AS seconds FROM (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 10, '0') AS g FROM events), (SELECT unnest(['home', 'away']) AS side), (SELECT unnest(range(1, 8)) AS pid)")
def ambiguous_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same floor where every substitute shares a family name with someone on the floor: told by who is off it."""
    events = floor_events(spark, sf_dir)
    sub = F.col("kind") == "sub"
    unnamed = events.withColumn("candidates", F.when(sub, F.array(F.col("sub_in"), F.when(F.col("sub_in") == 6, F.lit(4)).otherwise(F.lit(6)).cast("long")))).withColumn("sub_in", F.when(~sub, F.col("sub_in")))
    return S.lineup_channels(S.stints(unnamed, S.period_starters(unnamed))).select("game_id", "side", "pid", "seconds")


SECONDS = "CAST(CASE WHEN pid <= 2 THEN 200 * pid WHEN pid <= 5 THEN 720 ELSE 720 - 200 * (pid - 5) END AS DOUBLE)"


@query("q4_repaired_stints", f"SELECT g AS game_id, side, CAST(pid AS BIGINT) AS pid, {SECONDS} AS seconds FROM (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 10, '0') AS g FROM events), (SELECT unnest(['home', 'away']) AS side), (SELECT unnest(range(1, 8)) AS pid)")
def repaired_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor without a trace of two starters a side, who are found again by their minutes."""
    events = floor_events(spark, sf_dir)
    box = events.select("game_id", "side").distinct().withColumn("pid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")))).withColumn("seconds", F.expr(SECONDS))
    heard = events.where("not (kind = 'shot' and pid in (4, 5))")
    return S.lineup_channels(S.stints(heard, S.repaired_starters(heard, S.period_starters(heard), box))).select("game_id", "side", "pid", F.col("seconds"))


@query("q4_stint_audit", "SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS game_id, 1 AS period, user_id % 3 <> 0 AS usable, CASE WHEN user_id % 3 <> 0 THEN 720.0::DOUBLE ELSE 0.0::DOUBLE END AS seconds FROM (SELECT DISTINCT user_id FROM events)")
def stint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which periods have stints: in every third game a starter leaves no trace, and there is no box score to repair it."""
    events = floor_events(spark, sf_dir).where("not (kind = 'shot' and pid = 5 and cast(game_id as long) % 3 = 0)")
    return S.stint_audit(events, S.stints(events, S.period_starters(events)))


@query(
    "g34_validation_summary",
    with_team("""SELECT season, count(*) AS team_games, round(avg(CAST(abs(pts - (2 * fgm + fg3m + ftm)) < 1 AS DOUBLE)), 6) AS exact_points, round(avg(CAST(opp_pts IS NOT NULL AS DOUBLE)), 6) AS paired, round(avg(abs(pace - (fga + 0.44 * fta - oreb + tov))), 6) AS pace_gap,
    CAST(sum(CAST(fgm > fga OR fg3m > fg3a OR ftm > fta AS INTEGER)) AS BIGINT) AS impossible FROM live GROUP BY season"""),
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of checks per season: exact shares, pairing, the gap between both sides' possessions, impossible counts."""
    own = F.col("fga") + 0.44 * F.col("fta") - F.col("oreb") + F.col("tov")
    share = lambda c: F.avg(c.cast("double"))
    return live(spark, sf_dir).groupBy("season").agg(
        F.count("*").alias("team_games"),
        r(share(F.abs(F.col("pts") - (2 * F.col("fgm") + F.col("fg3m") + F.col("ftm"))) < 1), "exact_points"),
        r(share(F.col("opp_pts").isNotNull()), "paired"),
        r(F.avg(F.abs(F.col("pace") - own)), "pace_gap"),
        F.sum(((F.col("fgm") > F.col("fga")) | (F.col("fg3m") > F.col("fg3a")) | (F.col("ftm") > F.col("fta"))).cast("int")).alias("impossible"),
    )


FACTORS = ["efg_d", "oreb_d", "tov_d", "ftr_d"]


def factor_calibration(games: DataFrame) -> dict:
    """Means, deviations and margin weights of the factor differences, from one aggregate over the calibration seasons."""
    stats = games.agg(*[f(c).alias(f"{n}_{c}") for c in FACTORS for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    means, sds = ([stats[f"{n}_{c}"] for c in FACTORS] for n in "ms")
    standard = games.select("margin", *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(FACTORS, means, sds, strict=True)])
    fit = L.fit(standard, FACTORS, "margin")
    return {"means": means, "sds": sds, "weights": [float(b) for b in fit["beta"][1:]], "home": float(fit["beta"][0]), "margin_var": float(fit["sigma2"])}


def factor_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """league_games with the home side's factor differences."""
    home = live(spark, sf_dir).where("is_home").select("game_id", *FACTORS)
    return league_games(spark, sf_dir).join(home, "game_id")


@query("q8_factor_filters")
def factor_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A joint filter of four factors of all teams of a league, with the margin as a fifth observation or without."""
    games = factor_games(spark, sf_dir)
    known = factor_calibration(games.where("season < '1995_96'"))
    parts = [K.factor_kalman(games, FACTORS, **known, margin_noise=noise, by=("season", "league")).withColumn("with_margin", F.lit(noise is not None)) for noise in (None, known["margin_var"])]
    return parts[0].unionByName(parts[1])


#: A player's score by component, from box counts. Fixed values.
PLAYER_PARTS = {"scoring": "pts + 0.4 * fgm - 0.7 * fga - 0.4 * (fta - ftm)", "rebounding": "0.7 * oreb + 0.3 * dreb", "playmaking": "0.7 * ast", "defence": "stl + 0.7 * blk", "discipline": "-0.4 * pf - tov"}


def component_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-days with the five components per 36 minutes; box counts of the roster's players by a fixed rule."""
    from tallyspark.plans.corrections import roster_log

    u = F.col("person_id") % 11 + F.col("game_id").cast("long") % 13
    counts = {"pts": F.col("score"), "fgm": F.floor(F.col("score") * 0.4), "fga": F.floor(F.col("score") * 0.4) + u % 6, "ftm": u % 4, "fta": u % 4 + u % 2, "oreb": u % 3, "dreb": u % 5, "ast": u % 7, "stl": u % 2, "blk": (u % 4 == 0).cast("int"), "pf": u % 5, "tov": (u + 1) % 3}
    rows = roster_log(spark, sf_dir).where("status = 'played'").withColumns(counts)
    days = rows.groupBy("person_id", "game_date", "season").agg(F.sum("minutes").cast("double").alias("minutes"), *[F.sum(c).cast("double").alias(c) for c in counts])
    return days.select("person_id", "game_date", "season", "minutes", *[(36 * F.expr(v) / F.col("minutes")).alias(k) for k, v in PLAYER_PARTS.items()])


@query("q10_component_filters")
def component_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of a player's five components, each with parameters fitted on the first two seasons, added up: the total's
    prediction, and its variance without and with what the components' surprises had in common in earlier seasons."""
    log = kept(component_log(spark, sf_dir))
    first = [r[0] for r in log.select("season").distinct().orderBy("season").limit(2).collect()]
    models = OuModel.each(log.where(F.col("season").isin(first)), "person_id", "game_date", list(PLAYER_PARTS), "minutes", "season")
    settings = {part: (*map(float, np.exp(best.at)), model.mu) for part, model, best in zip(PLAYER_PARTS, models, M.fitted(models), strict=True)}
    return M.component_filters(log, "person_id", "game_date", "season", "minutes", settings).select("person_id", "game_date", "total", "pred", "var", "joint_var")


@query(
    "j18_name_resolution",
    """WITH c AS (SELECT c_custkey, c_custkey // 12 AS g, c_custkey % 2 AS side, (c_custkey % 12) // 2 AS k FROM customer),
    people AS (SELECT *, CASE k WHEN 0 THEN 'luka' WHEN 1 THEN 'ivan' WHEN 2 THEN 'luis' WHEN 3 THEN 'nikola' WHEN 4 THEN 'shaquille' ELSE 'trae' END AS f,
        CASE WHEN k <= 1 THEN 'saric' WHEN k = 2 THEN 'doncic' WHEN k = 3 THEN 'jokic' WHEN k = 4 THEN 'oneal' ELSE 'young' END AS n FROM c),
    roster AS (SELECT *, left(f, 1) || ' ' || n AS s FROM people),
    asked AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN n WHEN 1 THEN s WHEN 2 THEN left(f, 3) || ' ' || n WHEN 3 THEN 'nobody' ELSE f END AS key FROM roster),
    tried AS (SELECT a.c_custkey, r.c_custkey AS p, CASE WHEN a.key = r.s THEN 0 WHEN a.key = r.n THEN 1 WHEN ends_with(a.key, ' ' || r.n) AND starts_with(r.f, split_part(a.key, ' ', 1)) THEN 2 WHEN a.key = r.f OR contains(a.key, r.n) THEN 3 END AS way
        FROM asked a JOIN roster r USING (g, side)),
    best AS (SELECT c_custkey, p, way, min(way) OVER (PARTITION BY c_custkey) AS first FROM tried WHERE way IS NOT NULL)
    SELECT a.c_custkey, CAST(count(b.p) AS INTEGER) AS candidates, CAST(CASE WHEN count(b.p) = 1 THEN min(b.p) END AS BIGINT) AS person_id FROM asked a LEFT JOIN best b ON b.c_custkey = a.c_custkey AND b.way = b.first GROUP BY a.c_custkey""",
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of twelve: two of each side share a family name; names come whole, short, cut, by one part alone, or unknown."""
    k = F.floor((F.col("c_custkey") % 12) / 2).cast("int")
    first = F.element_at(F.array(*map(F.lit, ("Luka", "Ivan", "Luis", "Nikola", "Shaquille", "Trae"))), k + 1)
    family = F.element_at(F.array(*map(F.lit, ("Šarić", "Sarić", "Dončić", "Jokić Jr.", "O'Neal", "Young"))), k + 1)
    c = B.table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 12).cast("long").alias("game_id"), F.when(F.col("c_custkey") % 2 == 0, "home").otherwise("away").alias("side"), first.alias("first_name"), family.alias("family_name"))
    c = c.withColumn("name_i", F.concat(F.substring("first_name", 1, 1), F.lit(". "), "family_name"))
    kind = F.col("c_custkey") % 5
    name = F.when(kind == 0, F.upper("family_name")).when(kind == 1, F.col("name_i")).when(kind == 2, F.concat(F.substring("first_name", 1, 3), F.lit(" "), "family_name")).when(kind == 3, "Nobody").otherwise(F.col("first_name"))
    roster = c.select("game_id", "side", F.col("c_custkey").alias("person_id"), "first_name", "family_name", "name_i")
    out = N.resolved(c.select("c_custkey", "game_id", "side", name.alias("name")), roster)
    return out.select("c_custkey", F.size("candidates").alias("candidates"), "person_id")


@query("l8_group_folds", with_team("SELECT fold, count(*) AS n, count(DISTINCT team_id) AS teams FROM (SELECT team_id, CAST(CAST('0x' || substr(md5(CAST(team_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM live) GROUP BY fold"))
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by team, from a digest: the same everywhere and every time."""
    fold = F.conv(F.substring(F.md5(F.col("team_id").cast("string")), 1, 8), 16, 10).cast("long") % 5
    return live(spark, sf_dir).withColumn("fold", fold.cast("int")).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("team_id").alias("teams"))


@query(
    "m27_fallback",
    with_team(", n AS (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) - 1 AS before FROM live) SELECT CASE WHEN before >= 5 THEN 'full' WHEN before >= 2 THEN 'reduced' ELSE 'seed_only' END AS regime, count(*) AS n, round(avg(abs(margin)), 6) AS mae FROM n GROUP BY ALL"),
)
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.row_number().over(W.partitionBy("season", "team_id").orderBy("game_date", "game_id")) - 1
    rows = live(spark, sf_dir).withColumn("before", before)
    regime = F.when(F.col("before") >= 5, "full").when(F.col("before") >= 2, "reduced").otherwise("seed_only")
    return rows.groupBy(regime.alias("regime")).agg(F.count("*").alias("n"), r(F.avg(F.abs("margin")), "mae"))


@query(
    "m32_variance_components",
    with_team(", t AS (SELECT season, team_id, avg(margin) AS m, var_samp(margin) AS v, count(*) AS n FROM live GROUP BY ALL HAVING count(*) >= 2) SELECT season, round(avg(v), 4) AS noise, round(greatest(var_samp(m) - avg(v / n), 0), 4) AS signal, round(greatest(var_samp(m) - avg(v / n), 0) / nullif(greatest(var_samp(m) - avg(v / n), 0) + avg(v / n), 0), 5) AS reliability FROM t GROUP BY season"),
)
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = live(spark, sf_dir).groupBy("season", "team_id").agg(F.avg("margin").alias("m"), F.var_samp("margin").alias("v"), F.count("*").alias("n")).where("n >= 2")
    c = t.groupBy("season").agg(F.avg("v").alias("noise"), F.var_samp("m").alias("s"), F.avg(F.col("v") / F.col("n")).alias("e"))
    signal = F.greatest(F.col("s") - F.col("e"), F.lit(0.0))
    return c.select("season", r("noise", places=4), r(signal, "signal", 4), r(E.ratio(signal, signal + F.col("e")), "reliability", 5))


@query("q7_m21_kalman_scores")
def kalman_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's predictions judged by season."""
    games = league_games(spark, sf_dir)
    said = K.team_kalman(games, by=("season", "league")).join(games.select("game_id", "margin"), "game_id")
    return L.metrics(said, "pred", "margin", by=["season"])
