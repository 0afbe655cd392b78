"""Scalar derivations and joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import asof as A
from tallyspark.operators import pairing as P
from tallyspark.plans.base import query, with_player, with_team
from tallyspark.plans.factors import fact, live, r
from tallyspark.sources import boxscores as B


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EV = "ev AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


@query("p8_status", f"WITH {EV} SELECT event_id, CASE WHEN k > 50 THEN 'played' WHEN upper(event_type) LIKE 'SIGN%' THEN 'dnp_coach' ELSE 'dnp_other' END AS status, CASE WHEN k > 50 THEN value END AS score FROM ev")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    played = F.col("k") > 50
    said = F.when(played, "played").when(F.upper("event_type").startswith("SIGN"), "dnp_coach").otherwise("dnp_other")
    return events(spark, sf_dir).select("event_id", said.alias("status"), F.when(played, F.col("value")).alias("score"))


@query("p9_neutral_override", "SELECT o_orderkey, CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-01' AND DATE '1997-08-15' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-01-31' AS is_neutral FROM orders")
def neutral_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = [("1997-06-01", "1997-08-15"), ("1999-01-01", "1999-01-31")]
    d = F.col("o_orderdate").cast("date")
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", inside.alias("is_neutral"))


@query(
    "p12_venue",
    "SELECT c_custkey, n_name AS venue, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = B.table(spark, sf_dir, "nation").join(B.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = B.table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # a country each
    unknown = F.raise_error(F.concat(F.lit("unknown venue: "), F.col("c_nationkey").cast("string"))).cast("string")
    return found.select("c_custkey", F.coalesce("n_name", unknown).alias("venue"), F.col("r_name").alias("region"))


@query("p13_clocks", f"WITH {EV} SELECT event_id, CAST((k % 12) * 60 + k % 60 + 0.5 AS DOUBLE) AS seconds, round((k % 40) + (k % 60) / 60.0, 6) AS minutes FROM ev")
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    iso = F.concat(F.lit("PT"), two(F.col("k") % 12), F.lit("M"), two(F.col("k") % 60), F.lit(".50S"))
    mmss = F.concat((F.col("k") % 40).cast("string"), F.lit(":"), two(F.col("k") % 60))
    return events(spark, sf_dir).select("event_id", E.iso_clock_seconds(iso).alias("seconds"), r(E.minutes_of(mmss), "minutes"))


@query(
    "p14_p15_ids_and_seasons",
    """SELECT o_orderkey, CASE kind WHEN 1 THEN 'preseason' WHEN 2 THEN 'regular_season' WHEN 3 THEN 'all_star' WHEN 4 THEN 'playoffs' WHEN 5 THEN 'play_in' END AS season_type, y AS start_year,
    CAST(y AS VARCHAR) || '_' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, CAST(y - 1 AS VARCHAR) || '_' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS previous
    FROM (SELECT o_orderkey, 1 + o_orderkey % 5 AS kind, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)""",
)
def ids_and_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    gid = F.concat(F.lit("00"), (1 + F.col("o_orderkey") % 5).cast("string"), F.lpad((year % 100).cast("string"), 2, "0"), F.lit("00001"))
    parts = E.game_id_parts(gid)
    return B.table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in parts.items()], E.season_shift(parts["season"], -1).alias("previous"))


@query("p16_name_keys", "SELECT c_custkey, 'jose customer' || CAST(c_custkey AS VARCHAR) AS name_key FROM customer")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" José  "), F.lit("Cus'tomer"), F.col("c_custkey").cast("string"), F.lit(" Jr. "))
    return B.table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(E.name_key(name), r"\s+", " ").alias("name_key"))


@query("p17_extraction", f"WITH {EV} SELECT event_id, k AS ast, k % 3 AS n, k % 5 AS m, k % 7 AS offs, k % 4 AS def FROM ev")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: (F.col("k") % n).cast("string")
    text = F.concat(F.lit("J. Doe 12' Shot ("), F.col("k").cast("string"), F.lit(" AST) "), part(3), F.lit(" of "), part(5), F.lit(" (Off:"), part(7), F.lit(" Def:"), part(4), F.lit(")"))
    get = lambda pattern, i=1: F.regexp_extract("text", pattern, i).cast("int")
    return events(spark, sf_dir).withColumn("text", text).select("event_id", get(r"\((\d+) AST\)").alias("ast"), get(r"(\d+) of (\d+)").alias("n"), get(r"(\d+) of (\d+)", 2).alias("m"), get(r"\(Off:(\d+) Def:(\d+)\)").alias("offs"), get(r"\(Off:(\d+) Def:(\d+)\)", 2).alias("def"))


ZONES = f"""{EV}, z AS (SELECT *, k % 35 AS d, k % 35 >= 22 AS three FROM ev),
zone AS (SELECT *, CASE WHEN three AND d >= 27 THEN 'deep' WHEN three THEN 'three' WHEN d < 4 THEN 'rim' WHEN d < 14 THEN 'paint' ELSE 'mid' END AS zone FROM z)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"d": F.col("k") % 35, "made": (F.col("value") > 20).cast("int")})
    return rows.withColumn("three", F.col("d") >= 22).withColumn("zone", E.shot_zone("d", "three"))


@query("p18_p20_shots", f"WITH {ZONES} SELECT event_id, zone, CASE WHEN event_type LIKE '%click%' THEN 'jump' WHEN event_type LIKE '%i%' THEN 'layup' ELSE 'other' END AS sub, round(degrees(atan2(abs(CAST(k - 40 AS DOUBLE)), abs(CAST(d - 17 AS DOUBLE)))), 5) AS angle FROM zone")
def shot_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots(spark, sf_dir).select("event_id", "zone", E.first_match("event_type", {"jump": "click", "layup": "i"}).alias("sub"), r(E.shot_angle((F.col("d") - 17).cast("double"), (F.col("k") - 40).cast("double")), "angle", 5))


@query("p21_p34_design", f"WITH {ZONES} SELECT event_id, CAST(least(greatest(d, 2), 30) AS INTEGER) AS clipped, CAST(d * d AS INTEGER) AS squared, CAST(zone = 'rim' AS INTEGER) AS is_rim, CAST(zone = 'paint' AS INTEGER) AS is_paint, CASE WHEN k = 0 THEN 0.0 ELSE round(d / k, 6) END AS cleaned FROM zone")
def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return shots(spark, sf_dir).select("event_id", F.least(F.greatest(d, F.lit(2)), F.lit(30)).alias("clipped"), (d * d).cast("int").alias("squared"), (F.col("zone") == "rim").cast("int").alias("is_rim"), (F.col("zone") == "paint").cast("int").alias("is_paint"), F.coalesce(r(E.clean(E.ratio("d", "k")), "x"), F.lit(0.0)).alias("cleaned"))


@query(
    "m17_m18_shooter_offsets",
    f"""WITH {ZONES}, b AS (SELECT zone, avg(CAST(value > 20 AS INTEGER)) AS p FROM zone GROUP BY zone),
    s AS (SELECT user_id, zone, count(*) AS n, sum(CAST(value > 20 AS INTEGER) - p) AS e, sum(p * (1 - p)) AS v FROM zone JOIN b USING (zone) GROUP BY ALL),
    t AS (SELECT zone, greatest(sum(e * e - v) / nullif(sum(v * v), 0), 0) AS tau2 FROM s GROUP BY zone)
    SELECT user_id, zone, n, round(e / nullif(v + 1 / nullif(tau2, 0), 0), 5) AS shift FROM s JOIN t USING (zone)""",
)
def shooter_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shots(spark, sf_dir)
    base = rows.groupBy("zone").agg(F.avg("made").alias("p"))
    sums = rows.join(F.broadcast(base), "zone").groupBy("user_id", "zone").agg(F.count("*").alias("n"), F.sum(F.col("made") - F.col("p")).alias("e"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))  # five zones
    tau = sums.groupBy("zone").agg(F.greatest(E.ratio(F.sum(F.col("e") ** 2 - F.col("v")), F.sum(F.col("v") ** 2)), F.lit(0.0)).alias("tau2"))
    return sums.join(F.broadcast(tau), "zone").select("user_id", "zone", "n", r(E.ratio("e", F.col("v") + E.ratio(F.lit(1.0), "tau2")), "shift", 5))


@query("p26_logit_shift", f"WITH {EV} SELECT event_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.3))), 6) AS p FROM (SELECT event_id, least(greatest(k / 100.0, 1e-6), 1 - 1e-6) AS p FROM ev)")
def logit_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", r(E.logit_shift(F.col("k") / 100.0, F.lit(0.3)), "p"))


@query("p27_line_sign", f"WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN value WHEN k % 3 = 1 THEN -value END AS line FROM ev")
def line_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.col("k") % 3
    return events(spark, sf_dir).select("event_id", F.when(side == 0, F.col("value")).when(side == 1, -F.col("value")).alias("line"))


@query(
    "p28_honours",
    """WITH h AS (SELECT o_custkey AS person_id, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 ELSE 1 END) AS BIGINT) AS s FROM orders GROUP BY ALL)
    SELECT a.person_id, a.y, coalesce(b.s, 0) AS last1, greatest(coalesce(b.s, 0), coalesce(c.s, 0), coalesce(d.s, 0)) AS best3 FROM h a LEFT JOIN h b ON b.person_id = a.person_id AND b.y = a.y - 1
    LEFT JOIN h c ON c.person_id = a.person_id AND c.y = a.y - 2 LEFT JOIN h d ON d.person_id = a.person_id AND d.y = a.y - 3""",
)
def honours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 3).otherwise(1)
    h = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id"), F.year("o_orderdate").alias("y")).agg(F.sum(tier).alias("s"))
    past = W.partitionBy("person_id").orderBy("y")  # one shuffle in place of three self-joins
    return h.select("person_id", "y", F.coalesce(F.max("s").over(past.rangeBetween(-1, -1)), F.lit(0)).alias("last1"), F.coalesce(F.max("s").over(past.rangeBetween(-3, -1)), F.lit(0)).alias("best3"))


@query("p30_null_audit", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS null_text, count(*) FILTER (WHERE lang IS NULL) AS null_lang, count(*) FILTER (WHERE source IS NULL) AS null_source FROM documents")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("text", "lang", "source")])


@query("j5_line_join", with_team("SELECT f.game_id, f.team_id, CASE WHEN abs(c.c_acctbal) >= 100 THEN round(c.c_acctbal / 1000, 6) END AS line FROM live f LEFT JOIN customer c ON c.c_custkey = f.team_id AND c.c_nationkey = f.opp_team_id % 25"))
def line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_nationkey").cast("long").alias("c"), "c_acctbal")
    rows = live(spark, sf_dir).withColumn("c", F.col("opp_team_id") % 25).join(lines, ["team_id", "c"], "left")
    return rows.select("game_id", "team_id", F.when(F.abs("c_acctbal") >= 100, F.round(F.col("c_acctbal") / 1000, 6)).alias("line"))


@query("j6_lookup_default", with_team("SELECT game_id, team_id, coalesce(s_acctbal, 0.0) AS prior FROM team LEFT JOIN supplier ON s_suppkey = team_id AND s_acctbal > 0"))
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = B.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("team_id"), "s_acctbal")
    return B.team_games(spark, sf_dir).join(prior, "team_id", "left").select("game_id", "team_id", F.coalesce("s_acctbal", F.lit(0.0)).alias("prior"))


@query("j7_outer_zero_fill", with_player(", a AS (SELECT person_id, count(*) AS played FROM log WHERE status = 'played' AND season = '2023_24' GROUP BY person_id), b AS (SELECT person_id, count(*) AS missed FROM log WHERE status = 'inactive' AND season = '2024_25' GROUP BY person_id) SELECT person_id, coalesce(played, 0) AS played, coalesce(missed, 0) AS missed FROM a FULL JOIN b USING (person_id)"))
def outer_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.player_log(spark, sf_dir)
    count = lambda s, y, name: log.where((F.col("status") == s) & (F.col("season") == y)).groupBy("person_id").agg(F.count("*").alias(name))
    return count("played", "2023_24", "played").join(count("inactive", "2024_25", "missed"), "person_id", "full").na.fill(0)


@query(
    "j12_interval_lookup",
    "WITH s AS (SELECT user_id, CAST(date_part('day', ts) AS BIGINT) AS d, min(event_id) AS stint FROM events WHERE event_type = 'purchase' GROUP BY ALL), f AS (SELECT user_id, arg_min(stint, d) AS first FROM s GROUP BY user_id) SELECT e.event_id, coalesce(s.stint, f.first) AS stint FROM (SELECT *, date_part('day', ts) + 0.0 AS d FROM events) e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.d + 1e-6 >= s.d LEFT JOIN f ON f.user_id = e.user_id",
)
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.dayofmonth("ts").cast("double").alias("d"))
    stints = rows.where("event_type = 'purchase'").groupBy("user_id", "d").agg(F.min("event_id").alias("stint"))
    return A.interval_of(rows.select("event_id", "user_id", "d"), stints, ["user_id"], "d", "d", ["stint"]).select("event_id", "stint")


@query("j16_denominators", with_team("SELECT game_id, team_id, opp_fga, round(CAST(fgm AS DOUBLE) / nullif(opp_fga, 0), 6) AS rate FROM paired"))
def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_opponent(B.team_games(spark, sf_dir), ["fga"])
    return rows.select("game_id", "team_id", "opp_fga", r(E.ratio("fgm", "opp_fga"), "rate"))


@query(
    "j17_opponent_tendency",
    with_team(""", t AS (SELECT *, avg(off_tov_pct) OVER (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS habit FROM live)
    SELECT a.game_id, a.team_id, round(a.habit, 6) AS habit, round(b.habit, 6) AS opp_habit, round(a.habit * b.habit, 6) AS matchup FROM t a JOIN t b ON a.game_id = b.game_id AND a.team_id <> b.team_id"""),
)
def opponent_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = W.partitionBy("season", "team_id").orderBy("game_date", "game_id").rowsBetween(W.unboundedPreceding, -1)
    rows = P.with_opponent(live(spark, sf_dir).select("game_id", "team_id", F.avg("off_tov_pct").over(before).alias("habit")), ["habit"])
    return rows.select("game_id", "team_id", r("habit"), r("opp_habit"), r(F.col("habit") * F.col("opp_habit"), "matchup"))


@query("j20_common_rows", with_player(", a AS (SELECT person_id, avg(score) AS s FROM log WHERE season = '2023_24' GROUP BY person_id), b AS (SELECT person_id, avg(score) AS s FROM log WHERE season = '2024_25' GROUP BY person_id), c AS (SELECT person_id, avg(minutes) AS m FROM log GROUP BY person_id) SELECT person_id, round(a.s, 5) AS first, round(b.s, 5) AS second, round(m, 5) AS minutes FROM a JOIN b USING (person_id) JOIN c USING (person_id)"))
def common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("season") == s, F.col("score")))
    rows = B.player_log(spark, sf_dir).groupBy("person_id").agg(r(mean("2023_24"), "first", 5), r(mean("2024_25"), "second", 5), r(F.avg("minutes"), "minutes", 5), F.count_if(F.col("season") == "2023_24").alias("a"), F.count_if(F.col("season") == "2024_25").alias("b"))
    return rows.where("a > 0 and b > 0").drop("a", "b")  # one aggregate in place of three joins


@query("j21_prior_season", with_team(", t AS (SELECT season, team_id, avg(margin) AS net FROM live GROUP BY ALL) SELECT a.season, a.team_id, round(a.net, 6) AS net, round(b.net, 6) AS prior FROM t a LEFT JOIN t b ON a.team_id = b.team_id AND CAST(left(a.season, 4) AS INTEGER) = CAST(left(b.season, 4) AS INTEGER) + 1"))
def prior_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = live(spark, sf_dir).groupBy("season", "team_id").agg(F.avg("margin").alias("net"))
    prior = t.select(E.season_shift("season", 1).alias("season"), "team_id", F.col("net").alias("prior"))
    return t.join(prior, ["season", "team_id"], "left").select("season", "team_id", r("net"), r("prior"))


@query("g9_lineup_pairs", "SELECT l_suppkey AS a, l_partkey % 50 AS b, count(*) AS stints, CAST(sum(l_quantity) AS BIGINT) AS weight, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2) AS y FROM lineitem GROUP BY ALL")
def lineup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"))
    return rows.agg(F.count("*").alias("stints"), F.sum("l_quantity").cast("long").alias("weight"), r(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), "y", 2))


@query("g17_weighted_mean", "SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), "mean"))


@query("g25_gap_closed", with_team(", m AS (SELECT season, avg(abs(margin)) AS base, avg(abs(margin - CAST(round(efg_d * 50) AS INTEGER))) AS x, avg(abs(margin - CAST(round(efg_d * 100) AS INTEGER))) AS market FROM live GROUP BY season) SELECT season, round(100 * (base - x) / nullif(base - market, 0), 3) AS closed FROM m"))
def gap_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mae = lambda k: F.avg(F.abs(F.col("margin") - F.round(F.col("efg_d") * k).cast("int")))
    m = live(spark, sf_dir).groupBy("season").agg(F.avg(F.abs("margin")).alias("base"), mae(50).alias("x"), mae(100).alias("market"))
    return m.select("season", r(100 * E.ratio(F.col("base") - F.col("x"), F.col("base") - F.col("market")), "closed", 3))


@query("w18_possession_index", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS possession_idx FROM events")
def possession_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").select("event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("possession_idx"))


@query("l7_priority_dedupe", "SELECT k AS person_id, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src) AS n FROM (SELECT c_custkey AS k, 1 AS src FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 2 FROM orders)) WHERE n = 1")
def priority_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("person_id"), F.lit(1).alias("src"))
    inferred = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.lit(2).alias("src"))
    return own.unionByName(inferred).groupBy("person_id").agg(F.min("src").alias("src"))


@query("g16_team_rating", with_player(", s AS (SELECT team_id, person_id, CAST(sum(minutes) AS DOUBLE) AS m, avg(score) AS v FROM log WHERE status = 'played' GROUP BY ALL) SELECT team_id, round(sum(5 * m / t * v), 4) AS rating, count(*) AS players FROM (SELECT *, sum(m) OVER (PARTITION BY team_id) AS t FROM s) GROUP BY team_id"))
def team_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.player_log(spark, sf_dir).where("status = 'played'").groupBy("team_id", "person_id").agg(F.sum("minutes").cast("double").alias("m"), F.avg("score").alias("v"))
    return s.groupBy("team_id").agg(r(5 * F.sum(F.col("m") * F.col("v")) / F.sum("m"), "rating", 4), F.count("*").alias("players"))


@query("g31_late_dip", with_team(", n AS (SELECT season, team_id, margin, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date DESC, game_id DESC) AS back FROM live), t AS (SELECT season, team_id, avg(margin) FILTER (WHERE back > 2) AS early, avg(margin) FILTER (WHERE back <= 2) AS late FROM n GROUP BY ALL) SELECT season, CASE WHEN early > 0 THEN 'good' ELSE 'poor' END AS tier, count(*) AS teams, round(avg(late - early), 5) AS dip FROM t WHERE early IS NOT NULL GROUP BY ALL"))
def late_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(W.partitionBy("season", "team_id").orderBy(F.desc("game_date"), F.desc("game_id")))
    t = live(spark, sf_dir).withColumn("back", back).groupBy("season", "team_id").agg(F.avg(F.when(F.col("back") > 2, F.col("margin"))).alias("early"), F.avg(F.when(F.col("back") <= 2, F.col("margin"))).alias("late"))
    tier = F.when(F.col("early") > 0, "good").otherwise("poor")
    return t.where("early is not null").groupBy("season", tier.alias("tier")).agg(F.count("*").alias("teams"), r(F.avg(F.col("late") - F.col("early")), "dip", 5))


@query("n15_canceled", with_team("SELECT season, count(*) AS n, count(*) FILTER (WHERE pts = 0 AND opp_pts = 0) AS canceled, count(*) FILTER (WHERE off_efg_pct IS NULL) AS no_factor FROM fact GROUP BY season"))
def canceled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact(spark, sf_dir)
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.count_if((F.col("pts") == 0) & (F.col("opp_pts") == 0)).alias("canceled"), F.count_if(F.col("off_efg_pct").isNull()).alias("no_factor"))
