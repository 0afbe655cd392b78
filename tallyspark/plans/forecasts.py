"""Blends, forecasts, market ratings, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import forecast as C
from tallyspark.operators import linear as L
from tallyspark.operators import text as X
from tallyspark.operators import trailing as T
from tallyspark.plans.base import query, with_player, with_team
from tallyspark.plans.factors import live, r
from tallyspark.plans.models import home_games
from tallyspark.sources import boxscores as B

RUN = """, n AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) - 1 AS n, avg(margin) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM live WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id))"""


def with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team-games with a prior from the supplier's balance, games before and their mean margin."""
    w = W.partitionBy("season", "team_id").orderBy("game_date", "game_id")
    prior = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), (F.col("s_acctbal") / 1000).alias("prior"))
    rows = live(spark, sf_dir).withColumns({"n": F.row_number().over(w).cast("double") - 1, "cur": F.avg("margin").over(w.rowsBetween(W.unboundedPreceding, -1))})
    return rows.join(prior, "team_id")


@query(
    "m6_m7_m9_blends",
    with_team(f"{RUN} SELECT game_id, team_id, round(CASE WHEN cur IS NULL THEN p ELSE (1 - n / (n + 12.0)) * p + n / (n + 12.0) * cur END, 8) AS precision_blend, round(CASE WHEN cur IS NULL THEN p ELSE (1 - least(n / 20, 1)) * p + least(n / 20, 1) * cur END, 8) AS linear_blend FROM (SELECT n.*, s_acctbal / 1000 AS p FROM n JOIN supplier ON s_suppkey = team_id)"),
)
def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prior(spark, sf_dir).select("game_id", "team_id", r(C.blend("prior", "cur", "n", 12.0), "precision_blend", 8), r(C.linear_blend("prior", "cur", "n"), "linear_blend", 8))


@query("m6_prior_strength", with_team(", t AS (SELECT avg(margin) AS m, var_samp(margin) AS v FROM live GROUP BY season, team_id) SELECT round(least(greatest(avg(v) / nullif(var_pop(m), 0), 1), 60), 4) AS k FROM t"))
def prior_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prior_strength(live(spark, sf_dir), ["season", "team_id"], "margin").select(r("k", places=4))


@query(
    "m8_frozen_forecasts",
    with_team("""\
, n AS (SELECT season, team_id, opp_team_id, is_home, CAST(margin > 0 AS DOUBLE) AS y, row_number() OVER w AS n, avg(margin) OVER w AS rating FROM live WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id)),
    f AS (SELECT season, team_id, x, arg_max(rating, n) AS rating FROM n, (SELECT unnest([1, 3, 5]) AS x) WHERE n <= x GROUP BY ALL),
    e AS (SELECT n.*, x.x, (coalesce(f.rating, 0) - coalesce(g.rating, 0) + CASE WHEN is_home THEN 2.5 ELSE -2.5 END) / 12 AS z FROM n CROSS JOIN (SELECT unnest([1, 3, 5]) AS x) x LEFT JOIN f ON f.season = n.season AND f.team_id = n.team_id AND f.x = x.x LEFT JOIN f g ON g.season = n.season AND g.team_id = n.opp_team_id AND g.x = x.x),
    t AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * (u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429))))) AS tail FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS u FROM e))
    SELECT season, team_id, CAST(x AS INTEGER) AS x, sum(CASE WHEN n <= x THEN y ELSE 0 END) AS banked, round(sum(CASE WHEN n <= x THEN y ELSE least(greatest(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 1e-6), 1 - 1e-6) END), 5) AS expected FROM t GROUP BY season, team_id, x"""),
)
def frozen_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = live(spark, sf_dir).select("season", "game_id", "game_date", "team_id", "opp_team_id", "is_home", "margin")
    w = W.partitionBy("season", "team_id").orderBy("game_date", "game_id")
    ratings = games.select("season", "team_id", F.row_number().over(w).alias("game_number"), F.avg("margin").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rating"))
    return C.frozen_forecasts(games, ratings, [1, 3, 5], 2.5, 12.0).withColumn("expected", F.round("expected", 5))


@query("m10_market_ratings")
def market_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.market_ratings(home_games(spark, sf_dir).withColumn("line", F.col("margin").cast("double")))


@query("m2_logistic")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).where("is_home").select("game_id", "efg_d", "tov_d", "oreb_d", "ftr_d", (F.col("margin") > 0).cast("double").alias("won"))
    model = C.logistic(rows, ["efg_d", "tov_d", "oreb_d", "ftr_d"], "won")
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows.dropna()).select("game_id", "won", vector_to_array("probability")[1].alias("p"))


@query("m29_skill", with_player(", f AS (SELECT *, avg(score) OVER (PARTITION BY person_id ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS p FROM log) SELECT season, count(*) AS n, round(sqrt(avg((score - p) * (score - p))), 4) AS rmse, round(1 - sum((score - p) * (score - p)) / nullif(sum((score - m) * (score - m)), 0), 5) AS skill FROM (SELECT *, avg(score) OVER (PARTITION BY season) AS m FROM f WHERE score IS NOT NULL AND p IS NOT NULL) GROUP BY season"))
def skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.form_frames(B.player_log(spark, sf_dir), ["person_id"], "season", ["ts"], "score", (10,)).where("score is not null and score_l10 is not null")
    e = F.col("score") - F.col("score_l10")
    out = rows.groupBy("season").agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"), F.var_pop("score").alias("v"))
    return out.select("season", "n", r(F.sqrt("mse"), "rmse", 4), r(1 - E.ratio("sse", F.col("v") * F.col("n")), "skill", 5))


@query("m30_paired_t", with_team("SELECT season, count(*) AS n, round(avg(d), 5) AS mean, round(avg(d) * sqrt(count(*)) / nullif(stddev_samp(d), 0), 4) AS t FROM (SELECT season, CAST(pts - opp_pts - (fgm - opp_fgm) AS DOUBLE) AS d FROM live WHERE is_home) GROUP BY season"))
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).where("is_home").select("season", F.col("margin").cast("double").alias("a"), (F.col("fgm") - F.col("opp_fgm")).cast("double").alias("b"))
    return C.paired_test(rows, "a", "b", ["season"]).select("season", "n", r("mean", places=5), r("t", places=4))


@query("m30_bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bootstrap_mean(live(spark, sf_dir).where("is_home"), "margin", "game_id", 100)


@query(
    "m15_m31_weights",
    with_team("SELECT season, round(covar_pop(margin, z) / nullif(var_pop(z), 0), 3) AS weight FROM (SELECT season, CAST(margin AS DOUBLE) AS margin, (efg_d - avg(efg_d) OVER (PARTITION BY season)) / nullif(stddev_pop(efg_d) OVER (PARTITION BY season), 0) AS z FROM live) WHERE z IS NOT NULL GROUP BY season"),
)
def standardised_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("season")
    rows = live(spark, sf_dir).select("season", "margin", E.ratio(F.col("efg_d") - F.avg("efg_d").over(w), F.stddev_pop("efg_d").over(w)).alias("z"))
    blocks = L.gram(rows, ["z"], "margin", by=["season"])  # one predictor: solved where it lies
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("g_0_0", "g_0_1", "g_0_2", "g_1_1", "g_1_2"))
    return blocks.select("season", r(E.ratio(n * sxy - sx * sy, n * sxx - sx * sx), "weight", 3))


@query(
    "m21_residual_correction",
    with_team(f"{RUN}, e AS (SELECT season, game_id, team_id, margin - cur AS e, CAST(opp_tov AS DOUBLE) AS x FROM n WHERE cur IS NOT NULL), b AS (SELECT regr_slope(e, x) AS s, regr_intercept(e, x) AS i FROM e WHERE season < '1999_00') SELECT game_id, team_id, round(e - (i + s * x), 4) AS residual FROM e, b WHERE season >= '1999_00'"),
)
def residual_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_prior(spark, sf_dir).where("cur is not null").select("season", "game_id", "team_id", (F.col("margin") - F.col("cur")).alias("e"), F.col("opp_tov").cast("double").alias("x"))
    beta = L.fit(rows.where("season < '1999_00'"), ["x"], "e")["beta"]
    return rows.where("season >= '1999_00'").select("game_id", "team_id", r(F.col("e") - L.predicted(beta, ["x"]), "residual", 4))


@query("m24_projection")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' years as player-seasons: value and minutes from orders, age from the balance."""
    o = B.table(spark, sf_dir, "orders").withColumn("season", E.season_of("o_orderdate"))
    seasons = o.groupBy(F.col("o_custkey").alias("person_id"), "season").agg((F.avg("o_totalprice") / 1e5).alias("v"), F.count("*").cast("double").alias("mpg"))
    bios = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") > 0, 20 + F.col("c_acctbal") / 500).alias("age"), F.col("c_nationkey").alias("team_id"))
    frame = C.age_pairs(bios, seasons)
    said = C.project_values(frame, "season", ["v_p", "mpg_p", "v_p2", "age", "rookie"], "v")
    return C.project_minutes(said, "mpg", ["season", "team_id"]).select("season", "team_id", "person_id", "v", "prediction", "minutes_share")


@query("p31_age_frame", "WITH s AS (SELECT o_custkey AS person_id, CAST(year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INTEGER) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT a.person_id, a.y, CAST(a.n AS DOUBLE) AS mpg, CAST(b.n AS DOUBLE) AS mpg_p, CAST(c.n AS DOUBLE) AS mpg_p2, CAST(b.n IS NULL AS INTEGER) AS rookie FROM s a LEFT JOIN s b ON b.person_id = a.person_id AND b.y = a.y - 1 LEFT JOIN s c ON c.person_id = a.person_id AND c.y = a.y - 2")
def age_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id"), E.season_of("o_orderdate").alias("season")).agg(F.lit(1.0).alias("v"), F.count("*").cast("double").alias("mpg"))
    bios = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.lit(25.0).alias("age"))
    return C.age_pairs(bios, seasons).select("person_id", E.season_start("season").alias("y"), "mpg", "mpg_p", "mpg_p2", "rookie")


@query(
    "p32_coach_flags",
    """WITH c AS (SELECT o_custkey % 50 AS team, CAST(year(o_orderdate) AS INTEGER) AS y, arg_min(o_custkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS last, list(DISTINCT o_custkey) AS who FROM orders GROUP BY ALL)
    SELECT a.team, a.y, CAST(b.team IS NOT NULL AND NOT list_contains(b.who, a.first) AS INTEGER) AS is_new, CAST(coalesce(b.last <> a.first, false) AS INTEGER) AS off_season FROM c a LEFT JOIN c b ON a.team = b.team AND b.y = a.y - 1""",
)
def coach_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.struct("o_orderdate", "o_orderkey")
    o = B.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("team"), F.year("o_orderdate").alias("y"), "o_custkey", when.alias("at"))
    c = o.groupBy("team", "y").agg(F.min_by("o_custkey", "at").alias("first"), F.max_by("o_custkey", "at").alias("last"))
    # whether this year's first was there last year: a semi join on the person, no set of everyone
    before = c.select("team", "y", "last", F.col("first").alias("o_custkey"))
    there = before.join(o.select("team", (F.col("y") + 1).alias("y"), "o_custkey"), ["team", "y", "o_custkey"], "left_semi").select("team", "y", F.lit(1).alias("there"))
    last = c.select("team", (F.col("y") + 1).alias("y"), F.col("last").alias("last_before"))
    rows = c.join(last, ["team", "y"], "left").join(there, ["team", "y"], "left")
    known = F.col("last_before").isNotNull()
    return rows.select("team", "y", (known & F.col("there").isNull()).cast("int").alias("is_new"), F.coalesce((F.col("last_before") != F.col("first")).cast("int"), F.lit(0)).alias("off_season"))


@query("j19_injury_names", "SELECT s_suppkey AS person_id, CAST(max(c_acctbal > 0) AS INTEGER) AS out FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 100 = c_custkey % 100 GROUP BY s_suppkey")
def injury_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-kept list joined on name key and team."""
    own = B.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team"), E.name_key(F.concat(F.lit("Dé "), (F.col("s_suppkey") % 100).cast("string"))).alias("name"))
    listed = B.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("team"), E.name_key(F.concat(F.lit("DE "), (F.col("c_custkey") % 100).cast("string"), F.lit(" Jr."))).alias("name"), (F.col("c_acctbal") > 0).cast("int").alias("o"))
    listed = listed.groupBy("team", "name").agg(F.max("o").alias("out"))  # a row per name before the join
    return own.join(listed, ["team", "name"]).select(F.col("s_suppkey").alias("person_id"), "out")


@query(
    "t1_sections",
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)(#{1,3} )', E'\\1\x01\\2', 'g'), E'\x01') AS parts FROM documents),
    q AS (SELECT doc_id, CASE WHEN parts[1] = '' AND len(parts) > 1 THEN parts[2:] ELSE parts END AS parts FROM p), s AS (SELECT doc_id, unnest(parts) AS part, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS section FROM q),
    h AS (SELECT doc_id, section, trim(regexp_extract(part, '^#{1,3} +([^\n]*)', 1)) AS heading, regexp_replace(regexp_replace(part, '^#{1,3} +[^\n]*\n?', ''), '^\s+|\s+$', '', 'g') AS body FROM s)
    SELECT doc_id, section, CASE WHEN heading <> '' THEN heading ELSE '(start)' END AS heading, CAST(length(body) AS INTEGER) AS n FROM h WHERE body <> '' OR heading <> ''""",
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.sections(docs, "doc_id", "text").select("doc_id", "section", "heading", F.length("body").alias("n"))


@query("t7_prompt", "SELECT q AS query, 'Question: who?' AS tail, count(*) AS passages FROM (SELECT q.vec_id AS q, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS n FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE n <= 6 GROUP BY q")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = X.nearest(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 6).withColumn("body", F.concat(F.lit("text of "), F.col("vec_id").cast("string")))
    p = X.prompt(found, "who?", "body")
    return p.select("query", F.substring_index("prompt", "\n\n", -1).alias("tail"), (F.size(F.split("prompt", "\n\n")) - 1).cast("long").alias("passages"))
