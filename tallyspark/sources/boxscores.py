"""Typed tables from raw payloads, and the same tables rendered from a commerce star schema for tests and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import exprs as E
from tallyspark.operators.pairing import COUNTS

TEAM_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("game_id",)]
    + [T.StructField("game_date", T.DateType()), T.StructField("season", T.StringType()), T.StructField("season_type", T.StringType())]
    + [T.StructField("team_id", T.LongType()), T.StructField("team_abbr", T.StringType()), T.StructField("is_home", T.BooleanType()), T.StructField("is_neutral", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_envelope(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The rows of a result set (the named one, else the first) as maps of header to text: `row`, with `feed_pos`.

    Both `resultSets` and a single `resultSet` are read. A malformed file raises.
    """
    one = "STRUCT<name: STRING, headers: ARRAY<STRING>, rowSet: ARRAY<ARRAY<STRING>>>"
    raw = spark.read.schema(f"resultSets ARRAY<{one}>, resultSet {one}").json(path, multiLine=True, mode="FAILFAST")
    sets = F.coalesce("resultSets", F.array("resultSet"))
    chosen = F.try_element_at(F.filter(sets, lambda s: s["name"] == name) if name else sets, F.lit(1))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), chosen.alias("s")).select("file", "s.headers", F.posexplode("s.rowSet").alias("feed_pos", "cells"))
    return rows.select("file", "feed_pos", F.map_from_arrays("headers", "cells").alias("row"))


def team_games_from_log(rows: DataFrame, season: str, season_type: str) -> DataFrame:
    """The team-game table from a game-log envelope's rows. A match-up with another separator than `vs.` or `@` raises."""
    v = lambda k: F.element_at("row", k)
    sign = F.element_at(F.split(v("MATCHUP"), " +"), 2)
    home = F.when(sign == "vs.", True).when(sign == "@", False).otherwise(F.raise_error(F.concat(F.lit("unknown match-up: "), v("MATCHUP"))).cast("boolean"))
    names = dict(zip(COUNTS, ["FGM", "FGA", "FG3M", "FG3A", "FTM", "FTA", "OREB", "DREB", "TOV", "PTS"], strict=True))
    made = rows.select(
        F.lpad(v("GAME_ID"), 10, "0").alias("game_id"),
        F.to_date(v("GAME_DATE")).alias("game_date"),
        F.lit(season).alias("season"),
        F.lit(season_type).alias("season_type"),
        v("TEAM_ID").cast("long").alias("team_id"),
        v("TEAM_ABBREVIATION").alias("team_abbr"),
        home.alias("is_home"),
        *[v(h).cast("long").alias(c) for c, h in names.items()],
    )
    both = made.groupBy("game_id").agg((~F.bool_or("is_home")).alias("is_neutral"))  # both rows say `@`
    return made.join(both, "game_id").select(*TEAM_SCHEMA.fieldNames())


def read_processed(spark: SparkSession, root: str, first: str, last: str, season_type: str, include_canceled: bool = False) -> DataFrame:
    """Paired team-game rows of an inclusive range of seasons; only their partitions are read. No data gives no rows."""
    try:
        table = spark.read.parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], TEAM_SCHEMA)
    rows = table.where(F.col("season").between(first, last) & (F.col("season_type") == season_type))
    return rows if include_canceled else rows.where("not (pts = 0 and opp_pts = 0)")


def write_processed(df: DataFrame, root: str, dealt: int = 1, rows: int = 0) -> None:
    """A Parquet tree by season and type; only the partitions at hand are replaced, and rows are in a fixed order.

    A season is one file as it is; with `dealt`, it is dealt by game over that many tasks, and no file has more than
    `rows` rows if that is given.
    """
    part = F.pmod(F.xxhash64("game_id"), F.lit(dealt)).cast("int")
    made = df.withColumn("_part", part).repartition("season", "season_type", "_part").drop("_part").sortWithinPartitions("season", "season_type", "game_date", "game_id", "team_id")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows).partitionBy("season", "season_type").parquet(root)


def players_from_box(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed player of nested box scores: game_id, team_id, is_home, person_id, name, comment, minutes, points."""
    player = "STRUCT<personId: BIGINT, firstName: STRING, familyName: STRING, nameI: STRING, position: STRING, comment: STRING, statistics: STRUCT<minutes: STRING, points: BIGINT>>"
    team = f"STRUCT<teamId: BIGINT, players: ARRAY<{player}>>"
    raw = spark.read.schema(f"boxScoreTraditional STRUCT<gameId: STRING, homeTeam: {team}, awayTeam: {team}>").json(path, multiLine=True, mode="FAILFAST")
    b = "boxScoreTraditional"
    sides = F.array(*[F.struct(F.lit(home).alias("is_home"), F.col(f"{b}.{t}.teamId").alias("team_id"), F.col(f"{b}.{t}.players").alias("players")) for t, home in (("homeTeam", True), ("awayTeam", False))])
    rows = raw.select(F.lpad(F.col(f"{b}.gameId"), 10, "0").alias("game_id"), F.inline(sides)).select("game_id", "team_id", "is_home", F.explode("players").alias("p"))
    minutes = E.minutes_of("p.statistics.minutes")
    name = F.concat_ws(" ", "p.firstName", "p.familyName")
    status = F.when(minutes > 0, "played").when(F.upper(F.trim("p.comment")).startswith("DNP - COACH"), "dnp_coach").otherwise("dnp_other")
    return rows.select("game_id", "team_id", "is_home", F.col("p.personId").alias("person_id"), name.alias("name"), F.col("p.nameI").alias("name_i"), F.col("p.position").isin("F", "C", "G").alias("starter"), minutes.alias("minutes"), F.col("p.statistics.points").alias("points"), status.alias("status"))


def lines_csv(spark: SparkSession, path: str) -> DataFrame:
    """Betting lines; `line` is the home side's expected margin."""
    schema = "date DATE, home STRING, away STRING, score_home INT, score_away INT, spread DOUBLE, total DOUBLE, whos_favored STRING"
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    return rows.withColumn("line", F.when(F.col("whos_favored") == "home", F.col("spread")).when(F.col("whos_favored") == "away", -F.col("spread")))


def coach_stints(spark: SparkSession, path: str) -> DataFrame:
    """Text blocks: a line `#YYYY`, then lines of team,coach. season, team, coach, stint (its number within the team)."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    from pyspark.sql import Window as W

    seen = W.partitionBy("file").orderBy("pos")
    year = F.last(F.when(F.col("line").startswith("#"), F.substring("line", 2, 4).cast("int")), ignorenulls=True).over(seen)
    rows = lines.withColumn("year", year).where(~F.col("line").startswith("#"))
    cells = F.split("line", ",")
    rows = rows.select(E.season_name(F.col("year")).alias("season"), F.trim(cells[0]).alias("team"), F.trim(cells[1]).alias("coach"), "pos")
    return rows.withColumn("stint", F.row_number().over(W.partitionBy("season", "team").orderBy("pos"))).drop("pos")


# The star schema rendered in the domain's terms: an order with two lines of two suppliers is a game of two teams.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.round(F.col("l_tax") * 100).cast("long").alias("t"))
    two = line.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("home"), F.max("l_suppkey").alias("away"), F.collect_list(F.struct("l_suppkey", "p", "q", "d", "t")).alias("rows")).where("n = 2 and home <> away")
    rows = two.select("l_orderkey", "home", F.explode("rows").alias("r")).select("l_orderkey", "home", "r.*")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("game_date"))
    p, q, d, t = (F.col(x) for x in "pqdt")
    counts = {"fgm": 28 + p % 25, "fga": 70 + q % 30, "fg3m": 5 + d, "fg3a": 20 + q % 20, "ftm": F.least(10 + p % 21, 8 + t), "fta": 10 + p % 21, "oreb": p % 17, "dreb": 20 + q % 23, "tov": p % 19}
    counts["pts"] = 2 * counts["fgm"] + counts["fg3m"] + counts["ftm"]
    played = F.col("l_orderkey") % 50 != 0
    neutral = F.col("l_orderkey") % 40 == 7
    return rows.join(orders, "l_orderkey").select(
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("game_id"),
        "game_date",
        E.season_of("game_date").alias("season"),
        F.lit("regular_season").alias("season_type"),
        F.col("l_suppkey").alias("team_id"),
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("team_abbr"),
        ((F.col("l_suppkey") == F.col("home")) & ~neutral).alias("is_home"),
        neutral.alias("is_neutral"),
        *[F.when(played, v).otherwise(0).cast("long").alias(c) for c, v in counts.items()],
    )


def player_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as player-games: errors are absences, sign-ups are coach's decisions, the rest were played."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "inactive").when(F.col("event_type") == "signup", "dnp_coach").otherwise("played")
    played = ~F.col("event_type").isin("error", "signup")
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("game_id"),
        F.col("ts").cast("date").alias("game_date"),
        "ts",
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "2023_24").otherwise("2024_25").alias("season"),
        (F.col("user_id") % 30).alias("team_id"),
        (F.col("event_id") % 2 == 0).alias("is_home"),
        F.col("user_id").alias("person_id"),
        status.alias("status"),
        F.when(played, 10 + k % 30).cast("int").alias("minutes"),
        F.when(played, F.round(F.col("value") * 100).cast("long")).alias("score"),
    )
