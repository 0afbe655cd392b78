"""Play-by-play: event normalisation, starters, stints and possessions.

Feeds keep their own order in `feed_pos`; it is part of the data, since clocks tie. Possessions come out of windows over
a game's feed; only line-ups, which carry a set from event to event, are walked, one period of one game per group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E

GAME = ["game_id"]
#: Seconds of a regulation period and of an overtime.
PERIOD, OVERTIME = 720, 300


def elapsed(period: Column, clock: Column) -> Column:
    """Seconds since the game's start of a clock that counts down."""
    left = E.iso_clock_seconds(clock)
    before = F.when(period <= 4, (period - 1) * PERIOD).otherwise(4 * PERIOD + (period - 5) * OVERTIME)
    return before + F.when(period <= 4, PERIOD).otherwise(OVERTIME) - left


def normalised(feed: DataFrame) -> DataFrame:
    """Kinds, points and times of raw feed rows (gameId, feed_pos, period, clock, teamId, personId, actionType, subType,
    description): game_id, feed_pos, period, at, kind, team, pid, made, pts, n, m, technical, flagrant, is_oreb.

    A rebound is offensive if it raises the player's count of offensive rebounds in the description; where there is no
    count, it is if the last miss was by the same team. Heaves count as shots. Rows of other kinds are left out.
    """
    desc, sub = F.upper(F.coalesce("description", F.lit(""))), F.coalesce("subType", F.lit(""))
    action = F.col("actionType")
    made = F.when(action == "Made Shot", True).when(action == "Free Throw", ~desc.startswith("MISS")).when(action == "Heave", F.col("shotResult") == "Made") if "shotResult" in feed.columns else F.when(action == "Made Shot", True).when(action == "Free Throw", ~desc.startswith("MISS"))
    kind = (
        F.when(action.isin("Made Shot", "Missed Shot", "Heave"), "shot")
        .when(action == "Free Throw", "ft")
        .when(action == "Rebound", "reb")
        .when((action == "Turnover") & ~desc.contains("NO TURNOVER"), "tov")
        .when(action == "Substitution", "sub")
        .when(action == "Foul", "foul")
        .when((action == "period") & (sub == "end"), "period_end")
    )
    scored = F.col("made")
    pts = F.when(scored & (F.col("kind") == "shot"), F.when(desc.contains("3PT"), 3).otherwise(2)).when(scored & (F.col("kind") == "ft"), 1).otherwise(0)
    part = lambda i: F.regexp_extract(sub, r"(\d+) of (\d+)", i).try_cast("int")
    rows = feed.select(
        F.lpad("gameId", 10, "0").alias("game_id"),
        F.col("feed_pos").cast("long").alias("feed_pos"),
        F.col("period").cast("int").alias("period"),
        elapsed(F.col("period"), F.col("clock")).alias("at"),
        F.col("teamId").cast("long").alias("team"),
        F.coalesce(F.col("personId"), F.lit(0)).cast("long").alias("pid"),
        kind.alias("kind"),
        F.coalesce(made, F.lit(False)).alias("made"),
        "description",
        "subType",
    ).where("kind is not null")
    count = F.regexp_extract(F.coalesce("description", F.lit("")), r"\(Off:(\d+) Def:\d+\)", 1).try_cast("int")
    rows = rows.withColumns({"pts": pts, "n": F.coalesce(part(1), F.lit(1)), "m": F.coalesce(part(2), F.lit(1)), "technical": sub.contains("Technical"), "flagrant": sub.contains("Flagrant"), "_off": F.when(F.col("kind") == "reb", count)})
    own = W.partitionBy("game_id", "pid", "kind").orderBy("feed_pos")
    feed_order = W.partitionBy("game_id").orderBy("feed_pos").rowsBetween(W.unboundedPreceding, -1)
    missed = F.last(F.when(F.col("kind").isin("shot", "ft") & ~F.col("made") & ~F.col("technical"), F.col("team")), ignorenulls=True).over(feed_order)
    counted = F.when((F.col("pid") != 0) & F.col("_off").isNotNull(), F.col("_off") > F.coalesce(F.lag("_off").over(own), F.lit(0)))
    return rows.withColumn("is_oreb", F.when(F.col("kind") == "reb", F.coalesce(counted, missed == F.col("team"), F.lit(False)))).drop("_off")


def next_material(value: Column, kinds: Column) -> Column:
    """`value` of the next row whose kind matters."""
    ahead = W.partitionBy(*GAME).orderBy("feed_pos").rowsBetween(1, W.unboundedFollowing)
    return F.first(F.when(kinds, value), ignorenulls=True).over(ahead)


def possessions(events: DataFrame) -> DataFrame:
    """Possessions of normalised events: game_id, possession_idx, period, off_team, start_at, end_at, points, n_chances,
    start_type, end_type, flags, events.

    A possession ends with a basket that no free throw of the same player at the same time follows, the last free throw
    if it is made, a turnover, a defensive rebound or the period. An event of the other team before that closes it as an
    anomaly. Flagrant free throws keep the ball. Technical ones are no part of a possession.
    """
    feed = W.partitionBy(*GAME).orderBy("feed_pos")
    play = events.where("kind in ('shot', 'ft', 'reb', 'tov', 'period_end') and not (kind = 'ft' and technical)")
    shot, ft = F.col("kind") == "shot", F.col("kind") == "ft"
    material = F.col("kind").isin("shot", "ft", "reb", "tov", "period_end")
    ahead = next_material(F.struct("kind", "pid", "at"), material)
    and1 = shot & F.col("made") & (ahead["kind"] == "ft") & (ahead["pid"] == F.col("pid")) & (ahead["at"] == F.col("at"))
    last_ft = ft & (F.col("n") == F.col("m")) & ~F.col("flagrant")
    end = (
        F.when(F.col("kind") == "period_end", "period_end")
        .when(shot & F.col("made") & ~F.coalesce(and1, F.lit(False)), "make")
        .when(last_ft & F.col("made"), "ft")
        .when(F.col("kind") == "tov", "tov")
        .when((F.col("kind") == "reb") & ~F.col("is_oreb"), "dreb")
    )
    rows = play.withColumns({"and1": F.coalesce(and1, F.lit(False)), "end": end})
    # the team on offence: a defensive rebound belongs to the possession that it ends
    off = F.when((F.col("kind") == "reb") & ~F.col("is_oreb") | (F.col("kind") == "period_end"), None).otherwise(F.col("team"))
    rows = rows.withColumn("off", off).withColumn("off", F.coalesce("off", F.last("off", ignorenulls=True).over(feed.rowsBetween(W.unboundedPreceding, -1))))
    ended, other = F.lag("end").over(feed).isNotNull(), F.col("off") != F.lag("off").over(feed)
    # a rebound or a period's end with nothing open is no possession of its own
    idle = F.coalesce(ended, F.lit(True)) & F.col("kind").isin("reb", "period_end")
    rows = rows.withColumn("new", (F.coalesce(ended | other, F.lit(True)) & ~idle).cast("int")).withColumn("idle", idle)
    rows = rows.withColumn("possession_idx", F.sum("new").over(feed.rowsBetween(W.unboundedPreceding, 0)) - 1).where("not idle and possession_idx >= 0")
    item = F.struct("feed_pos", "kind", "pid", "made", "pts", "at", "is_oreb")
    out = rows.groupBy("game_id", "possession_idx").agg(
        F.min("period").alias("period"),
        F.min_by("off", "feed_pos").alias("off_team"),
        F.min("at").alias("first_at"),
        F.max("at").alias("end_at"),
        F.sum("pts").cast("long").alias("points"),
        (1 + F.count_if((F.col("kind") == "reb") & F.col("is_oreb")) + F.count_if(ft & F.col("flagrant") & (F.col("n") == F.col("m")))).cast("long").alias("n_chances"),
        F.coalesce(F.max_by("end", "feed_pos"), F.lit("anomaly")).alias("end_type"),
        F.bool_or("and1").alias("and1"),
        F.array_sort(F.collect_list(item)).alias("events"),
    )
    game = W.partitionBy("game_id").orderBy("possession_idx")
    same = F.lag("period").over(game) == F.col("period")
    before = F.when(same, F.lag("end_at").over(game))
    flags = F.filter(F.array(F.when(F.col("and1"), "and1"), F.when(F.col("end_type") == "anomaly", "forced_close"), F.when(F.col("end_type") == "period_end", "period_end")), lambda f: f.isNotNull())
    return out.withColumns({"start_at": F.coalesce(before, "first_at"), "start_type": F.when(same, F.lag("end_type").over(game)).otherwise("period_start"), "flags": flags}).drop("first_at", "and1")


def period_starters(events: DataFrame) -> DataFrame:
    """Who was on the floor when a period began: game_id, period, side, pid.

    `events` has kind, side, pid (of a substitution: who leaves) and sub_in. A player started if they left before they
    came in, or never came in and did something. Whoever may have come in by a substitution without a name (one of its
    `candidates`) counts as having come in then, unless they had done something before. Aggregates by player, no walk.
    """
    key = ["game_id", "period", "side"]
    out = events.select(*key, F.col("pid"), "feed_pos", F.when(F.col("kind") == "sub", "out").otherwise("did").alias("what"))
    came = events.where("kind = 'sub' and sub_in is not null").select(*key, F.col("sub_in").alias("pid"), "feed_pos", F.lit("in").alias("what"))
    if "candidates" in events.columns:
        unnamed = events.where("kind = 'sub' and sub_in is null and candidates is not null")
        came = came.unionByName(unnamed.select(*key, F.explode("candidates").alias("pid"), "feed_pos", F.lit("maybe").alias("what")))
    first = lambda what: F.min(F.when(F.col("what") == what, F.col("feed_pos")))
    seen = out.unionByName(came).where("pid <> 0 and side is not null").groupBy(*key, "pid").agg(first("in").alias("i"), first("out").alias("o"), first("did").alias("d"), first("maybe").alias("m"))
    return seen.where("case when i is null then least(o, d) < coalesce(m, least(o, d) + 1) else o < least(i, m) end").select(*key, "pid")


STINT = "game_id string, period int, stint_idx int, start_at double, end_at double, seconds double, home_pts long, away_pts long, home_fga long, away_fga long, home_lineup array<long>, away_lineup array<long>"


def stints(events: DataFrame, starters: DataFrame, size: int = 5) -> DataFrame:
    """Stretches of a period with unchanged line-ups and what each side did in them.

    Substitutions at one time are made together, in the feed's order. A substitute without a name (sub_in null) is the one
    of the event's `candidates`, if there is such a column, who isn't on the floor just then; where that leaves none or
    several, the period can't be told. A period whose line-ups can't be kept at `size` gives no rows:
    repaired_starters fills gaps by minutes, and stint_audit names the periods that remain. Events
    have side, pts and the columns of period_starters; a period's events fit in one task by far.
    """

    def walk(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in STINT.split(", ")]
        floor = {s: set(first.pid[first.side == s]) if len(first) else set() for s in ("home", "away")}
        if not len(rows) or any(len(x) != size for x in floor.values()):
            return pd.DataFrame([], columns=names)
        rows = rows.sort_values("feed_pos")
        game, period = rows.game_id.iloc[0], int(rows.period.iloc[0])
        begin = (period - 1) * PERIOD if period <= 4 else 4 * PERIOD + (period - 5) * OVERTIME
        finish = begin + (PERIOD if period <= 4 else OVERTIME)
        cuts = sorted({begin, *rows["at"][rows.kind == "sub"], finish})
        out = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for e in rows[(rows.kind == "sub") & (rows["at"] == a)].itertuples():
                named = e.sub_in == e.sub_in and e.sub_in is not None
                free = [int(e.sub_in)] if named else [int(p) for p in (e.candidates if e.candidates is not None else ()) if p not in floor[e.side]]
                floor[e.side].discard(e.pid)
                floor[e.side].add(free[0] if len(free) == 1 else -1)
            if any(len(x) != size or -1 in x for x in floor.values()):
                return pd.DataFrame([], columns=names)
            # what happens as the clock shows a change belongs to the line-ups before it
            mine = rows[(rows["at"] > a) & (rows["at"] <= b)] if k else rows[(rows["at"] >= a) & (rows["at"] <= b)]
            total = lambda side, what, mine=mine: int(mine[(mine.side == side)].pts.sum()) if what == "pts" else int(((mine.side == side) & (mine.kind == "shot")).sum())
            out.append((game, period, len(out), float(a), float(b), float(b - a), total("home", "pts"), total("away", "pts"), total("home", "fga"), total("away", "fga"), sorted(floor["home"]), sorted(floor["away"])))
        return pd.DataFrame(out, columns=names)

    key = ["game_id", "period"]
    rows = events.select(*key, "feed_pos", "at", "kind", "side", "pid", F.col("sub_in").cast("double"), "pts", (F.col("candidates") if "candidates" in events.columns else F.lit(None).cast("array<long>")).alias("candidates"))
    # aliases make new columns: both sides may come from the same events
    first = starters.select(*[F.col(c).alias(c) for c in (*key, "side", "pid")])
    return rows.groupBy(*key).cogroup(first.groupBy(*key)).applyInPandas(walk, STINT)


def repaired_starters(events: DataFrame, starters: DataFrame, box: DataFrame, size: int = 5) -> DataFrame:
    """`starters` with players added by their minutes where a side of a period has fewer than `size`.

    Whoever plays a whole period without doing anything is in no event of it. Such players are those of the box score
    (game_id, side, pid, seconds) who aren't in the period's events and have the most seconds that the stints of the
    periods known so far don't account for.
    """
    key = ["game_id", "period", "side"]
    sides = events.select("game_id", "period").distinct().withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away"))))
    short = sides.join(starters.groupBy(*key).agg(F.count("*").alias("n")), key, "left").select(*key, (size - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")
    known = lineup_channels(stints(events, starters, size)).select("game_id", "side", "pid", "seconds")
    spare = box.select("game_id", "side", "pid", F.col("seconds").alias("box")).join(known, ["game_id", "side", "pid"], "left").select("game_id", "side", "pid", (F.col("box") - F.coalesce("seconds", F.lit(0.0))).alias("spare")).where("spare > 0")
    seen = events.select(*key, "pid").unionByName(events.where("sub_in is not null").select(*key, F.col("sub_in").alias("pid"))).unionByName(starters.select(*key, "pid")).distinct()
    silent = short.join(spare, ["game_id", "side"]).join(seen, [*key, "pid"], "left_anti")
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("spare"), "pid"))
    return starters.select(*key, "pid").unionByName(silent.withColumn("_place", place).where("_place <= missing").select(*key, "pid"))


def stint_audit(events: DataFrame, found: DataFrame) -> DataFrame:
    """Every period of `events`: game_id, period, usable (has stints), seconds covered. No period goes without a word."""
    covered = found.groupBy("game_id", "period").agg(F.sum("seconds").alias("seconds"))
    periods = events.select("game_id", "period").distinct()
    return periods.join(covered, ["game_id", "period"], "left").select("game_id", "period", F.col("seconds").isNotNull().alias("usable"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def lineup_channels(found: DataFrame) -> DataFrame:
    """Seconds and points of every player out of stints: the ten line-up columns unpivoted, then summed."""
    side = lambda s, o: F.struct(F.lit(s).alias("side"), F.col(f"{s}_lineup").alias("who"), F.col(f"{s}_pts").alias("made"), F.col(f"{o}_pts").alias("allowed"))
    rows = found.select("game_id", "seconds", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("game_id", "seconds", "s.side", "s.made", "s.allowed", F.explode("s.who").alias("pid"))
    return rows.groupBy("game_id", "side", "pid").agg(F.sum("seconds").alias("seconds"), F.sum("made").alias("for"), F.sum("allowed").alias("against"))
