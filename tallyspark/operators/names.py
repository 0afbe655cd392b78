"""Names in feeds resolved against a game's roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E


def resolved(mentions: DataFrame, roster: DataFrame, game: str = "game_id", side: str = "side", name: str = "name") -> DataFrame:
    """`mentions` with `candidates` (person_ids in order) and `person_id` where there is exactly one.

    roster: game, side, person_id, first_name, family_name, name_i. A name is tried as the short form (J. Doe), then as
    the family name, then as a prefix of the first name with the family name, then as either name alone; the first way
    that finds anyone counts. All ways are one join of a game's mentions with its roster, at most some dozens of rows.
    """
    key, short, family, first = E.name_key(name), E.name_key("name_i"), E.name_key("family_name"), E.name_key("first_name")
    ways = [F.col("_k") == F.col("_s"), F.col("_k") == F.col("_f"), F.col("_k").endswith(F.concat(F.lit(" "), F.col("_f"))) & F.col("_g").startswith(F.substring_index("_k", " ", 1)), (F.col("_k") == F.col("_g")) | F.col("_k").contains(F.col("_f"))]
    way = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(ways))):
        way = F.when(cond, i).otherwise(way)
    people = roster.select(game, side, F.col("person_id").alias("_p"), short.alias("_s"), family.alias("_f"), first.alias("_g"))
    asked = mentions.select(game, side, name).distinct().withColumn("_k", key)
    tried = asked.join(people, [game, side]).withColumn("_w", way).where("_w is not null")
    best = tried.groupBy(game, side, name).agg(F.min("_w").alias("_b"), F.collect_list(F.struct("_w", "_p")).alias("_l"))
    found = best.select(game, side, name, F.array_sort(F.transform(F.filter("_l", lambda x: x["_w"] == F.col("_b")), lambda x: x["_p"])).alias("candidates"))
    out = mentions.join(found, [game, side, name], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<long>")))
    return out.withColumn("person_id", F.when(F.size("candidates") == 1, F.col("candidates")[0]))
