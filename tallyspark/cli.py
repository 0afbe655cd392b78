"""python -m tallyspark.cli process|backfill|incremental|index|ask|query: raw logs to the fact table, retrieval, named queries."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("process", help="a season's game log to the fact table")
    for name in ("--raw", "--out", "--season"):
        a.add_argument(name, required=True)
    a.add_argument("--season-type", default="regular_season")
    c = sub.add_parser("backfill", help="the seasons of a folder of logs (SEASON.json) that the fact table lacks")
    d = sub.add_parser("incremental", help="games of a season's log that the fact table lacks")
    for one in (c, d):
        one.add_argument("--raw", required=True)
        one.add_argument("--out", required=True)
        one.add_argument("--season-type", default="regular_season")
    c.add_argument("--seasons", required=True, nargs="+")
    c.add_argument("--seconds", type=float, help="begin no season after so many seconds")
    d.add_argument("--season", required=True)
    e = sub.add_parser("index", help="sections and windows of a folder of texts, as Parquet")
    f = sub.add_parser("ask", help="the passages of an index nearest to a question, as a prompt")
    for one in (e, f):
        one.add_argument("--index", required=True)
    e.add_argument("--texts", required=True)
    f.add_argument("--question", required=True)
    f.add_argument("--k", type=int, default=6)
    b = sub.add_parser("query", help="a named query over a folder of tables")
    for name in ("--name", "--tables", "--out"):
        b.add_argument(name, required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tallyspark import plans
    from tallyspark.operators import pairing, text
    from tallyspark.sources import boxscores, parts

    spark = SparkSession.builder.getOrCreate()

    def facts(raw: str, season: str):
        rows = boxscores.team_games_from_log(boxscores.read_envelope(spark, raw), season, args.season_type)
        return pairing.with_factors(pairing.with_opponent(rows, names=("team_abbr",)))

    if args.command == "process":
        boxscores.write_processed(facts(args.raw, args.season), args.out)
    elif args.command == "backfill":
        made = parts.build_parts(spark, args.out, "season", args.seasons, lambda s: facts(f"{args.raw}/{s}.json", s).drop("season"), args.seconds)
        print(f"made: {' '.join(made) or 'none'}")
    elif args.command == "incremental":
        rows = facts(args.raw, args.season)
        known = parts.optional(spark, args.out, "game_id string, season string", "parquet").where(F.col("season") == args.season).select("game_id").distinct()
        fresh = rows.join(known, "game_id", "left_anti").persist()
        print(f"games: {fresh.select('game_id').distinct().count()}")
        fresh.write.mode("append").partitionBy("season", "season_type").parquet(args.out)
    elif args.command == "index":
        found = parts.documents(spark, args.texts).unionByName(parts.word_documents(spark, args.texts))
        text.chunks(found, "name", "text").write.mode("overwrite").parquet(args.index)
    elif args.command == "ask":
        print(text.answer_prompt(spark.read.parquet(args.index), args.question, args.k))
    elif args.name not in plans.QUERIES:
        print(f"unknown query: {args.name}", file=sys.stderr)
        return 1
    else:
        plans.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
