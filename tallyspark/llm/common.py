"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (driver and executor in one process) gets a temporary folder; a cluster raises.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tallyspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def released() -> None:
    """In a task: give what this Python worker has freed back to the system, for the worker serves other stages as well."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library on Linux
    if trim:
        trim(0)


def stored(df: DataFrame, name: str, compression: str = "snappy", level: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: a cut of lineage that outlives executors.

    level: of Zstandard, where that is the compression.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    options = {"compression": compression} | ({"parquet.compression.codec.zstd.level": level} if level else {})
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(many: DataFrame, one: DataFrame, key: str, part: str = "part", how: str = "inner") -> DataFrame:
    """`many` with the columns of `one`, which has one row or a few for each `key`.

    A row of `one` goes once to each pair of its key and a part of `many` (rows that were read together), so the rows of
    a very frequent key stay dealt over the parts, whatever their number. Rows of `many` without a partner go, or have
    nulls with how="left".
    """
    pairs = many.select(key, part).distinct().join(one.hint("merge"), key, how)
    return many.join(pairs.hint("merge"), [key, part])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (node, component), the smallest node of each.

    Alternating large-star and small-star steps; each round is cut with checkpoint(), and links stay on the executors.
    The smallest neighbour of a node comes from a partial aggregation, so a node with very many links is no hot task.
    """
    shared_dir(edges.sparkSession)
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().checkpoint()
    before = None
    while True:
        both = links.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(links.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo"))  # repeats go below
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(floor.select("hi", F.col("m").alias("lo")))
        links = small.where("hi <> lo").distinct().checkpoint()
        after = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if after == before:
            break
        before = after
    stars = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
