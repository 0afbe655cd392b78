"""Sharding by jump consistent hashing.

A stable key is mapped to one of n shards without a ring table: a linear congruential generator, seeded by the key, gives
the successive shard counts at which the key would move. Appending a shard therefore moves rows into the new shard only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the generator and of its 31-bit fraction.
MULTIPLIER, FRACTION = 2862933555777941757, 1 << 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once; a key leaves the loop when its next jump passes the last shard."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    open_rows = np.arange(len(state))
    while len(open_rows):
        s = state[open_rows] * np.uint64(MULTIPLIER) + np.uint64(1)
        state[open_rows] = s
        ahead = ((shard[open_rows] + 1) * (FRACTION / ((s >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = ahead < shards
        open_rows = open_rows[inside]
        shard[open_rows] = ahead[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The jump-hash shard of an integer key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def assigned(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return assigned(F.coalesce(key.cast("long"), F.lit(0)))


def with_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is dealt into chunks by a hash of `order`; the chunk counts are summed first, and each row then needs only
    its place in its chunk. So no task holds a shard. The number of chunks follows the row count. Rows equal in all of
    `order` are interchangeable.
    """
    chunks = max(64, df.count() // 200_000)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = dealt.groupBy(shard, "_chunk").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(W.partitionBy(shard).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.select(F.col(shard).alias("_s"), F.col("_chunk").alias("_c"), F.coalesce("_start", F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_row", F.row_number().over(W.partitionBy(shard, "_chunk").orderBy(*order)))
    joined = placed.join(starts, F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn(out, (F.col("_row") - 1 + F.col("_start")).cast("long")).drop("_chunk", "_row", "_s", "_c", "_start")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """`docs` in shards 0 to `shards` - 1 by their doc_id: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1; a null text counts as empty. A null doc_id counts as key 0. Repeated rows each
    get a slot. Other columns of `docs` play no part. An empty table gives an empty table. Equal texts are spread by
    their doc_ids: the key law looks at nothing else. The text itself is never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
