"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, and only histograms of the scores leave the blocks. The
global histogram of a query says in which bin its k-th best score lies; that bin is cut into finer bins in the next
round, until a bin is a single integer score. A last pass keeps the scores above it, and of those equal to it the
smallest ids, so the result is exact and no more than a few rows per query and block are ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block of candidates and of queries, and bits of the score that a round settles.
CANDIDATES, QUERIES, BITS = 2048, 2048, 8


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(id long, v array<double>): floor(scale * x) of each component x as double.

    Vectors that are null or empty, or hold null or non-finite components, take no part, and neither do rows without an id.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where((F.size(vector) > 0) & sound)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def packed(vectors: DataFrame, cell: str) -> DataFrame:
    """(id, v binary): the components as numpy's `cell`, which holds each of them exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.array([len(x) for x in batch.column(1)], np.int64)
            data = flat.astype(cell).tobytes()
            ends = np.cumsum(sizes) * np.dtype(cell).itemsize
            cells = pa.array([data[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], ["id", "v"])

    return vectors.mapInArrow(run, "id long, v binary")


def matrix(column: pa.ChunkedArray, cell: str, kind: type) -> np.ndarray:
    """Packed vectors as a matrix; shorter ones are filled up with zeros."""
    values = column.to_pylist()
    sizes = np.array([len(x) for x in values]) // np.dtype(cell).itemsize
    flat = np.frombuffer(b"".join(values), cell)
    wide = int(sizes.max(initial=1))
    if (sizes == wide).all():
        return flat.reshape(-1, wide).astype(kind)
    out = np.zeros((len(sizes), wide), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def scores(left: pa.Table, right: pa.Table, cell: str, kind: type) -> np.ndarray:
    """(queries, candidates) inner products as integers; a query's own id gets the lowest integer."""
    q, c = matrix(right["v"], cell, kind), matrix(left["v"], cell, kind)
    wide = min(q.shape[1], c.shape[1])
    out = (q[:, :wide] @ c[:, :wide].T).astype(np.int64)
    out[right["id"].to_numpy()[:, None] == left["id"].to_numpy()[None, :]] = np.iinfo(np.int64).min
    return out


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int, scale: int = 64) -> DataFrame:
    """The k candidates of highest inner product for each query: query_id, rank (from 1), id, score.

    Queries are the rows of `df` where `is_query` holds (of several vectors under one query id, the least); candidates
    are all rows whose id is not the query's. Vectors are taken as whole numbers, see whole_vectors; a shorter one counts
    as filled up with zeros. Ties go to the smaller id; repeated rows count as often as they are there. A query without
    candidates, and an empty table, give no rows. Scores must stay within 63 bits, else it raises.
    """
    spark = df.sparkSession
    whole = whole_vectors(df, key, vector, scale)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, norm, largest = whole.agg(F.count("*"), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    # what is shuffled in every round is packed as narrow as the components are
    cell = "<i2" if (largest or 0) < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    rows = stored(packed(whole, cell), "vectors")
    asked = stored(packed(whole_vectors(df.where(is_query), key, vector, scale).groupBy("id").agg(F.min("v").alias("v")), cell), "queries")
    m = asked.count()
    out_schema = "query_id long, rank int, id long, score long"
    if not n or not m:
        return spark.createDataFrame([], out_schema)
    bound = int(norm * norm * 1.000001) + 1  # no inner product is larger, by Cauchy and Schwarz
    if bound >= 1 << 61:
        raise ValueError("scores exceed 63 bits")
    # whole numbers are exact in floats up to 2**24 and 2**53, and so are all sums on the way
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    rounds = max(1, math.ceil((2 * bound + 1).bit_length() / BITS))
    blocks, lanes = math.ceil(n / CANDIDATES), math.ceil(m / QUERIES)
    hashed = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    # by id and place: rows that repeat an id are spread as well, and short parts fill all blocks alike
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    left = rows.withColumn("block", place).withColumn("lane", every(lanes)).groupBy("lane", "block")
    state = asked.select("id", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))

    def against(now: DataFrame):
        held = asked.join(now, "id").withColumn("lane", hashed(lanes).cast("int")).withColumn("block", every(blocks))
        return left.cogroup(held.groupBy("lane", "block"))

    for at in range(rounds):
        width = 1 << BITS * (rounds - 1 - at)

        def histogram(c: pa.Table, q: pa.Table) -> pa.Table:
            if not c.num_rows or not q.num_rows:
                return pa.table({"id": pa.array([], pa.int64()), "bin": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
            s = scores(c, q, cell, kind)
            bins = (s - q["low"].to_numpy()[:, None]) // width  # noqa: B023  the job runs before the next round
            row, _ = np.nonzero(inside := (bins >= 0) & (bins < 1 << BITS) & (s >= -bound))
            counts = np.bincount((row << BITS) + bins[inside], minlength=len(s) << BITS).reshape(len(s), -1)
            better = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in the block, in higher bins
            row, bin_ = np.nonzero((counts > 0) & (better < k))  # below k better ones, no bin can hold the k-th score
            return pa.table({"id": q["id"].to_numpy()[row], "bin": bin_.astype(np.int32), "n": counts[row, bin_]})

        counts = against(state).applyInArrow(histogram, "id long, bin int, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        running = counts.join(state, "id").withColumn("more", F.col("above") + F.sum("n").over(W.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)))
        running = running.withColumn("more", F.coalesce("more", "above"))
        found = F.struct("bin", "more", "low")
        chosen = running.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("more") + F.col("n") >= k, found)), F.min(found)).alias("c"))
        state = stored(chosen.select("id", (F.col("c.low") + F.col("c.bin") * F.lit(width).cast("long")).alias("low"), F.col("c.more").alias("above")), "bounds")

    def keep(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        order = np.argsort(c["id"].to_numpy(), kind="stable")
        c = c.take(order)
        s = scores(c, q, cell, kind)
        low, need = q["low"].to_numpy()[:, None], k - q["above"].to_numpy()[:, None]
        level = s == low
        row, col = np.nonzero((s > low) | (level & (np.cumsum(level, axis=1) <= need)))
        return pa.table({"query_id": q["id"].to_numpy()[row], "id": c["id"].to_numpy()[col], "score": s[row, col]})

    best = against(state).applyInArrow(keep, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
