"""Near-duplicate documents by MinHash and odd sketches.

A document's MinHash samples do two things: bands of them are bucket keys, and all of them together are folded into an
odd sketch, a bitmap in which every sample flips one bit. The population count of two sketches' XOR estimates a high
similarity well, so of the pairs that the buckets propose, few are looked up in vain. Links are confirmed on full sets.

Pairs are never listed within a group. Equal sets are one text from the start. Every text is held against one leader of
each of its buckets, which settles groups of alike texts in linear time. Texts that share buckets and are still apart
after that are compared block by block inside tasks, and a task returns only the links that join something new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, components, released, stored
from .shingles import distinct, mix, shingles

#: Bands, samples in a band, bits of a sketch. At a similarity of 0.85 the bands miss 1 link in 10 million, at 0.8 1 in 60,000.
BANDS, ROWS, BITS = 28, 5, 512
SAMPLES = BANDS * ROWS
#: Documents and shingles of a block of texts that are compared inside one task.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: How far below the threshold an estimate must lie for a pair to be passed over at first: 5 standard deviations.
SLACK = 0.18

_TURNS = np.random.default_rng(71).integers(1, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = np.random.default_rng(72).integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def samples(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) MinHash samples; none of the texts may be without shingles."""
    out = np.empty((len(start) - 1, SAMPLES), np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    line = np.empty(len(hashes), np.uint32)
    for i in range(SAMPLES):
        np.multiply(high, _TURNS[i], out=line)
        np.add(line, low, out=line)
        out[:, i] = np.minimum.reduceat(line, start[:-1])
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; keys of different bands differ."""
    key = np.zeros((len(sample), BANDS), np.uint64)
    for k in range(ROWS):
        key = mix(key + sample[:, k::ROWS] + _SALTS[None, k::ROWS])
    return key.view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """(texts, BITS / 64) bitmaps of parity."""
    bit = (mix(sample + _SALTS[None, :]) % np.uint64(BITS)).astype(np.int64)
    cell = np.bincount((np.arange(len(sample))[:, None] * BITS + bit).ravel(), minlength=len(sample) * BITS)
    return np.packbits((cell & 1).astype(bool).reshape(-1, BITS), axis=1).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two odd sketches (arrays of long) suggest."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    share = F.least(apart / BITS, F.lit(0.499))
    return 1 + F.log(1 - 2 * share) * (BITS / (4.0 * SAMPLES))


def parts(texts: list[bytes], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, so that arrays fit in a processor's cache."""
    begin = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield begin, at + 1
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, part (of rows read together), n (distinct shingles), content (digest of the set), bands and sketch; the last three are null if n is 0."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        released()
        for batch in sliced(batches):
            ids = batch.column(0)
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for a, b in parts(texts):
                hashes, start = distinct(*shingles(texts[a:b], size))
                n = np.diff(start)
                some = n > 0
                content, key, sketch = np.full(b - a, None, object), np.full(b - a, None, object), np.full(b - a, None, object)
                if some.any():
                    sample = samples(hashes, np.append(start[:-1][some], len(hashes)))
                    content[some] = [hashlib.md5(hashes[x:y].tobytes()).digest() for x, y in zip(start[:-1][some], start[1:][some], strict=True)]
                    for column, value in ((key, bands(sample)), (sketch, odd_sketch(sample))):
                        for k, x in zip(np.flatnonzero(some), value, strict=True):
                            column[k] = x
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([part] * (b - a), pa.int32()), pa.array(n), pa.array(content, pa.binary()), pa.array(key, longs), pa.array(sketch, longs)], ["doc_id", "part", "n", "content", "bands", "sketch"])
        released()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(signed, "doc_id long, part int, n long, content binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and set: the sorted distinct shingle hashes, as an array of long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for a, b in parts(texts):
                hashes, start = distinct(*shingles(texts[a:b], size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(start.astype(np.int32), hashes.view(np.int64))], ["doc_id", "set"])
        released()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, set array<long>")


def linked_blocks(percent: int):
    """A function of a table of texts (doc, label, side, set) that gives links (a, b) between its labels, a forest."""

    def links(table: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        label, side = np.unique(table["label"].to_numpy(), return_inverse=True)[1], table["side"].to_numpy()
        if label.max(initial=0) == 0:
            return empty
        doc = table["doc"].to_numpy()
        lists = table["set"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(n), len(n)), np.float32)  # counts below 2**24 are exact
        for low in range(0, int(column.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            dense = np.zeros((len(n), 4096), np.float32)
            dense[row[a:b], column[a:b] - low] = 1
            common += dense @ dense.T
        both = common.astype(np.int64)
        near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        near &= label[:, None] != label[None, :]
        if side.max() > side.min():
            near &= side[:, None] != side[None, :]
        root = list(range(label.max() + 1))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        left, right = np.nonzero(np.triu(near))
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = top(label[a]), top(label[b])
            if x != y:
                root[x] = y
                out.append((doc[a], doc[b]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())}) if out else empty

    return links


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles of `size` words >= `percent` * all their shingles; a text of fewer
    words is one shingle, and a text that is null or has no words is linked with nothing. component_id is the smallest
    doc_id that can be reached over links, kept says whether it is the row's own. Rows that repeat a doc_id are one
    document, linked with all that any of its texts is like; n_shingles is that of the row. Rows without a doc_id stand
    alone, with component_id null and kept true. Other columns play no part, and an empty table gives an empty one.
    """
    rows = stored(signatures(docs, size), "signatures")
    full = rows.where("n > 0 and doc_id is not null")
    # an equal set is one text, under its smallest doc_id; minima are taken by part first, and told by part
    first = full.groupBy("content", "part").agg(F.min("doc_id").alias("text_id")).groupBy("content").agg(F.min("text_id").alias("text_id"))
    named = stored(beside(full, first, "content"), "named")
    texts = named.where("doc_id = text_id").dropDuplicates(["doc_id", "content"]).select("doc_id", "part", "n", "bands", "sketch")

    keys = texts.select("doc_id", "part", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key", "part").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n"))
    leaders = leaders.groupBy("key").agg(F.min("leader").alias("leader"), F.sum("n").alias("n")).where("n > 1").select("key", "leader")
    tries = stored(beside(keys, leaders, "key").where("doc_id <> leader").select("doc_id", "part", "leader").distinct(), "tries")

    # without the hints, small tables would be broadcast and only large ones shuffled; an id with several texts has
    # several sketches and sets, each of which is held against those of its leaders
    touched = tries.select("doc_id").unionByName(tries.select(F.col("leader").alias("doc_id"))).distinct()
    sets = stored(full_sets(docs.join(touched.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), size), "sets")
    sketches = texts.join(touched.hint("merge"), "doc_id", "left_semi").select("doc_id", "sketch", F.col("n").alias("size"))
    other = lambda df, **names: df.select(*(F.col(k).alias(v) for k, v in names.items()))
    likely = beside(tries.join(sketches.hint("merge"), "doc_id"), other(sketches, doc_id="leader", sketch="theirs", size="their_size"), "leader")
    likely = likely.where(estimate(F.col("sketch"), F.col("theirs")) >= percent / 100 - SLACK).where(100 * F.least("size", "their_size") >= percent * F.greatest("size", "their_size"))
    likely = stored(likely.select("doc_id", "part", "leader").distinct(), "likely")
    checked = beside(likely, other(sets, doc_id="leader", set="theirs"), "leader").join(sets.hint("merge"), "doc_id")
    both = F.size(F.array_intersect("set", "theirs")).cast("long")
    stars = checked.where(100 * both >= percent * (F.size("set") + F.size("theirs") - both))
    stars = stored(stars.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct(), "stars")

    # what shares buckets and is still apart: in pairs of blocks of a family, or bucket by bucket, whichever sends a text
    # less often: as many times as the family has blocks, or as there are bands
    label = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    cluster = components(tries.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    placed = cluster.join(label.hint("merge"), "doc_id", "left").select("doc_id", "cluster", F.coalesce("label", "doc_id").alias("label"))
    placed = stored(placed.join(sketches.groupBy("doc_id").agg(F.sum("size").alias("size")).hint("merge"), "doc_id"), "placed")
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")

    def apart(members: DataFrame) -> DataFrame:
        """Groups of several labels; of two texts, the star has settled the link."""
        found = members.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("docs"), F.sum("size").alias("shingles"))
        return found.where("low <> high and docs > 2").select("group", blocks.alias("blocks"))

    families = placed.withColumnRenamed("cluster", "group")
    open_ = stored(apart(families), "families")
    large = open_.where(F.col("blocks") > BANDS).select(F.col("group").alias("cluster"))
    in_bucket = placed.join(large.hint("merge"), "cluster", "left_semi").select("doc_id", "label", "size")
    in_bucket = stored(in_bucket.join(keys.select("doc_id", F.col("key").alias("group")).distinct().hint("merge"), "doc_id"), "buckets")
    small = families.join(open_.where(F.col("blocks") <= BANDS).hint("merge"), "group").select(F.lit(False).alias("bucket"), "group", "doc_id", "label", "blocks")
    dealt = small.unionByName(in_bucket.join(apart(in_bucket).hint("merge"), "group").select(F.lit(True).alias("bucket"), "group", "doc_id", "label", "blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "doc_id", "label")
    inside = dealt.join(sets.hint("merge"), "doc_id").select("bucket", "group", "i", "j", "side", F.col("doc_id").alias("doc"), "label", "set")
    more = inside.groupBy("bucket", "group", "i", "j").applyInArrow(linked_blocks(percent), "a long, b long")

    # an id with several texts links what they are under
    of_row = named.select("doc_id", "text_id").distinct()
    own = of_row.groupBy("doc_id").agg(F.min("text_id").alias("b"), F.max("text_id").alias("last")).where("b <> last").select("doc_id", "b")
    own = of_row.join(own.hint("merge"), "doc_id").select(F.col("text_id").alias("a"), "b")
    joined = components(stored(stars.unionByName(more).unionByName(own), "links")).select(F.col("node").alias("text_id"), F.col("component").alias("joined"))

    of_text = beside(named.select("doc_id", "part", "text_id"), joined, "text_id").select("doc_id", F.col("joined").alias("component"))
    of_id = named.select("doc_id", F.col("text_id").alias("component")).unionByName(of_text).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = rows.select("doc_id", "n").join(of_id.hint("merge"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
