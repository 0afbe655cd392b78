"""Prefix tries of conversations.

A conversation is the sequence of its turns' hashes, and each of its prefixes has a hash of its own, a sum over places.
Equal conversations become one sequence with a weight. Prefixes with more below them than a shard should hold are heavy;
they are found by counts from the top, and every sequence falls to the shard of its first prefix that isn't heavy. A task
builds the trie of its shards level by level, in level order, as a LOUDS bit vector with label arrays, and rolls sums up in
reverse level order with `add.at`. The heavy upper levels are a small trie of their own, whose nodes take the sums of the
subtrees below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, stored
from .shingles import mix

#: Turns below a prefix that one shard takes, heavy prefixes of one level at most, sequences that a shard takes whatever
#: their length, and consecutive conv_ids whose decimals are put together before they are hashed.
SHARD_TURNS, HEAVY_A_LEVEL, SHARD_SEQUENCES, ID_BITS = 200_000, 4096, 64, 12
ROOT = b"\0" * 16
NODE = "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, up binary"


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values data[bounds[i]:bounds[i + 1]] of bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def keys(pairs: np.ndarray) -> pa.Array:
    """Rows of two 64-bit hashes as binary values of 16 bytes."""
    return blobs(np.ascontiguousarray(pairs, np.uint64).view(np.uint8).ravel(), np.arange(len(pairs) + 1) * 16)


def pairs(column: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end as rows of `width` hashes (0: 32-bit sizes), and where each value starts."""
    step = 8 * width or 4
    values = column.to_pylist()
    flat = np.frombuffer(b"".join(values), "<u8" if width else "<u4")
    return flat.reshape(-1, width) if width else flat, np.cumsum([0, *(len(x) // step for x in values)])


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order (null first; ties by a hash of role and text): turns array<struct<turn, hi, lo, size>>."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct("turn", F.xxhash64(role, text).alias("hi"), F.xxhash64(F.lit(7), role, text).alias("lo"), F.octet_length(text).alias("size")).alias("row")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))


def with_shared_heads(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % group, h = crc32(c) % most.

    All that the other one has, if it has fewer; none if it isn't there. A negative c counts from the next multiple below.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    heads = turns.where(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = turns.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.expr("slice(head, 1, h)"), own)).alias("turns"))


def chained(turns: DataFrame) -> DataFrame:
    """conv_id, n, node (the whole sequence's key), prefixes (16 bytes for each depth from 1 on), sizes (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(x) for x in batch.column(1)], np.int64)
            start = np.cumsum(n) - n
            place = mix((np.arange(int(n.sum())) - np.repeat(start, n)).astype(np.uint64) + np.uint64(1))
            both = np.empty((len(place), 2), np.uint64)
            for side in (0, 1):
                own = batch.column(1 + side).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                total = np.cumsum(np.append(np.uint64(0), mix(own * np.uint64(2 * side + 3) + place)), dtype=np.uint64)
                both[:, side] = total[1:] - np.repeat(total[start], n)
            ends = np.zeros((len(n), 2), np.uint64)
            ends[n > 0] = both[(start + n - 1)[n > 0]]
            bounds = np.append(start, len(place))
            sizes = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), keys(ends), blobs(both.view(np.uint8).ravel(), bounds * 16), blobs(sizes.view(np.uint8), bounds * 4)], ["conv_id", "n", "node", "prefixes", "sizes"]
            )

    return turns.select("conv_id", "turns.hi", "turns.lo", "turns.size").mapInArrow(run, "conv_id long, n long, node binary, prefixes binary, sizes binary")


class Heavy:
    """Heavy prefixes by depth."""

    def __init__(self) -> None:
        self.levels: dict[int, dict[str, np.ndarray]] = {}

    def add(self, table: pa.Table) -> None:
        node, up = pairs(table.column("node").combine_chunks())[0], pairs(table.column("up").combine_chunks())[0]
        depth, size = table.column("depth").to_numpy(), table.column("size").to_numpy()
        for d in np.unique(depth):
            here = np.flatnonzero(depth == d)
            here = here[np.argsort(node[here, 0])]
            self.levels[int(d)] = {"node": node[here], "up": up[here], "size": size[here]}

    def has(self, depth: int, found: np.ndarray) -> np.ndarray:
        if depth == 0:
            return np.ones(len(found), bool)
        if depth not in self.levels:
            return np.zeros(len(found), bool)
        known = self.levels[depth]["node"]
        at = np.minimum(np.searchsorted(known[:, 0], found[:, 0]), len(known) - 1)
        return (known[at] == found).all(axis=1)


def prefixes_at(flat: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    return flat[start + depth - 1] if depth else np.zeros((len(start), 2), np.uint64)


def heavy_prefixes(sequences: DataFrame, limit: int) -> Heavy:
    """Prefixes of more than `limit` turns and SHARD_SEQUENCES sequences, from the top down, some levels at a time.

    Only sequences below a heavy prefix are looked at again. What reaches the driver is at most total / limit prefixes a
    level.
    """
    context, heavy, depth, step = sequences.sparkSession.sparkContext, Heavy(), 0, 2
    while True:
        shared = context.broadcast(heavy)

        def run(batches: Iterator[pa.RecordBatch], depth=depth, step=step, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, start = pairs(batch.column(1))
                size, _ = pairs(batch.column(2), 0)
                n = batch.column(0).to_numpy()
                row = np.flatnonzero(n > depth)
                row = row[shared.value.has(depth, prefixes_at(flat, start[row], depth))]
                for d in range(depth + 1, depth + step + 1):
                    row = row[n[row] >= d]
                    if not len(row):
                        break
                    node, up = prefixes_at(flat, start[row], d), prefixes_at(flat, start[row], d - 1)
                    yield pa.RecordBatch.from_arrays([keys(node), keys(up), pa.array(np.full(len(row), d)), pa.array(size[start[row] + d - 1].astype(np.int64)), pa.array(n[row])], ["node", "up", "depth", "size", "turns"])

        found = sequences.select("n", "prefixes", "sizes").mapInArrow(run, "node binary, up binary, depth long, size long, turns long").groupBy("node", "up", "depth", "size")
        table = found.agg(F.sum("turns").alias("turns"), F.count("*").alias("sequences")).where((F.col("turns") > limit) & (F.col("sequences") > SHARD_SEQUENCES)).drop("turns", "sequences").toArrow()
        heavy.add(table)
        depth, step = depth + step, min(64, 2 * step)
        if depth not in heavy.levels:
            return heavy


class Louds:
    """A forest in level order: a bit vector with a 1 for each child and a 0 after the last, node by node, from a super-root on.

    Node i (from 1; 0 is the super-root) is the i-th 1; its parent is the number of zeros before that.
    """

    def __init__(self, parents: np.ndarray, levels: list[int]):
        degree = np.bincount(parents, minlength=len(parents) + 1)
        bits = np.ones(2 * len(parents) + 1, bool)
        bits[np.cumsum(degree + 1) - 1] = False
        self.bits, self.length, self.levels = np.packbits(bits), len(bits), levels

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~np.unpackbits(self.bits, count=self.length).astype(bool))
        return np.diff(zeros, prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Of nodes 1, 2, ...; the super-root comes first as its own."""
        bits = np.unpackbits(self.bits, count=self.length).astype(bool)
        return np.append(0, np.cumsum(~bits)[bits])

    def roll_up(self, size: np.ndarray, convs: np.ndarray, least: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
        """Add each node's sums to its parent's, deepest level first. All arrays have an entry for the super-root."""
        parent, degree = self.parents(), self.degrees()
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            up = parent[a:b]
            leaves[a:b] += (degree[a:b] == 0) & (leaves[a:b] == 0)
            saved[a:b] += (convs[a:b] - 1) * size[a:b]
            np.add.at(convs, up, convs[a:b])
            np.minimum.at(least, up, least[a:b])
            np.add.at(leaves, up, leaves[a:b])
            np.add.at(saved, up, saved[a:b])


FAR = np.iinfo(np.int64).max


def shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes of whole subtrees: rows (n, cut, weight, least, up, prefixes, sizes), prefixes and sizes from depth `cut` on."""
    flat, start = pairs(rows.column("prefixes").combine_chunks())
    size, _ = pairs(rows.column("sizes").combine_chunks(), 0)
    up, _ = pairs(rows.column("up").combine_chunks())
    cut, weight, low = (rows.column(c).to_numpy() for c in ("cut", "weight", "least"))
    n = np.diff(start)
    row, parent_of = np.arange(len(n)), np.zeros(len(n), np.int64)
    ends, levels, parts = np.zeros(len(n), np.int64), [1], []
    depth = 0
    while len(row):
        label = flat[start[row] + depth]
        order = np.lexsort((label[:, 1], label[:, 0], parent_of[row]))
        row, label = row[order], label[order]
        new = np.ones(len(row), bool)
        new[1:] = (label[1:] != label[:-1]).any(axis=1) | (parent_of[row][1:] != parent_of[row][:-1])
        first = row[new]
        parts.append((parent_of[first], label[new], size[start[first] + depth], cut[first] + depth, first))
        parent_of[row] = levels[-1] + np.cumsum(new) - 1
        levels.append(levels[-1] + len(first))
        over = n[row] == depth + 1
        ends[row[over]] = parent_of[row[over]]
        row, depth = row[~over], depth + 1
    parents, label, bytes_, depths, first = (np.concatenate([p[i] for p in parts]) for i in range(5))
    trie = Louds(parents, levels)
    count = len(parents) + 1
    convs, least, leaves, saved = np.zeros(count, np.int64), np.full(count, FAR), np.zeros(count, np.int64), np.zeros(count, np.int64)
    np.add.at(convs, ends, weight)
    np.minimum.at(least, ends, low)
    trie.roll_up(np.append(0, bytes_.astype(np.int64)), convs, least, leaves, saved)
    above = trie.parents()[1:]
    inner = pa.array(least[above], mask=above == 0)
    tops = int((above == 0).sum())
    ups = pa.concat_arrays([keys(up[first[:tops]]), pa.nulls(count - 1 - tops, pa.binary())])
    return pa.RecordBatch.from_arrays(
        [keys(label), pa.array(depths), pa.array(least[1:]), inner, pa.array(convs[1:]), pa.array(trie.degrees()[1:].astype(np.int64)), pa.array(leaves[1:]), pa.array(saved[1:]), ups],
        [x.split()[0] for x in NODE.split(", ")],
    )


def upper_nodes(heavy: Heavy, sums: pa.Table) -> pa.RecordBatch:
    """The heavy prefixes and the root as nodes; sums: what lies below each without a heavy prefix in between."""
    place, levels, parents, label, size = {ROOT: 1}, [1, 2], [np.zeros(1, np.int64)], [np.zeros((1, 2), np.uint64)], [0, 0]
    for d in sorted(heavy.levels):
        level = heavy.levels[d]
        at = np.array([place[x.tobytes()] for x in level["up"]], np.int64)
        order = np.argsort(at, kind="stable")
        parents.append(at[order])
        label.append(level["node"][order])
        size += level["size"][order].tolist()
        place |= {x.tobytes(): levels[-1] + k for k, x in enumerate(label[-1])}
        levels.append(levels[-1] + len(order))
    label, depths = np.concatenate(label), np.repeat(np.arange(len(levels) - 1), np.diff(levels))
    trie = Louds(np.concatenate(parents), levels)
    count = len(label) + 1
    convs, least, leaves, saved, below = np.zeros(count, np.int64), np.full(count, FAR), np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for node, *values in zip(*(sums.column(c).to_pylist() for c in ("node", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")), strict=True):
        k = place[node]
        convs[k], least[k], below[k], leaves[k], saved[k] = values
    trie.roll_up(np.array(size, np.int64), convs, least, leaves, saved)
    above = trie.parents()[1:]
    return pa.RecordBatch.from_arrays(
        [keys(label), pa.array(depths), pa.array(least[1:]), pa.array(least[above], mask=above == 0), pa.array(convs[1:]), pa.array(below[1:] + trie.degrees()[1:]), pa.array(leaves[1:]), pa.array(saved[1:]), pa.nulls(count - 1, pa.binary())],
        [x.split()[0] for x in NODE.split(", ")],
    )


def split_at_heavy(sequences: DataFrame, heavy: Heavy) -> DataFrame:
    """weight, least, cut, top (the first prefix that isn't heavy; null if there is none), up (the one before), and the rest from `cut` on."""
    shared = sequences.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, least = (batch.column(k) for k in range(3))
            n = n.to_numpy()
            flat, start = pairs(batch.column(3))
            cut = np.ones(len(n), np.int64)
            row, depth = np.arange(len(n)), 1
            while len(row):
                row = row[n[row] >= depth]
                row = row[shared.value.has(depth, prefixes_at(flat, start[row], depth))]
                depth += 1
                cut[row] = depth
            whole = n >= cut
            top = np.zeros((len(n), 2), np.uint64)
            top[whole] = flat[(start[:-1] + cut - 1)[whole]]
            up = np.zeros((len(n), 2), np.uint64)
            up[cut > 1] = flat[(start[:-1] + cut - 2)[cut > 1]]
            tops = [x if w else None for x, w in zip(keys(top).to_pylist(), whole.tolist(), strict=True)]
            parts = [[x[w * (c - 1) :] for x, c in zip(batch.column(k).to_pylist(), cut.tolist(), strict=True)] for k, w in ((3, 16), (4, 4))]
            yield pa.RecordBatch.from_arrays([weight, least, pa.array(cut), pa.array(tops, pa.binary()), keys(up), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], ["weight", "least", "cut", "top", "up", "prefixes", "sizes"])

    return sequences.select("n", "weight", "least", "prefixes", "sizes").mapInArrow(run, "weight long, least long, cut long, top binary, up binary, prefixes binary, sizes binary")


def shard_tries(parts: DataFrame, limit: int) -> DataFrame:
    """The nodes of all subtrees below heavy prefixes. A task takes its subtrees in turn, about `limit` turns at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        turns = 0
        for batch in batches:
            held.append(batch)
            turns += sum(len(x) // 4 for x in batch.column("sizes").to_pylist())
            if turns > limit:
                rows = pa.Table.from_batches(held)
                tops = rows.column("top").to_pylist()
                last = len(tops) - 1
                while last and tops[last - 1] == tops[-1]:
                    last -= 1
                if last:  # the last subtree may go on
                    yield shard_nodes(rows.slice(0, last))
                    held = rows.slice(last).to_batches()
                    turns = sum(len(x) // 4 for x in rows.slice(last).column("sizes").to_pylist())
        if held and sum(b.num_rows for b in held):
            yield shard_nodes(pa.Table.from_batches(held))

    return parts.where("top is not null").repartition("top").sortWithinPartitions("top").mapInArrow(run, NODE)


def ends_digests(chains: DataFrame) -> DataFrame:
    """node, ends_sha256: of the decimal conv_ids of the conversations that end there, ascending, joined by commas.

    Ids are put together in ranges first; a node's digest is then taken over its ranges as they stream by in order.
    """
    ids = chains.select("node", F.expr(f"shiftright(conv_id, {ID_BITS})").alias("chunk"), "conv_id").groupBy("node", "chunk").agg(F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return ids.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all conversations (conv_id, turns as `conversation_turns` gives them).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row
    for each distinct sequence of first turns, the empty one included. A turn is known by a 128-bit hash of role and text:
    null and empty are the same, rows without a conv_id take no part, repeated rows are turns of their own, a very long
    text counts by its hash and bytes alone, other columns play no part, and an empty table gives an empty table. A
    conversation's hashes (20 bytes a turn) are held together; nothing else is held whole, however many conversations
    begin alike or are equal.
    """
    chains = stored(chained(turns), "chains")
    same = chains.groupBy("node", "n").agg(F.count("*").alias("weight"), F.min("conv_id").alias("least"), F.first("prefixes").alias("prefixes"), F.first("sizes").alias("sizes"))
    sequences = stored(same, "sequences")
    total = sequences.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(shard_turns, total // HEAVY_A_LEVEL)
    heavy = heavy_prefixes(sequences, limit)
    parts = split_at_heavy(sequences, heavy)
    light = stored(shard_tries(parts, limit), "light")
    tops = light.where("up is not null")
    sums = tops.select(F.col("up").alias("node"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    none = F.lit(0).cast("long")
    ending = parts.where("top is null").select(F.col("up").alias("node"), F.col("weight").alias("n_convs"), F.col("least").alias("conv_id"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"))
    sums = sums.unionByName(ending).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.min("conv_id").alias("conv_id"))
    shared = turns.sparkSession.sparkContext.broadcast(heavy)

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield upper_nodes(shared.value, pa.Table.from_batches(rows))

    # as many rows as there are heavy prefixes
    above = stored(sums.repartition(1).mapInArrow(upper, NODE), "upper")
    named = beside(tops.drop("parent_conv_id").withColumn("part", F.pmod(F.hash("node"), F.lit(64))), above.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up")
    columns = [x.split()[0] for x in NODE.split(", ")][:-1]
    nodes = light.where("up is null").select(columns).unionByName(named.select(columns)).unionByName(above.select(columns))
    nothing = hashlib.sha256(b"").hexdigest()
    whole = nodes.join(ends_digests(chains), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
