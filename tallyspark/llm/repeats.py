"""Repeated byte strings across documents, removed with run-length indexes.

A string of SPAN bytes is found through its anchor: of the K-grams inside it, the one with the smallest hash, leftmost
first. Equal strings have equal anchors, so only anchors that occur in two documents matter, and text around others is
never moved. Text around shared anchors is gathered by anchor, every distinct stretch once with the smallest doc_id
that has it. Where an anchor has several stretches, all but that of the last document go into a run-length index, and
all but that of the first are streamed through it: matching statistics tell where SPAN bytes match, and the index holds
the earliest document of each such string. A stretch that no earlier one is like is never sorted.

Texts travel as compressed batches, hashes and answers as packed arrays, so a shuffled row is large and rows are few.
An anchor in very many documents is sent once or twice by each batch; where it has many different stretches, its
strings are dealt one by one by their own hashes, so no anchor makes a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .runindex import RunIndex
from .shingles import mix, powers

#: Bytes of a repeated string, of an anchor's gram, and how many grams lie in a string.
SPAN, K = 50, 24
GRAMS = SPAN - K + 1
#: Bytes of text in a batch (a longer document is a batch by itself), places looked at together, and the number of
#: batches from which an anchor's strings are dealt one by one.
BATCH, CHUNK, HOT = 1_500_000, 1 << 18, 2048
#: Rows of a batch at most, and bytes of the stretches whose anchors share an index.
ROWS, INDEXED = 60_000, 400_000
LAST = np.iinfo(np.int64).max
_BYTES = np.random.default_rng(501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xA24BAED4963EE407
_FACTOR = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8)}


def batched(docs: DataFrame, text: str, most: int) -> DataFrame:
    """`docs` in compressed Arrow batches: batch (a number), body."""
    column = docs.columns.index(text)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        squeeze = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy()
            begin = 0
            while begin < len(sizes):
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin : begin + ROWS]), most, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema) as out:
                    out.write_batch(whole.slice(begin, end - begin))
                yield pa.RecordBatch.from_pydict({"batch": [number], "body": [squeeze.compress(sink.getvalue())]}, pa.schema({"batch": pa.int64(), "body": pa.binary()}))
                number, begin = number + 1, end

    return docs.mapInArrow(packed, "batch long, body binary")


def opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31)).read_all()


def flat_text(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text starts (one more entry at the end). Null is empty."""
    raw = pc.fill_null(table[text].combine_chunks(), "").cast(pa.large_binary())
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8), bounds - bounds[0]


def doc_ids(table: pa.Table, key: str) -> np.ndarray:
    """doc_ids as integers; a null one counts as larger than all others."""
    return pc.fill_null(table[key].cast(pa.int64()), LAST).to_numpy()


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """The hash of the K bytes from each place."""
    one = _BYTES[x]
    two = one[:-1] * _FACTOR[1] + one[1:]
    four = two[:-2] * _FACTOR[2] + two[2:]
    eight = four[:-4] * _FACTOR[4] + four[4:]
    return mix((eight[:-16] * _FACTOR[8] + eight[8:-8]) * _FACTOR[8] + eight[16:])


def anchors(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of every anchor: the strings that it stands for start at the places first to last."""
    inside = np.zeros(len(flat) + 1, np.int32)
    long = np.diff(bounds) >= SPAN
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - SPAN + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    place = np.arange(CHUNK + GRAMS, dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    found = []
    for at in range(0, len(flat) - SPAN + 1, CHUNK):
        part = flat[at : at + CHUNK + SPAN - 1]
        hashed = gram_hashes(part)
        best = (hashed & ~low) | place[: len(hashed)]
        for step in (1, 2, 4, 8):
            best = np.minimum(best[:-step], best[step:])
        best = np.minimum(best[: -(GRAMS - 16)], best[GRAMS - 16 :])
        own = (best & low).astype(np.int64)
        own[~inside[at : at + len(own)]] = -1
        new = np.flatnonzero(np.diff(own, prepend=-2))
        end = np.append(new[1:], len(own)) - 1
        real = own[new] >= 0
        new, end = new[real], end[real]
        found.append((hashed[own[new]], new + at, end + at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pack6(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def key_of(hashed: np.ndarray) -> np.ndarray:
    return hashed >> np.uint64(16)


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges of a sorted bucket column."""
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]), slice(a, b)


def anchor_keys(buckets: int, text: str, key: str):
    """Batches to (bucket, batch, keys): each anchor of the batch, twice if two of its documents have it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                table = opened(body)
                flat, bounds = flat_text(table, text)
                hashed, first, _ = anchors(flat, bounds)
                owner = doc_ids(table, key)[np.searchsorted(bounds, first, "right") - 1] if len(first) else first
                order = np.argsort(hashed)
                hashed, owner = hashed[order], owner[order]
                start = np.flatnonzero(np.diff(hashed, prepend=~hashed[:1]))
                twice = np.minimum.reduceat(owner, start) < np.maximum.reduceat(owner, start) if len(start) else np.zeros(0, bool)
                hashed = np.repeat(hashed[start], 1 + twice)
                bucket = ((hashed & np.uint64((1 << 32) - 1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, bucket = key_of(hashed[order]), bucket[order]
                out = [(b, pack6(keys[part])) for b, part in dealt(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "batch", "keys"])

    return made


def shared_keys(hot: int):
    """A bucket's keys that two documents have, told to each batch that has them; the top bit marks those of `hot` batches or so."""

    def made(table: pa.Table) -> pa.Table:
        parts = [unpack6(x) for x in table["keys"].to_pylist()]
        found, times = np.unique(np.concatenate(parts), return_counts=True)
        found, times = found[times > 1], times[times > 1]
        marked = found | np.where(times >= hot, np.uint64(1 << 63), np.uint64(0))
        out = []
        for number, keys in zip(table["batch"].to_pylist(), parts, strict=True):
            at = np.searchsorted(found, keys)
            at = np.unique(at[(at < len(found)) & (found[np.minimum(at, len(found) - 1)] == keys)]) if len(found) else at[:0]
            if len(at):
                out.append((number, marked[at].tobytes()))
        return pa.table({"batch": pa.array([x for x, _ in out], pa.int64()), "bucket": pa.array([-1] * len(out), pa.int32()), "body": pa.array([x for _, x in out], pa.binary())})

    return made


@lru_cache(maxsize=2)
def usual_powers(base: int) -> np.ndarray:
    return powers(base, BATCH + 1)


def powers_of(base: int, n: int) -> np.ndarray:
    return usual_powers(base)[:n] if n <= BATCH + 1 else powers(base, n)


class Stretches:
    """The text of a batch around its shared anchors: places, and the distinct stretches that they show."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, ids: np.ndarray, marked: np.ndarray, buckets: int):
        hashed, first, last = anchors(flat, bounds)
        key = key_of(hashed)
        hot = (marked >> np.uint64(63)).astype(bool)
        known = marked & np.uint64((1 << 63) - 1)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        take = known[at] == key if len(known) else np.zeros(len(key), bool)
        key, first, last, hot = key[take], first[take], last[take], hot[at[take]] if len(known) else take[:0]
        if hot.any():  # one stretch for each string
            many = (last - first + 1)[hot]
            single = np.repeat(first[hot], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            key, first, last = np.append(key[~hot], np.zeros(len(single), np.uint64)), np.append(first[~hot], single), np.append(last[~hot], single)
            singles = len(single)
        else:
            singles = 0
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.take(_BYTES, flat, out=sums[1:])
        sums[1:] *= powers_of(_BASE, len(flat))
        np.cumsum(sums, out=sums)
        down = powers_of(pow(_BASE, -1, 1 << 64), len(flat) + 1)
        size = last - first + SPAN
        print_ = mix((sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64))
        if singles:
            key[-singles:] = key_of(print_[-singles:])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((print_, key, bucket))
        self.first, self.last, key, print_, bucket = first[order], last[order], key[order], print_[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (print_[1:] != print_[:-1]) | (key[1:] != key[:-1])
        self.of = np.cumsum(new) - 1  # the stretch at each place
        self.owner = ids[np.searchsorted(bounds, self.first, "right") - 1] if len(order) else np.zeros(0, np.int64)
        start = np.flatnonzero(new)
        self.least = np.minimum.reduceat(self.owner, start) if len(start) else np.zeros(0, np.int64)
        self.key, self.print, self.bucket, self.begin, self.size = key[start], print_[start], bucket[start], self.first[start], size[order][start]


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many stretches, end to end."""
    return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def marked_keys(answers: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x, b in zip(answers["body"].to_pylist(), answers["bucket"].to_pylist(), strict=True) if b < 0]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def stretch_rows(buckets: int, text: str, key: str):
    """A batch and the keys that it shares to (bucket, batch, body): its distinct stretches by bucket."""

    def made(batch: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if batch.num_rows and answers.num_rows:
            table = opened(batch["body"][0].as_py())
            flat, bounds = flat_text(table, text)
            s = Stretches(flat, bounds, doc_ids(table, key), marked_keys(answers), buckets)
            squeeze = zstandard.ZstdCompressor(level=3)
            for b, part in dealt(s.bucket):
                raw = b"".join((np.array([part.stop - part.start], np.int64).tobytes(), s.key[part].tobytes(), s.print[part].tobytes(), s.least[part].tobytes(), s.size[part].astype(np.uint8).tobytes(), gathered(flat, s.begin[part], s.size[part]).tobytes()))
                rows.append((b, batch["batch"][0].as_py(), squeeze.compress(raw)))
        return pa.table({"bucket": pa.array([x[0] for x in rows], pa.int32()), "batch": pa.array([x[1] for x in rows], pa.int64()), "body": pa.array([x[2] for x in rows], pa.binary())})

    return made


def earliest_holders(table: pa.Table) -> pa.Table:
    """A bucket's stretches to (batch, bucket, body): for every string of each batch's stretches, the least doc_id that has it.

    body: the places, counted over the batch's stretches in order, where that doc_id changes, and the doc_ids.
    """
    squeeze, unsqueeze = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for body in table["body"].to_pylist():
        raw = unsqueeze.decompress(body)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at = 8
        for column, kind in zip(columns, (np.uint64, np.uint64, np.int64, np.uint8), strict=False):
            column.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        columns[4].append(np.frombuffer(raw, np.uint8, -1, at))
    counts = [len(x) for x in columns[0]]
    key, print_, least, size, text = (np.concatenate(x) for x in columns)
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.lexsort((print_, key))
    new = np.ones(len(order), bool)
    new[1:] = (print_[order][1:] != print_[order][:-1]) | (key[order][1:] != key[order][:-1])
    start = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    one = order[start]  # a row for each distinct stretch
    first_doc = np.minimum.reduceat(least[order], start)
    strings = size[one] - SPAN + 1
    base = np.cumsum(strings) - strings
    answer = np.repeat(first_doc, strings)
    # the distinct stretches of each anchor, by their first documents
    by_doc = np.lexsort((first_doc, key[one]))
    same = key[one][by_doc][1:] == key[one][by_doc][:-1]
    indexed, streamed = np.append(same, False), np.append(False, same)
    some = np.flatnonzero(indexed | streamed)
    volume = np.cumsum(size[one][by_doc][some])
    begins = some[~streamed[some]]
    part = np.searchsorted(begins, some, "right") - 1  # the anchor, and then the index that it belongs to
    part = (volume[np.searchsorted(some, begins)] // INDEXED)[part] if len(some) else part
    for rows in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []:
        held, asked = by_doc[rows[indexed[rows]]], by_doc[rows[streamed[rows]]]
        index = RunIndex(gathered(text, begin[one[held]], size[one[held]]), size[one[held]], first_doc[held], SPAN)
        found = index.matched(gathered(text, begin[one[asked]], size[one[asked]]), size[one[asked]])
        wide = strings[asked]
        at = np.repeat(base[asked] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        answer[at] = np.minimum(answer[at], found)
    out = []
    at = 0
    for number, n in zip(table["batch"].to_pylist(), counts, strict=True):
        mine = of[at : at + n]
        at += n
        wide = strings[mine]
        value = answer[np.repeat(base[mine] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))]
        change = np.flatnonzero(np.diff(value, prepend=~value[:1]))
        out.append((number, squeeze.compress(np.array([len(value), *change], np.int64).tobytes() + value[change].tobytes())))
    return pa.table({"batch": pa.array([x for x, _ in out], pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(out), pa.int32()), "body": pa.array([x for _, x in out], pa.binary())})


def removed_bytes(flat: np.ndarray, bounds: np.ndarray, ids: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of a batch are covered by a string that an earlier document has."""
    cover = np.zeros(len(flat) + 1, np.int32)
    told = sorted((b, x) for b, x in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True) if b >= 0)
    if told:
        s = Stretches(flat, bounds, ids, marked_keys(answers), buckets)
        values = []
        for _, body in told:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int64)
            n = (len(raw) - 1) // 2
            values.append(np.repeat(raw[n + 1 :], np.diff(np.append(raw[1 : n + 1], raw[0]))))
        value = np.concatenate(values)
        strings = s.size - SPAN + 1
        base = np.cumsum(strings) - strings
        wide = s.last - s.first + 1
        ahead = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        gone = value[np.repeat(base[s.of], wide) + ahead] < np.repeat(s.owner, wide)
        place = (np.repeat(s.first, wide) + ahead)[gone]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + SPAN, -1)
    return np.cumsum(cover)[:-1] > 0


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a SPAN-byte string that also starts in a document with a smaller doc_id.

    Columns of `docs` other than `text` pass through, whatever their names (but for those named next, which are
    replaced); then n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256. With `texts`, the text comes too,
    without the removed bytes (where a character was cut, its other bytes go as well). A null text is empty, and with
    `texts` stays null; a text of under SPAN bytes is kept; a null doc_id counts as larger than all others; rows that
    share a doc_id don't count as earlier than one another. A very long text is a batch of its own, held once with its
    hashes. An empty table gives an empty one.
    """
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*[c for c in extra if c not in (key, text)])
    keep = [c for c in docs.columns if texts or c != text]
    batches = stored(batched(docs if texts else docs.select(*keep, text), text, batch), "batches")
    buckets = max(16, batches.count() // 4)
    keys = batches.mapInArrow(anchor_keys(buckets, text, key), "bucket int, batch long, keys binary")
    answer = "batch long, bucket int, body binary"
    shared = stored(keys.groupBy("bucket").applyInArrow(shared_keys(hot), answer), "shared")
    by_batch = batches.groupBy("batch")
    stretches = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(stretch_rows(buckets, text, key), "bucket int, batch long, body binary")
    holders = stretches.groupBy("bucket").applyInArrow(earliest_holders, answer)
    told = stored(shared.unionByName(holders), "holders")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"])

    def made(batch: pa.Table, answers: pa.Table) -> pa.Table:
        table = opened(batch["body"][0].as_py())
        flat, bounds = flat_text(table, text)
        gone = removed_bytes(flat, bounds, doc_ids(table, key), answers, buckets)
        rows, kept = [], []
        for a, b, null in zip(bounds[:-1].tolist(), bounds[1:].tolist(), pc.is_null(table[text]).to_pylist(), strict=True):
            own = gone[a:b]
            rest = flat[a:b][~own].tobytes()
            rows.append((b - a, int(own.sum()), int(np.count_nonzero(np.diff(own.view(np.int8), prepend=0) == 1)), hashlib.sha256(rest).hexdigest()))
            kept.append(None if null else rest.decode(errors="ignore"))
        columns = {c: table[c] for c in keep}
        if texts:
            columns[text] = pa.array(kept, pa.string())
        for i, (c, kind) in enumerate(zip(extra, [pa.int64()] * 3 + [pa.string()], strict=True)):
            columns[c] = pa.array([r[i] for r in rows], kind)
        return pa.table(columns)

    return by_batch.cogroup(told.groupBy("batch")).applyInArrow(made, schema)
