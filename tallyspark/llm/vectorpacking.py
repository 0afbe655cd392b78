"""Vector bin packing by the dot-product heuristic.

An example is a prompt followed by ids that bear loss. A sequence is limited in three dimensions at once: tokens, segments
and loss-bearing tokens. One sequence is open at a time; of the examples that fit, the one whose demand has the largest
dot product with what is left of the sequence goes in, so a dimension that is still wide open draws examples that need it.
Examples of one size are interchangeable, so the product is taken once for each size that is there, with numpy.

Each task packs its own rows, from a pool of bounded size that is refilled as rows arrive: nothing is shuffled, no task
and no driver sees all rows, and a lost task packs the same rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import word_ids

#: Tokens that a task's pool holds before sequences are made, and characters that are tokenised together.
HELD, TOGETHER = 2_000_000, 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
KINDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. loss: None for as many as tokens."""

    tokens: int = 1024
    segments: int = 64
    loss: int | None = None

    @property
    def bearing(self) -> int:
        return self.tokens if self.loss is None else self.loss


@dataclass
class Piece:
    """Ids `start` to `start + length` of an example; the last `loss` of them bear loss."""

    doc_id: int | None
    ids: bytes
    start: int
    length: int
    loss: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        rest = min(self.loss, self.length - at)
        return Piece(self.doc_id, self.ids, self.start, at, self.loss - rest), Piece(self.doc_id, self.ids, self.start + at, self.length - at, rest)

    def fits(self, tokens: int, loss: int) -> int:
        """How many of its first ids fit."""
        return min(self.length, tokens, self.length - self.loss + loss)


@dataclass
class Pool:
    """Pieces by size. sizes: a row (tokens, 1, loss) for each size seen."""

    sizes: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: dict[tuple[int, int], int] = field(default_factory=dict)
    stacks: list[list[Piece]] = field(default_factory=list)
    tokens: int = 0

    def put(self, piece: Piece) -> None:
        size = piece.length, piece.loss
        k = self.place.setdefault(size, len(self.stacks))
        if k == len(self.stacks):
            self.stacks.append([])
            if k == len(self.count):
                room = max(64, 2 * k)
                self.sizes = np.concatenate([self.sizes, np.zeros((room - k, 3), np.int64)])
                self.count = np.concatenate([self.count, np.zeros(room - k, np.int64)])
            self.sizes[k] = size[0], 1, size[1]
        self.stacks[k].append(piece)
        self.count[k] += 1
        self.tokens += piece.length

    def take(self, k: int) -> Piece:
        self.count[k] -= 1
        piece = self.stacks[k].pop()
        self.tokens -= piece.length
        return piece


def next_sequence(pool: Pool, limits: Limits, cut: bool) -> list[Piece]:
    """Take the pieces of one sequence out of the pool.

    With `cut`, what fills a sequence up may be cut from a longer piece, and a sequence that can't be filled ends at a
    power of two, where it needs no padding; the rest goes back into the pool.
    """
    most = np.array([limits.tokens, limits.segments, limits.bearing], np.float64)
    there = pool.count > 0
    weight = pool.count @ pool.sizes / max(1, pool.count.sum()) / most**2  # mean demand, in shares of the limits
    left, inside = np.array([limits.tokens, limits.segments, limits.bearing]), []
    while left[0] and left[1]:
        product = pool.sizes @ (weight * left)
        fit = there & (pool.sizes <= left).all(axis=1)
        if fit.any():
            k = int(np.argmax(np.where(fit, product, -1.0)))
            piece = pool.take(k)
        else:
            part = np.where(there, np.minimum(left[0], pool.sizes[:, 0] - pool.sizes[:, 2] + left[2]), 0) if cut else np.zeros(1)
            if not part.any():
                break
            k = int(np.argmax(np.where(part == part.max(), product, -1.0)))  # of those that fill it, the one it would most like
            piece, rest = pool.take(k).split(int(part[k]))
            pool.put(rest)
            there = pool.count > 0
        if k < len(there):
            there[k] = pool.count[k] > 0
        inside.append(piece)
        left -= (piece.length, 1, piece.loss)
    total = limits.tokens - int(left[0])
    if cut and total & total - 1 and left[0]:
        surplus = total - (1 << total.bit_length() - 1)
        while surplus:
            last = inside.pop()
            if last.length > surplus:
                last, rest = last.split(last.length - surplus)
                inside.append(last)
                last = rest
            pool.put(last)
            surplus -= last.length
    return inside


def packed(examples: Iterator[tuple[int | None, bytes, int]], limits: Limits, cut: bool, held: int = HELD) -> Iterator[list[tuple[Piece, int, int]]]:
    """(piece, sequence, offset) of all examples (id, little-endian 32-bit ids, how many of the last ids bear loss)."""
    pool, number, out = Pool(), 0, []

    def close(inside: list[Piece]) -> None:
        nonlocal number
        at = 0
        for piece in inside:
            out.append((piece, number, at))
            at += piece.length
        number += 1

    for doc_id, ids, loss in examples:
        rest = Piece(doc_id, ids, 0, len(ids) // 4, loss)
        while rest.length > limits.tokens or rest.loss > limits.bearing:
            piece, rest = rest.split(rest.fits(limits.tokens, limits.bearing))
            if piece.length == limits.tokens:
                close([piece])
            else:
                pool.put(piece)
        pool.put(rest)
        if pool.tokens > held:
            while pool.tokens > held // 2:
                close(next_sequence(pool, limits, cut))
            kept = Pool()  # sizes that are used up go
            for stack in pool.stacks:
                for piece in stack:
                    kept.put(piece)
            pool = kept
        if len(out) > 5000:
            yield out
            out = []
    while pool.tokens:
        close(next_sequence(pool, limits, cut))
    yield out


def _rows(examples: Iterator[tuple[int | None, bytes, int]], limits: Limits, cut: bool) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 36
    for part in packed(examples, limits, cut):
        rows = [(p.doc_id, p.start, p.length, zlib.crc32(memoryview(p.ids)[4 * p.start : 4 * (p.start + p.length)]), len(p.ids) // 4, first + number, at) for p, number, at in part]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(KINDS)], [c for c, _ in KINDS])


def pack_examples(examples: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Examples (doc_id long, ids binary: little-endian unsigned 32-bit, loss long) in sequences.

    loss: how many of an example's last ids bear loss (null: all of them; held to 0 and the number of ids). Without `cut`
    only an example that no sequence can hold is cut. Null or empty ids hold no token and give no piece. Ties between
    sizes go to the size seen first; repeated rows are packed each for itself; other columns play no part; an empty table
    gives an empty table. A very long example is cut into full sequences as it is read.
    """
    if min(limits.tokens, limits.segments, limits.bearing) < 1:
        raise ValueError("every limit must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[int | None, bytes, int]]:
            for batch in batches:
                for key, ids, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if ids:
                        n = len(ids) // 4
                        yield key, ids, n if loss is None else max(0, min(n, loss))

        yield from _rows(read(), limits, cut)

    return examples.select(F.col("doc_id").cast("long"), "ids", F.col("loss").cast("long")).mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), hold: bool = True) -> DataFrame:
    """All documents in sequences: a text's ids by a `tokenizers` file and the end id 0, every id bearing loss.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece. Documents are cut where that fills
    a sequence up. A null or empty text is the end id alone; a null doc_id stays null. Very long texts are tokenised
    whole, and cut into full sequences but for their end. Ties, repeated rows, other columns and an empty table: as in
    `pack_examples`. With `hold`, a worker keeps the words that it knows for its next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(path)

        def encoded(keys: list, texts: list[str]) -> Iterator[tuple[int | None, bytes, int]]:
            for key, ids in zip(keys, tok.encode(texts), strict=True):
                yield key, ids + b"\0\0\0\0", len(ids) // 4 + 1

        def read() -> Iterator[tuple[int | None, bytes, int]]:
            for batch in batches:
                keys, texts, size = [], [], 0
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    keys.append(key)
                    texts.append(text.as_py() or "")
                    size += len(texts[-1])
                    if size > TOGETHER:
                        yield from encoded(keys, texts)
                        keys, texts, size = [], [], 0
                yield from encoded(keys, texts)

        try:
            yield from _rows(read(), limits, True)
        finally:
            if not hold:
                tok.known.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
