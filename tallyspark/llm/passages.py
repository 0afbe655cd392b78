"""Near-duplicate passages by compact windows.

The tokens of a document are its word shingles. Under a hash function, all stretches of tokens with the same smallest
token form one compact window: the longest stretch in which that token is the smallest, which is a node of the
sequence's Cartesian tree (equal tokens of a stretch share the node). Two alike stretches have the same smallest token
under most functions, and around it the same RUN tokens on one side at least, as an alike passage is broken about once
in 45 tokens. So a window has two keys: its value with the tokens left of it, and with those right of it.

Windows of a key are intervals of one class. Each is joined with the class's first holder, the document of smallest id:
what a pair of documents has in common in this way is put together along the sequence and compared token by token.
Members of a class that these passages do not join are held against one another, block by block inside tasks. So nothing
is lost to the choice of a first holder, and a passage in very many documents costs each of them one comparison.

Text travels in compressed batches, and windows as packed arrays by bucket of their values. A batch sends each key once
and is told the first holder; it finds the pairs of its own documents itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored
from .repeats import BATCH, batched, dealt, doc_ids, flat_text, opened
from .shingles import mix, shingles

#: Words of a passage at least, words of a shingle, hash functions, and tokens in a row around a common smallest one.
WORDS, SIZE, FUNCTIONS, RUN = 50, 5, 5, 10
#: Tokens by which the diagonal of a pair drifts within one edit or a few; a long passage may drift by a quarter of its length.
DRIFT = 64
#: Windows of a class that are compared inside one task; batches of a class that share one copy of a first holder.
BLOCK, SHARE = 512, 8
#: Runs of one token in a stretch, up to which all of its parts are looked at before it is walked.
RUNS = 256
_TURNS = np.random.default_rng(303).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: In an entry's place: two documents of the batch have the window, and there are several windows of it.
TWO, SEVERAL = np.uint32(1 << 31), np.uint32(1 << 30)
PLACE = np.uint32((1 << 30) - 1)


def compact_windows(tokens: np.ndarray, start: np.ndarray, width: int, function: int) -> tuple[np.ndarray, ...]:
    """(value, text, left, centre, last, right) of the windows of `width` tokens at least; places count from the text's start.

    centre and last are the first and the last place of the smallest token, right is inclusive.
    """
    hashed = mix(tokens * _TURNS[function])
    bits = max(24, len(hashed).bit_length())
    place = np.arange(len(hashed), dtype=np.uint64)
    low = np.uint64((1 << bits) - 1)
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    first, last = start[:-1][text], start[1:][text]
    longest_text = int(np.diff(start).max(initial=0))
    if longest_text < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    tables = [(hashed & ~low) | place]  # tables[j][i]: the least of the 2**j from place i
    while 1 << len(tables) <= longest_text:
        step = 1 << len(tables) - 1
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    top = width.bit_length() - 1
    best = np.minimum(tables[top][: len(hashed) - width + 1], tables[top][width - (1 << top) :][: len(hashed) - width + 1])
    whole = last[: len(best)] >= np.arange(len(best)) + width
    centre = (best[whole] & low).astype(np.int64)  # never falls from a stretch to the next
    centre = centre[np.diff(centre, prepend=-1) != 0]
    value = tables[0][centre]
    left, right = centre.copy(), centre + 1
    for j in range(len(tables) - 1, -1, -1):
        step = 1 << j
        for _ in range(2 if j == len(tables) - 1 else 1):
            at = left - step
            fits = at >= first[centre]
            fits[fits] = tables[j][at[fits]] > value[fits]
            left[fits] -= step
            fits = right + step <= last[centre]
            fits[fits] = tables[j][right[fits]] > value[fits]
            right[fits] += step
    again = (left > first[centre]) & (tokens[left - 1] == tokens[centre])  # within the window of the same token before it
    end = centre
    if again.any():
        order = np.lexsort((centre, tokens[centre], right))
        new = np.ones(len(order), bool)
        new[1:] = (right[order][1:] != right[order][:-1]) | (tokens[centre[order]][1:] != tokens[centre[order]][:-1])
        end = np.empty_like(centre)
        end[order] = np.maximum.reduceat(centre[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    centre, left, right, end = (x[~again] for x in (centre, left, right, end))
    base = first[centre]
    return mix(hashed[centre] + np.uint64(function)), text[centre], left - base, centre - base, end - base, right - 1 - base


class Nodes(NamedTuple):
    """The windows of a batch: value, prints of the tokens left and right (0: too few), id, nth text of the id, text, places."""

    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    nth: np.ndarray
    text: np.ndarray
    low: np.ndarray
    place: np.ndarray
    end: np.ndarray
    high: np.ndarray


class Texts:
    """A batch's tokens: ids of its texts, the nth text of an id each is, 32-bit tokens and where each text's start."""

    def __init__(self, body: bytes, text: str, key: str, size: int):
        table = opened(body)
        flat, bounds = flat_text(table, text)
        self.ids = doc_ids(table, key)
        order = np.argsort(self.ids, kind="stable")
        new = np.flatnonzero(np.diff(self.ids[order], prepend=~self.ids[order][:1]))
        self.nth = np.empty(len(order), np.int64)
        self.nth[order] = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        self.parts: list[tuple[int, list[bytes], np.ndarray, np.ndarray]] = []  # a megabyte of text at a time
        counts, begin, base = [np.zeros(1, np.int64)], 0, 0
        while begin < len(self.ids):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + 1_000_000, "right")) - 1)
            texts = [flat[a:b].tobytes() for a, b in zip(bounds[begin:end], bounds[begin + 1 : end + 1], strict=True)]
            tokens, start = shingles(texts, size)
            self.parts.append((begin, texts, tokens, start))
            counts.append(start[1:] + base)
            base += len(tokens)
            begin = end
        self.tokens = np.concatenate([x[2].astype(np.uint32) for x in self.parts]) if self.parts else np.zeros(0, np.uint32)
        self.start = np.concatenate(counts)


class Windows(Texts):
    """A batch's tokens, its windows, and its entries: what it tells the buckets, each (value, prints) once."""

    def __init__(self, body: bytes, text: str, key: str, size: int, width: int, buckets: int):
        super().__init__(body, text, key, size)
        parts = []
        for begin, texts, tokens, start in self.parts:
            sums = np.zeros(len(tokens) + 1, np.uint64)
            np.cumsum(mix(tokens), out=sums[1:])
            for f in range(FUNCTIONS):
                value, of, left, centre, end_, right = compact_windows(tokens, start, width, f)
                at, first, last = start[:-1][of] + centre, start[:-1][of], start[1:][of]
                sides = []
                for a, b, there in ((at - RUN, at, at - RUN >= first), (at + 1, at + 1 + RUN, at + 1 + RUN <= last)):
                    print_ = mix(sums[np.where(there, b, 0)] - sums[np.where(there, a, 0)]) >> np.uint64(48)
                    sides.append(np.where(there, np.maximum(print_, np.uint64(1)), np.uint64(0)).astype(np.uint16))
                parts.append((value.astype(np.uint64), *sides, of + begin, left, centre, end_, right))
            whole = np.flatnonzero(np.diff(start) >= width)  # a text as a whole is one more window, with two parts of a digest
            digest = np.array([np.frombuffer(hashlib.sha256(texts[i]).digest()[:16], np.uint64) for i in whole.tolist()], np.uint64).reshape(-1, 2)
            prints = (digest[:, 1:] & np.uint64(0xFFFFFFFF)).view(np.uint16).reshape(-1, 4)[:, :2] | np.uint16(1)
            parts.append((digest[:, 0], prints[:, 0], prints[:, 1], whole + begin, np.zeros(len(whole), np.int64), np.full(len(whole), int(PLACE)), np.full(len(whole), int(PLACE)), np.diff(start)[whole] - 1))
        value, left, right, of, low, place, last, high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.uint16)] * 2, *[np.zeros(0, np.int64)] * 5)
        bucket = ((value >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((place, self.nth[of], self.ids[of], right, left, value, bucket))
        value, left, right, of, low, place, last, high, bucket = (x[order] for x in (value, left, right, of, low, place, last, high, bucket))
        self.nodes = Nodes(value, left, right, self.ids[of], self.nth[of], of, low, place, last, high)
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        self.entry_of = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.bucket = bucket[self.first]
        if len(value):
            many = np.diff(np.append(self.first, len(value)))
            self.flags = np.where(many > 1, SEVERAL, np.uint32(0)) | np.where(np.maximum.reduceat(self.nodes.doc, self.first) > self.nodes.doc[self.first], TWO, np.uint32(0))
        else:
            self.flags = np.zeros(0, np.uint32)

    def entries(self, part: slice) -> bytes:
        n, at = self.nodes, self.first[part]
        return joined((n.value[at].astype(np.uint32), n.left[at], n.right[at], n.doc[at], n.nth[at].astype(np.uint16), n.place[at].astype(np.uint32) | self.flags[part]))


ENTRY = (np.uint32, np.uint16, np.uint16, np.int64, np.uint16, np.uint32)
#: An entry's number, then for the left and the right key: the first holder's batch (-1: none), id, nth text and place, how
#: many copies of it there are, and whether the class has more members than that pair.
TOLD = (np.uint32, *(np.int64, np.int64, np.uint16, np.uint32, np.uint16, np.uint8) * 2)


def joined(columns: tuple[np.ndarray, ...]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(columns[0])).tobytes() + b"".join(x.tobytes() for x in columns))


def parted(body: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def window_keys(buckets: int, text: str, key: str, size: int, width: int):
    """Batches to (bucket, batch, body): their entries."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                w = Windows(body, text, key, size, width, buckets)
                out = [(b, w.entries(part)) for b, part in dealt(w.bucket)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "batch", "body"])
            w = out = None
            released()

    return made


def first_holders(table: pa.Table) -> pa.Table:
    """A bucket's entries to (batch, bucket, body): of each entry that another document has too, the first holders."""
    numbers = table["batch"].to_numpy()
    parts = [parted(x, ENTRY) for x in table["body"].to_pylist()]
    counts = np.array([len(x[0]) for x in parts])
    value, left, right, doc, nth, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    batch = np.repeat(numbers, counts)
    base = np.cumsum(counts) - counts
    number = np.arange(len(value)) - np.repeat(base, counts)
    by_doc = np.lexsort((place & PLACE, nth, batch, doc))
    answers, known = [], np.zeros(len(value), bool)
    for side in (left, right):
        key = (value.astype(np.uint64) << np.uint64(16)) | side
        order = by_doc[side[by_doc] > 0]
        order = order[np.argsort(key[order], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(order)))
        holder, n = np.full(len(value), -1), np.zeros(len(value), np.int64)
        more = np.zeros(len(value), bool)
        if len(start):
            flags = np.bitwise_or.reduceat(place[order], start)
            shared = (np.maximum.reduceat(doc[order], start) > doc[order[start]]) | (flags & TWO > 0)
            of = np.repeat(np.arange(len(start)), many)
            kept = shared[of]
            holder[order[kept]] = order[start][of[kept]]
            n[order] = many[of]
            more[order] = ((many > 2) | (flags & (SEVERAL | TWO) > 0))[of]
        there = holder >= 0
        known |= there
        answers.append((np.where(there, batch[holder], -1), np.where(there, doc[holder], 0), np.where(there, nth[holder], 0).astype(np.uint16), np.where(there, place[holder] & PLACE, 0).astype(np.uint32), np.minimum(1 + n // SHARE, 60_000).astype(np.uint16), more.astype(np.uint8)))
    out = []
    for k, b, n in zip(numbers.tolist(), base.tolist(), counts.tolist(), strict=True):
        own = b + np.flatnonzero(known[b : b + n])
        if len(own):
            out.append((k, joined((number[own].astype(np.uint32), *(x[own] for side in answers for x in side)))))
    return pa.table({"batch": pa.array([k for k, _ in out], pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(out), pa.int32()), "body": pa.array([x for _, x in out], pa.binary())})


#: Rows that a batch gives: stretches of its texts to be compared with a first holder's ("pair"), stretches that it holds
#: first ("held"), windows of classes with further members ("class") and texts that an earlier document has ("copy").
FOUND = "kind string, doc long, batch long, nth int, a long, b long, tokens binary, other long, other_batch long, other_nth int, x long, y long, salt int, value long"
FOUND_SCHEMA = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in FOUND.split(", "))])


def stretches(owner: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray, gap: int, more: np.ndarray | None = None, more_gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows by owner and place, and where in it a new stretch starts: another owner, or too far from the last."""
    order = np.lexsort((low, *owner[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = low[order][1:] > np.maximum(high[order][:-1], 0) + gap
    if more is not None:
        new[1:] |= np.abs(np.diff(more[order])) > more_gap
    for x in owner:
        new[1:] |= x[order][1:] != x[order][:-1]
    return order, np.flatnonzero(new)


def batch_pairs(buckets: int, text: str, key: str, size: int, width: int):
    """A batch and the first holders told to it, to rows of FOUND."""
    reach = 2 * width

    def made(batch: pa.Table, answers: pa.Table) -> pa.Table:
        if not batch.num_rows or not answers.num_rows:
            return FOUND_SCHEMA.empty_table()
        me = batch["batch"][0].as_py()
        w = Windows(batch["body"][0].as_py(), text, key, size, width, buckets)
        n = w.nodes
        began = {b: part.start for b, part in dealt(w.bucket)}
        told = [parted(x, TOLD) for x in answers["body"].to_pylist()]
        entry = np.concatenate([t[0].astype(np.int64) + began[b] for b, t in zip(answers["bucket"].to_pylist(), told, strict=True)])
        columns = [np.concatenate(x) for x in zip(*(t[1:] for t in told), strict=True)]
        at = np.full(len(w.first), -1)
        at[entry] = np.arange(len(entry))
        row = at[w.entry_of]
        known = np.flatnonzero(row >= 0)
        row = row[known]
        whole = n.place[known] == int(PLACE)
        sides = [[x[row].astype(np.int64) for x in columns[6 * s : 6 * s + 6]] for s in (0, 1)]
        same = (sides[0][0] >= 0) & np.logical_and.reduce([sides[0][i] == sides[1][i] for i in range(4)])
        mine = lambda s: (sides[s][0] == me) & (sides[s][1] == n.doc[known]) & (sides[s][2] == n.nth[known])
        rows: dict[str, list] = {name: [] for name in FOUND_SCHEMA.names}

        def put(**values) -> None:
            many = len(values["doc"])
            for name in rows:
                rows[name].append(pa.array(values[name], FOUND_SCHEMA.field(name).type) if name in values else pa.nulls(many, FOUND_SCHEMA.field(name).type))

        # whole texts of an earlier document, which need nothing else
        copy = whole & same & ~mine(0) & (n.doc[known] > sides[0][1])
        again = whole & same & ~mine(0)
        k = known[copy]
        put(kind=["copy"] * len(k), doc=n.doc[k], batch=np.full(len(k), me), nth=n.nth[k], a=n.low[k], b=n.high[k] + 1, other=sides[0][1][copy])
        is_copy = np.zeros(len(w.ids), bool)
        is_copy[n.text[known[again]]] = True
        live = ~whole & ~is_copy[n.text[known]]

        ask, hold = [], []
        for s in (0, 1):
            there = live & (sides[s][0] >= 0)
            own = mine(s) & (n.place[known] == sides[s][3])
            hold.append(np.flatnonzero(there & own))
            ask.append(np.flatnonzero(there & (sides[s][1] != n.doc[known]) & (~same if s else True)))
            more = there & (sides[s][5] > 0)
            k = known[more]
            print_ = (n.left if s == 0 else n.right)[k].astype(np.uint64)
            put(kind=["class"] * len(k), doc=n.doc[k], batch=np.full(len(k), me), nth=n.nth[k], a=n.place[k], other=sides[s][1][more], salt=(mine(s) & (n.place[known] == sides[s][3]))[more].astype(np.int32), value=mix(n.value[k] + (print_ * np.uint64(2) + np.uint64(s) << np.uint64(20))).view(np.int64))

        i = np.concatenate(ask)
        s = np.repeat([0, 1], [len(x) for x in ask])
        batch_, other, nth, place, many = (np.where(s == 0, sides[0][c][i], sides[1][c][i]) for c in range(5))
        k = known[i]
        c = n.place[k]
        low, high = np.maximum(n.low[k], c - reach), np.minimum(n.high[k], n.end[k] + reach) + 1
        spare = (high - low) // 4  # what the other side may have more of
        x, y = np.maximum(place - (c - low) - spare, 0), place + (high - c) + spare
        order, start = stretches((n.text[k], batch_, other, nth), c, n.end[k], reach, place, 2 * reach)
        if len(order):
            a, b = np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start)
            x, y = np.minimum.reduceat(x[order], start), np.maximum.reduceat(y[order], start)
            of, few = order[start], np.minimum.reduceat(many[order], start)
            fits = b - a >= width
            a, b, x, y, of, few = a[fits], b[fits], x[fits], y[fits], of[fits], few[fits]
            k = k[of]
            first = w.start[n.text[k]]
            salt = mix((n.text[k] + me * 65_536).astype(np.uint64)) % few.astype(np.uint64)
            put(kind=["pair"] * len(k), doc=n.doc[k], batch=np.full(len(k), me), nth=n.nth[k], a=a, b=b, tokens=[w.tokens[p:q].tobytes() for p, q in zip(first + a, first + b, strict=True)], other=other[of], other_batch=batch_[of], other_nth=nth[of], x=x, y=y, salt=salt.astype(np.int32))

        i = np.concatenate(hold)
        many = np.concatenate([sides[s][4][hold[s]] for s in (0, 1)])
        k = known[i]
        c, size_of = n.place[k], np.diff(w.start)[n.text[k]]
        low, high = np.maximum(c - reach, 0), np.minimum(n.end[k] + reach + 1, size_of)
        order, start = stretches((n.text[k],), low, high, 0)
        if len(order):
            a, b = low[order][start], np.maximum.reduceat(high[order], start)
            most = np.maximum.reduceat(many[order], start)
            k = k[order[start]]
            first = w.start[n.text[k]]
            put(kind=["held"] * len(k), doc=n.doc[k], batch=np.full(len(k), me), nth=n.nth[k], a=a, b=b, tokens=[w.tokens[p:q].tobytes() for p, q in zip(first + a, first + b, strict=True)], salt=most)
        del w, n, columns, sides, told
        released()
        return pa.table([pa.chunked_array(x, FOUND_SCHEMA.field(name).type) for name, x in rows.items()], schema=FOUND_SCHEMA)

    return made


def longest(hit: np.ndarray, lost: int) -> tuple[int, int]:
    """The longest stretch in which hits are at least `lost` times as many as misses."""
    sums = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(np.where(hit, 1, -lost), out=sums[1:])
    begin = np.searchsorted(-np.minimum.accumulate(sums), -sums)  # the first place whose sum is no larger
    end = int((np.arange(len(sums)) - begin).argmax())
    return int(begin[end]), end


def covered(hit: np.ndarray, lost: int) -> np.ndarray:
    """The places that lie in some stretch in which hits are at least `lost` times as many as misses."""
    sums = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(np.where(hit, 1, -lost), out=sums[1:])
    return np.maximum.accumulate(sums[:0:-1])[::-1] >= np.minimum.accumulate(sums[:-1])


def core(tokens: int, percent: int) -> int:
    """Tokens from the first to the last common one of two passages of `tokens` at least: both may end in others."""
    return -(-2 * percent * tokens // (100 + percent))


def filled(first: int, last: int, tokens: int, size: int) -> tuple[int, int]:
    """A stretch brought to `tokens` inside a text of `size`: as far as it goes to the right, then to the left."""
    last = min(size, max(last, first + tokens))
    return max(0, min(first, last - tokens)), last


def alike(mine: np.ndarray, theirs: np.ndarray, tokens: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, their start, their end, similarity) of passages of `tokens` tokens at least; ends are exclusive.

    With a share p of their union in common, two passages have p of each side's tokens in common at least, and of the
    shorter one's 2 p / (1 + p); the longest stretches of such shares along a diagonal are the candidates. Where one side
    gives none, the other is walked.
    """
    found = in_step(mine, theirs, tokens, percent)
    if found is not None:
        return found
    if not (may_hold(mine, theirs, tokens, percent) and may_hold(theirs, mine, tokens, percent)):
        return []
    found = walked(mine, theirs, tokens, percent)
    return found or [(x, y, a, b, j) for a, b, x, y, j in walked(theirs, mine, tokens, percent)]


def may_hold(mine: np.ndarray, theirs: np.ndarray, tokens: int, percent: int) -> bool:
    """Whether different tokens of some stretch of `mine` have the share in common with `theirs`, which any passage needs.

    A run of one token counts once, however long it is. True as well where there are too many runs to tell in short time.
    """
    new = np.ones(len(mine), bool)
    new[1:] = mine[1:] != mine[:-1]
    begin = np.flatnonzero(new)
    n = len(begin)
    if n > RUNS:
        return True
    if min(len(mine), len(theirs)) < tokens:
        return False
    token, end, at = mine[begin], np.append(begin[1:], len(mine)), np.arange(n)
    order = np.argsort(token, kind="stable")
    again = np.flatnonzero(token[order[1:]] == token[order[:-1]])
    before = np.full(n, -1)
    before[order[again + 1]] = order[again]
    every = np.sort(theirs)
    hit = every[np.minimum(np.searchsorted(every, token), len(every) - 1)] == token
    weight = np.where(hit, 1, -(percent // max(1, 100 - percent))).astype(np.int32)
    first = at[:, None]
    sums = np.cumsum(np.where((before < first) & (at >= first), weight, 0), axis=1, dtype=np.int32)
    return bool(((sums >= 0) & (end - begin[:, None] >= tokens)).any())


def in_step(mine: np.ndarray, theirs: np.ndarray, tokens: int, percent: int) -> list[tuple[int, int, int, int, float]] | None:
    """The passages of `alike`, where no token repeats and common ones have one order on both sides; None elsewhere.

    A stretch between two common tokens then has the share if its common tokens outweigh those of either side that are not.
    """
    least, lost = core(tokens, percent), percent // max(1, 100 - percent)
    if min(len(mine), len(theirs)) < tokens:
        return []
    for side in (mine, theirs):
        every = np.sort(side)
        if (every[1:] == every[:-1]).any():
            return None
    common, run, place = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
    if len(common) < least:
        return []
    order = np.argsort(run)
    run, place = run[order], place[order]
    if (np.diff(place) < 0).any():
        return None
    weight = (2 * lost + 1) * np.arange(len(run)) - lost * (run + place)
    out: list[tuple[int, int, int, int, float]] = []
    spans = [(0, len(run))]
    while spans:
        p, q = spans.pop()
        if q - p < least:
            continue
        begin = np.searchsorted(-np.minimum.accumulate(weight[p:q]), -weight[p:q] - 1)
        end = int((np.arange(q - p) - begin).argmax())
        first, last = p + int(begin[end]), p + end
        if last + 1 - first < least:
            continue
        a, b = filled(int(run[first]), int(run[last]) + 1, tokens, len(mine))
        x, y = filled(int(place[first]), int(place[last]) + 1, tokens, len(theirs))
        both = int(((run >= a) & (run < b) & (place >= x) & (place < y)).sum())
        union = b - a + y - x - both
        if 100 * both < percent * union:
            return None
        out.append((a, b, x, y, both / union))
        spans += [(p, first), (last + 1, q)]
    return out


def walked(mine: np.ndarray, theirs: np.ndarray, tokens: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """The passages of `alike` that a walk along `mine` finds.

    A walk is parted where no stretch has the share that a passage needs, whatever the length of the break. What is
    shorter than a passage from its first to its last common token is filled up with the tokens beside it.
    """
    least = core(tokens, percent)
    out: list[tuple[int, int, int, int, float]] = []
    if min(len(mine), len(theirs)) < tokens:
        return out
    shares = (percent // max(1, 100 - percent), 2 * percent // max(1, 100 - percent))
    every, rank, times = np.unique(theirs, return_inverse=True, return_counts=True)
    own = np.minimum(np.searchsorted(every, mine), len(every) - 1)
    hit = every[own] == mine
    first, last = longest(hit, shares[0])
    if last - first < least:
        return out
    dense = covered(hit, shares[0])
    shared = np.flatnonzero(hit & dense)
    where = np.sort(rank * len(theirs) + np.arange(len(theirs)))  # by token, then by place
    before = np.cumsum(times) - times
    runs = np.split(shared, np.flatnonzero(np.diff(np.cumsum(~dense)[shared])) + 1)

    def stretch(run: np.ndarray, place: np.ndarray) -> tuple | None:
        """The longest stretch of a run that is a passage: where it is in the run, and the passage."""
        flags = np.zeros(run[-1] + 1 - run[0], bool)
        flags[run - run[0]] = True
        tried = [np.searchsorted(run, run[0] + np.array(longest(flags, lost))) for lost in shares]
        both = (2 * shares[0] + 1) * np.arange(len(run)) - shares[0] * (run + place)  # misses of both sides together
        begin = np.searchsorted(-np.minimum.accumulate(both), -both - 1)
        end = int((np.arange(len(run)) - begin).argmax())
        for p, q in [*tried, (int(begin[end]), end + 1)]:
            if q - p < 2:
                continue
            a, b = int(run[p]), int(run[q - 1]) + 1
            x, y = int(place[p:q].min()), int(place[p:q].max()) + 1
            if min(b - a, y - x) < least:
                continue
            (a, b), (x, y) = filled(a, b, tokens, len(mine)), filled(x, y, tokens, len(theirs))
            left, right = np.unique(mine[a:b]), np.unique(theirs[x:y])
            both = len(np.intersect1d(left, right, assume_unique=True))
            union = len(left) + len(right) - both
            if 100 * both >= percent * union:
                return p, q, (a, b, x, y, both / union)
        return None

    while runs:
        run = runs.pop()
        if not len(run) or run[-1] + 1 - run[0] < least:
            continue
        flags = np.zeros(run[-1] + 1 - run[0], bool)
        flags[run - run[0]] = True
        first, last = longest(flags, shares[0])
        if last - first < least:
            continue
        # of the places of a token, the nearest to the diagonal of those that stand once, or else of the first
        token = own[run]
        place = where[before[token]] % len(theirs)
        once = times[token] == 1
        usual = np.sort((place - run)[once])[int(once.sum()) // 2] if once.any() else place[0] - run[0]
        if not once.all():
            key = token * len(theirs) + np.clip(run + usual, 0, len(theirs) - 1)
            up = np.clip(np.searchsorted(where, key), before[token], before[token] + times[token] - 1)
            down = np.maximum(up - 1, before[token])
            place = np.where(np.abs(where[up] - key) <= np.abs(where[down] - key), where[up], where[down]) % len(theirs)
        shift = place - run
        drift = np.abs(shift - np.sort(shift)[len(shift) // 2])
        along = drift <= DRIFT
        if not along.all():
            # a long passage may drift further: as a whole if it is one, else in parts
            wide = drift <= max(DRIFT, len(flags) // 4)
            got = stretch(run[wide], place[wide]) if wide.sum() > along.sum() else None
            if got is None:  # tokens that stand elsewhere there are a passage of their own, or none
                runs += [run[along], run[~along]]
                continue
            runs += [run[~wide], run[wide][: got[0]], run[wide][got[1] :]]
            out.append(got[2])
            continue
        got = stretch(run, place)
        if got is not None:
            out.append(got[2])
            runs += [run[: got[0]], run[got[1] :]]
        elif not flags.all():
            runs += np.split(run, [int(np.diff(run).argmax()) + 1])  # on either side of its widest break
    return out


PASSAGE = "doc long, batch long, nth int, a long, b long, other long, other_batch long, other_nth int, x long, y long, similarity double"
PASSAGE_SCHEMA = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]) for name, kind in (x.split() for x in PASSAGE.split(", "))])


def passage_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(PASSAGE_SCHEMA)], schema=PASSAGE_SCHEMA)


def compared(width: int, percent: int):
    """Joined stretches to the passages that they have in common."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            columns = [part.column(i).to_pylist() for i in range(13)]
            for doc, batch, nth, a, tokens, other, other_batch, other_nth, x, y, their_a, theirs, _ in zip(*columns, strict=True):
                mine, their = np.frombuffer(tokens, np.uint32), np.frombuffer(theirs, np.uint32)[x - their_a : y - their_a]
                out += [(doc, batch, nth, a + s, a + e, other, other_batch, other_nth, x + t, x + u, round(j, 6)) for s, e, t, u, j in alike(mine, their, width, percent)]
            yield from passage_table(out).to_batches()

    return made


def reaches(hit: np.ndarray, place: np.ndarray, width: int, lost: int) -> np.ndarray:
    """For each row of flags, whether a stretch of `width` or more around its place, which starts and ends with a hit, has
    `lost` times as many hits as misses."""
    sums = np.zeros((hit.shape[0], hit.shape[1] + 1), np.int32)
    np.cumsum(np.where(hit, 1, -lost), axis=1, out=sums[:, 1:])
    ends = np.where(hit, sums[:, 1:], -(1 << 30))
    best = np.maximum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]  # of all ends from a column on
    start = np.arange(hit.shape[1] - width + 1)[None, :]
    later = best[np.arange(len(best))[:, None], np.maximum(place[:, None], start + width - 1)]
    return (hit[:, : start.shape[1]] & (start <= place[:, None]) & (later >= sums[:, : start.shape[1]])).any(axis=1)


def joined_roots(doc: np.ndarray, linked: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """A number for each member of a class, equal where passages found so far join them: a linked one has one with document lab."""
    ids, own = np.unique(np.concatenate([doc[linked], lab[linked]]), return_inverse=True)
    group = np.arange(len(ids))
    mine, theirs = own[: len(own) // 2], own[len(own) // 2 :]
    for x, y in {*zip(mine.tolist(), theirs.tolist(), strict=True)}:
        if group[x] != group[y]:
            group[group == group[x]] = group[y]
    root = len(ids) + np.arange(len(doc))
    root[linked] = group[mine]
    return root


def class_passages(width: int, percent: int):
    """Members of classes (value, asks, linked, lab, own, i, j, doc, batch, nth, c, a, tokens) to passages that join them.

    Each that asks is held against every member that no passage joins with it yet. Only members are compared whose tokens
    around the place could be such passages by their shares (see alike). Of two blocks, members of different ones meet.
    """
    some, most = percent // max(1, 100 - percent), 2 * percent // max(1, 100 - percent)
    within = core(width, percent)
    least = -(-some * within // (some + 1))  # hits of a stretch at least

    def made(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        table = table.combine_chunks()
        value, asks, linked, lab, own, doc, batch, nth, c, a = (table[n].to_numpy() for n in ("value", "asks", "linked", "lab", "own", "doc", "batch", "nth", "c", "a"))
        across = table.num_rows > 0 and table["i"][0].as_py() != table["j"][0].as_py()
        tokens = [np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()]
        order = np.lexsort((c, nth, batch, doc, value))

        def passage(i: int, j: int) -> list[tuple]:
            return [(doc[i], batch[i], nth[i], a[i] + s, a[i] + e, doc[j], batch[j], nth[j], a[j] + t, a[j] + u, round(sim, 6)) for s, e, t, u, sim in alike(tokens[i], tokens[j], width, percent) if a[i] + s <= c[i] < a[i] + e or a[j] + t <= c[j] < a[j] + u]

        for rows in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            mine = np.flatnonzero(asks[rows])
            if not len(mine) or (doc[rows] == doc[rows[0]]).all():
                continue
            root = joined_roots(doc[rows], linked[rows], lab[rows])
            if (root == root[0]).all():
                continue
            n = np.array([len(tokens[i]) for i in rows])
            row = np.repeat(np.arange(len(rows)), n)
            _, column, times = np.unique(np.concatenate([tokens[i] for i in rows]), return_inverse=True, return_counts=True)
            column = np.where(times[column] > 1, np.cumsum(times > 1)[column], 0)  # 0: stands nowhere else
            held = np.zeros((int((times > 1).sum()) + 1, len(rows)), bool)
            held[column, row] = True
            held[0] = False
            at = np.zeros((len(rows), max(int(n.max()), width)), np.int64)
            at[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = column
            place = c[rows] - a[rows]
            other_asks = asks[rows]
            for k in mine.tolist():
                i = rows[k]
                apart = (root != root[k]) & (doc[rows] != doc[i])
                apart[:k] &= ~other_asks[:k]  # those have asked
                if across:
                    apart &= own[rows] != own[i]
                hits = held[at[k]]
                other = np.flatnonzero(apart & (hits.sum(axis=0, dtype=np.uint16) >= least))
                if not len(other):
                    continue
                forth = hits[:, other].T
                fits = reaches(forth, np.full(len(other), place[k]), within, some)
                if not fits.any():
                    continue
                other, forth = other[fits], forth[fits]
                back = held[at[other], k]
                fits = reaches(back, place[other], within, some)
                if not fits.any():
                    continue
                other, forth, back = other[fits], forth[fits], back[fits]
                fits = reaches(forth, np.full(len(other), place[k]), within, most) | reaches(back, place[other], within, most)
                for j in other[fits].tolist():
                    if root[j] != root[k]:
                        found = passage(i, rows[j])
                        if found:
                            out += found
                            root[root == root[j]] = root[k]
        if table.num_rows > BLOCK:
            released()
        return passage_table(out)

    return made


def tokens_around(text: str, key: str, size: int, width: int):
    """A batch and places in its texts, to the tokens around them: doc, batch, nth, c, a, tokens."""

    def made(batch: pa.Table, places: pa.Table) -> pa.Table:
        columns: list = [[] for _ in range(4)]
        tokens: list[bytes] = []
        me = batch["batch"][0].as_py() if batch.num_rows else 0
        if batch.num_rows and places.num_rows:
            t = Texts(batch["body"][0].as_py(), text, key, size)
            doc, nth, c = (places[n].to_numpy() for n in ("doc", "nth", "c"))
            by_id = np.lexsort((t.nth, t.ids))
            at = np.searchsorted(t.ids[by_id], doc) + nth  # an id's texts stand together, numbered from 0
            first, last = t.start[by_id[at]], t.start[by_id[at] + 1]
            low, high = np.maximum(first, first + c - 2 * width), np.minimum(last, first + c + 2 * width + 1)
            columns = [doc, nth, c, low - first]
            tokens = [t.tokens[a:b].tobytes() for a, b in zip(low, high, strict=True)]
            del t
            released()
        kinds = {"doc": pa.int64(), "nth": pa.int32(), "c": pa.int64(), "a": pa.int64()}
        out = {name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), columns, strict=True)} | {"tokens": pa.array(tokens, pa.binary())}
        out["batch"] = pa.array([me] * len(tokens), pa.int64())
        return pa.table({name: out[name] for name in ("doc", "batch", "nth", "c", "a", "tokens")})

    return made


def near_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, size: int = SIZE, percent: int = 80, batch: int = BATCH) -> DataFrame:
    """Passages of `words` words or more that also stand, alike, in a document with a smaller id.

    doc_id, start_word, n_words, other_id, other_start, other_words, similarity (of the sets of `size`-word shingles, as
    32-bit hashes; `percent` / 100 or more). The other document is the first holder of a window there, or, where that is
    not alike, each that no passage there joins with it yet; so alike documents stand in one class, without all pairs
    being listed. A text
    that an earlier document has too, byte by byte (told by a digest), gives one row over all its words. Texts that are
    null or shorter than a passage, and rows without an id, take no part. Rows that repeat an id with different texts are
    parts of one document, not compared with one another; start_word counts within the row's text. Other columns are
    ignored; an empty table gives an empty one. A very long text is a batch of its own. Of holders of one smallest id, the
    least place counts first.
    """
    width = words - size + 1
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    batches = stored(batched(rows, "text", batch), "batches")
    buckets = max(64, batches.count() // 32)
    keys = batches.mapInArrow(window_keys(buckets, "text", "doc", size, width), "bucket int, batch long, body binary")
    told = keys.groupBy("bucket").applyInArrow(first_holders, "batch long, bucket int, body binary")
    found = stored(batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(batch_pairs(buckets, "text", "doc", size, width), FOUND), "found")

    # stretches beside those of their first holders, of which there are as many copies as a class of many batches needs
    pairs = found.where("kind = 'pair'").select("doc", "batch", "nth", "a", "tokens", "other", "other_batch", "other_nth", "x", "y", "salt")
    held = found.where("kind = 'held'").select(F.col("doc").alias("h_doc"), F.col("batch").alias("h_batch"), F.col("nth").alias("h_nth"), F.col("a").alias("h_a"), F.col("b").alias("h_b"), F.col("tokens").alias("theirs"), F.explode(F.sequence(F.lit(0), F.col("salt") - 1)).alias("h_salt"))
    meets = (F.col("other_batch") == F.col("h_batch")) & (F.col("other") == F.col("h_doc")) & (F.col("other_nth") == F.col("h_nth")) & (F.col("salt") == F.col("h_salt")) & (F.col("x") < F.col("h_b")) & (F.col("y") > F.col("h_a"))
    beside = pairs.hint("merge").join(held, meets).select("doc", "batch", "nth", "a", "tokens", "other", "other_batch", "other_nth", F.greatest("x", "h_a").alias("x"), "y", "h_a", "theirs", "salt")
    passages = stored(beside.mapInArrow(compared(width, percent), PASSAGE), "passages")

    # a window's passages with other documents: its first holder counts, or else the smallest; where one holds, a stretch
    # of every START tokens stands for all that start there, as they overlap
    start = max(1, width // 2)
    here = passages.select(F.col("doc").alias("p_doc"), F.col("batch").alias("p_batch"), F.col("nth").alias("p_nth"), F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("other").alias("p_lab"))
    there = passages.groupBy(F.col("other").alias("p_doc"), F.col("other_batch").alias("p_batch"), F.col("other_nth").alias("p_nth"), F.floor(F.col("x") / start).alias("at")).agg(F.min("x").alias("p_a"), F.max("y").alias("p_b")).drop("at").withColumn("p_lab", F.col("p_doc"))
    classes = found.where("kind = 'class'").select("value", "doc", "batch", "nth", F.col("a").alias("c"), F.col("other").alias("first"), (F.col("salt") == 1).alias("is_first"))
    within = (F.col("doc") == F.col("p_doc")) & (F.col("batch") == F.col("p_batch")) & (F.col("nth") == F.col("p_nth")) & (F.col("c") >= F.col("p_a")) & (F.col("c") < F.col("p_b"))
    lab = F.when(F.max(F.col("is_first") | F.coalesce(F.col("p_lab") == F.col("first"), F.lit(False))), F.min("first")).otherwise(F.min("p_lab"))
    labelled = stored(classes.join(here.unionByName(there).hint("merge"), within, "left").groupBy("doc", "batch", "nth", "c", "value").agg(lab.alias("lab")), "labelled")
    # classes that passages do not join into one; the most frequent group of such a class is asked, and the others ask
    parts = labelled.groupBy("value", "lab").agg(F.count("*").alias("n"), F.min("doc").alias("one"), F.max("doc").alias("last"))
    whole_class = parts.groupBy("value").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.max("last").alias("last"), F.count("*").alias("parts"), F.max("lab").isNull().alias("none"), F.max(F.when(F.col("lab").isNotNull(), F.struct("n", "lab")))["lab"].alias("top"))
    open_ = whole_class.where("one < last and (parts > 1 or none)").select("value", "n", "top")
    members = stored(labelled.join(open_.hint("merge"), "value").select("value", "doc", "batch", "nth", "c", "n", (F.col("lab").isNull() | (F.col("lab") != F.col("top"))).alias("asks"), F.col("lab").isNotNull().alias("linked"), F.coalesce("lab", F.lit(0).cast("long")).alias("lab")), "members")
    if not members.isEmpty():
        places = members.select("batch", "doc", "nth", "c").distinct()
        around = stored(batches.groupBy("batch").cogroup(places.groupBy("batch")).applyInArrow(tokens_around("text", "doc", size, width), "doc long, batch long, nth int, c long, a long, tokens binary"), "around")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("doc", "batch", "nth", "c"), blocks).cast("int")
        dealt_ = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt_ = dealt_.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        # classes of one block go many to a task, those of more have tasks of their own
        dealt_ = dealt_.withColumn("group", F.when(blocks > 1, F.col("value")).otherwise(F.pmod("value", F.lit(16 * buckets)))).withColumn("large", blocks > 1)
        dealt_ = dealt_.select("group", "i", "j", "large", "value", "asks", "linked", "lab", "own", "doc", "batch", "nth", "c").join(around, ["doc", "batch", "nth", "c"])
        rest = dealt_.groupBy("group", "i", "j", "large").applyInArrow(class_passages(width, percent), PASSAGE)
        passages = passages.unionByName(stored(rest, "rest"))

    later = F.col("doc") > F.col("other")
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    words_of = lambda a, b: F.col(b) - F.col(a) + size - 1
    out = passages.select(pick("doc", "other").alias("doc_id"), pick("a", "x").alias("start_word"), F.when(later, words_of("a", "b")).otherwise(words_of("x", "y")).alias("n_words"), pick("other", "doc").alias("other_id"), pick("x", "a").alias("other_start"), F.when(later, words_of("x", "y")).otherwise(words_of("a", "b")).alias("other_words"), "similarity")
    whole = found.where("kind = 'copy'").select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("start_word"), words_of("a", "b").alias("n_words"), F.col("other").alias("other_id"), F.lit(0).cast("long").alias("other_start"), words_of("a", "b").alias("other_words"), F.lit(1.0).alias("similarity"))
    return out.unionByName(whole).distinct()
