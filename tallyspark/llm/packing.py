"""Sequence packing by minimum bin slack.

Documents are tokenised and only those longer than a sequence are cut. How the pieces fill sequences depends on nothing
but how many pieces of each length there are, a table of at most `capacity` rows. From that table the fullest feasible
combination is found bin by bin, by subset sums over bitsets, and taken out as often as the counts allow. Pieces then
find their places by their rank among the pieces of their length, on the executors.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored
from .sharding import with_slots
from .shingles import mix

#: The pre-tokenisation pattern of the byte-level vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What may follow an apostrophe in a contraction, as PATTERN has it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct words that a worker remembers before it starts afresh, and characters that are cut into words together.
REMEMBERED, TOGETHER = 300_000, 1_000_000
LETTER, NUMBER, OTHER, BLANK = range(4)


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """The kind of every code point in PATTERN's terms."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for found in regex.finditer(pattern, every):
            first, last = ord(every[found.start()]), ord(every[found.end() - 1])
            kinds[first : last + 1] = kind
    kinds[0xD800:0xE000] = OTHER
    return kinds


def word_starts(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where PATTERN's words start in texts laid end to end as code points; edges: where the texts that aren't empty start."""
    kind = character_kinds()[code]
    blank = kind == BLANK
    first = np.zeros(len(code) + 1, bool)
    first[edges] = first[-1] = True
    run = np.ones(len(code), bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= first[:-1]
    # a run of blanks leaves its last one to what follows, which takes it in if it is a space
    joined = np.zeros(len(code), bool)
    joined[1:] = run[1:] & ~blank[1:] & (code[:-1] == 32)
    joined &= ~first[:-1]
    start = run & ~joined
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:-1]
    # contractions, of apostrophes that a word starts with
    at = np.flatnonzero((code == 39) & run & start)
    for ending in ENDINGS:
        fits = at + len(ending) < len(code)
        for k, letter in enumerate(ending, 1):
            here = np.minimum(at + k, len(code) - 1)
            fits &= (code[here] == ord(letter)) & ~first[here]
        hit = at[fits]
        start[hit + 1] = False
        after = hit + len(ending) + 1
        start[after[after < len(code)]] = True
        at = at[~fits]
    return np.flatnonzero(start)


class WordIds:
    """Ids of whole texts by a byte-level `tokenizers` file; each distinct word is encoded once per worker.

    Texts are cut into words and put together again with numpy; a word is known by a 64-bit hash of its characters.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normaliser and leading space are supported")
        vocabulary = spec["model"]["vocab"]
        merged = [vocabulary["".join(x.split(" ") if isinstance(x, str) else x)] for x in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError("only vocabularies whose ids follow their merges are supported")
        # byte-level vocabularies spell a byte as a visible character: its own, or one from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in special}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[int, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, no special tokens added."""
        out: list[bytes] = []
        begin = size = 0
        for end, text in enumerate([*texts, ""], 1):
            size += len(text)
            if size >= TOGETHER or end > len(texts):
                out += self._together(texts[begin:end])
                begin, size = end, 0
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        # a text that spells a special token, or isn't valid, goes through the tokenizer as a whole
        apart = {i for i, x in enumerate(texts) if self.special and self.special.search(x)}
        flat = "".join("" if i in apart else x for i, x in enumerate(texts))
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([0 if i in apart else len(x) for i, x in enumerate(texts)], np.int64)
        edge = np.cumsum(size) - size
        n = np.zeros(len(texts) + 1, np.int64)
        ids = np.zeros(0, "<u4")
        if len(code):
            start = word_starts(code, edge[size > 0])
            length = np.diff(np.append(start, len(code)))
            ahead = np.arange(len(code)) - np.repeat(start, length)
            name = np.add.reduceat(mix(code.astype(np.uint64) + (ahead.astype(np.uint64) + np.uint64(1) << np.uint64(21))), start)
            name, first, of = np.unique(name, return_index=True, return_inverse=True)
            names = name.tolist()
            for k, w in enumerate(names):
                if w not in known:
                    at = start[first[k]]
                    known[w] = array("I", self.words.encode_ordinary(flat[at : at + length[first[k]]])).tobytes()
            found = [known[w] for w in names]
            many = np.array([len(x) // 4 for x in found])
            base = np.cumsum(many) - many
            own = many[of]
            before = np.cumsum(own) - own
            ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(base[of] - before, own) + np.arange(int(own.sum()))]
            n[:] = np.append(before, len(ids))[np.searchsorted(start, np.append(edge, len(code)))]
        whole = lambda x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(texts[i]) if i in apart else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(n[:-1].tolist(), n[1:].tolist(), strict=True))]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, hold: bool = True) -> DataFrame:
    """The ids of every text and an end id 0, in pieces of at most `capacity`: doc_id, piece, start, length, ids.

    ids: little-endian unsigned 32-bit integers. Only documents longer than `capacity` are cut; their first piece takes
    the remainder. A null or empty text is the end id alone; a very long one is tokenised whole, and its ids are held once. Repeated rows give repeated pieces. With `hold`, a worker keeps
    the words that it knows for its next task; without, it has the memory back for other stages.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    keys = part.column(0).to_pylist()
                    out = []
                    for key, ids in zip(keys, tok.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                        ids += b"\0\0\0\0"
                        n = len(ids) // 4
                        first = n % capacity or capacity
                        bounds = [0, *range(first, n + 1, capacity)]
                        out += [(key, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids"])
        finally:
            if not hold:
                tok.known.clear()
                released()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths, each at most as often as it is there, with the largest sum up to `room`."""
    sums, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before, most = sums, min(counts[length], room // length)
        times = 1
        while most > 0:  # binary splitting of the multiplicity
            use = min(times, most)
            sums |= sums << use * length
            most, times = most - use, times * 2
        sums &= (1 << room + 1) - 1
        if sums != before:
            steps.append((length, before))
        if sums >> room & 1:
            break
    rest, chosen = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        times = 0
        while not before >> rest & 1:
            rest, times = rest - length, times + 1
        if times:
            chosen.append((length, times))
    return chosen


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how often in the bin)]), until nothing is left: the longest piece, then the fullest rest."""
    left, plan = dict(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        inside = dict(fullest(left, capacity - longest))
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        repeats = min(left[x] // n for x, n in inside.items())
        plan.append((repeats, sorted(inside.items(), reverse=True)))
        for x, n in inside.items():
            left[x] -= repeats * n
            if not left[x]:
                del left[x]
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int = 2048) -> DataFrame:
    """`pieces` (length long, and others) with sequence_id and offset: as few sequences as minimum bin slack finds.

    `order` makes the rank among pieces of one length definite. The driver sees one count per length, `capacity` of
    them at most; the plan that goes back out is bounded likewise, whatever the number of rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    starts, ranges, base = dict.fromkeys(counts, 0), [], 0
    for repeats, inside in bin_plan(counts, capacity):
        offset = 0
        for length, times in inside:
            ranges.append((length << 40 | starts[length], starts[length], times, base, offset))
            starts[length] += times * repeats
            offset += times * length
        base += repeats
    table = pieces.sparkSession.sparkContext.broadcast(np.array(sorted(ranges), np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        _, start, times, first, offset = table.value[np.searchsorted(table.value[:, 0], length << 40 | rank, "right") - 1].T
        return pd.DataFrame({"sequence_id": first + (rank - start) // times, "offset": offset + (rank - start) % times * length})

    ranked = with_slots(pieces, "length", order, "_rank")
    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, hold: bool = True) -> DataFrame:
    """All documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Empty in, empty out."""
    pieces = token_pieces(docs, path, capacity, hold).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)
