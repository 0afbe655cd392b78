"""Phrases that hold together, mined level by level.

A pass over the texts counts the words; each further pass counts the phrases of one word more, and only those whose two
overlapping subphrases are frequent (a phrase can't be more frequent than they are). What is frequent goes to the tasks
as a table of bits with a largest size, whatever the number of phrases: a bit that several share lets a phrase through
that its count then removes. Every level is a stored table; a phrase takes the counts of its first and of its last words
from the level below, so cuts are scored by joins with tables of frequent phrases alone.

Words and phrases are told apart by 64-bit hashes within their language.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .shingles import hashed, mix

#: Bytes of text that are worked on together, and the largest table of bits (64 MB).
TOGETHER, MOST_BITS = 2_000_000, 29
#: Parts over which rows of one language or subphrase are dealt.
SALTS = 64
_MARK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_GAP = _MARK | np.isin(np.arange(256), [9, 32])
_CHAIN = np.uint64(0xD6E8FEB86659FD93)


def language_key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def sliced(text: bytes, together: int) -> Iterator[bytes]:
    """`text` in stretches of about `together` bytes that end at a mark, across which no phrase lies."""
    at = 0
    while len(text) - at > together:
        chunk = np.frombuffer(text, np.uint8, offset=at)
        step = together
        while True:  # the first mark after `together` bytes, looked for in steps
            hit = np.flatnonzero(_MARK[chunk[step : step + together]])
            if len(hit) or step >= len(chunk):
                break
            step += together
        end = at + step + int(hit[0]) if len(hit) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def batches_of(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts of about `together` bytes in all) of batches (lang, text as binary)."""
    open_: dict[str, tuple[list[bytes], int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in sliced(text.as_py() or b"", together):
                texts, size = open_.pop(lang, ([], 0))
                if size and size + len(part) > together:
                    yield lang, texts
                    texts, size = [], 0
                if part:
                    texts.append(part)
                open_[lang] = texts, size + len(part) + 1
            if len(open_) > 64:  # many languages don't add up
                for other in list(open_):
                    yield other, open_.pop(other)[0]
    for lang, (texts, _) in open_.items():
        yield lang, texts


def key_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of a phrase, from those of all its words but the last and all but the first."""
    return mix(first * _CHAIN + last)


class Words:
    """The words of texts of one language, as hashes, and which of them go on in the same piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.flatnonzero(np.diff(_GAP[self.flat].view(np.int8), prepend=1))
        self.begin, self.end = edge[::2], edge[1::2]
        self.hash = mix(hashed(self.flat, self.begin, self.end) ^ np.uint64(language_key(lang)))
        marks = np.cumsum(_MARK[self.flat], dtype=np.int64)
        self.joined = marks[self.begin[1:]] == marks[self.end[:-1] - 1]  # word i and i + 1 are in one piece

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the key of the k words from it on, and whether they are in one piece."""
        value, inside = self.hash, np.ones(len(self.hash), bool)
        for _ in range(1, k):
            value, inside = self.longer(value, inside)
        return value, inside

    def longer(self, value: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of phrases of one word more."""
        return key_of(value[:-1], value[1:]), inside[:-1] & inside[1:] & self.joined[: max(0, len(inside) - 1)]

    def spelled(self, first: np.ndarray, k: int) -> list[str]:
        """The k words from each of `first` on, lower-cased and joined by spaces."""
        low = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)[self.flat].tobytes()
        return [b" ".join(low[self.begin[j] : self.end[j]] for j in range(i, i + k)).decode("utf-8", "replace") for i in first.tolist()]


class Bits:
    """A set of 64-bit hashes that may hold more than was put in; `words` has a bit for each value of the top bits."""

    def __init__(self, size: int, words: np.ndarray):
        self.size, self.words = size, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.size)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_of(keys: DataFrame, most: int = MOST_BITS) -> Bits:
    """The keys (key: long) as bits: about 64 for each, 2**most (most: 7 or more) at most. Only words of bits reach the driver."""
    size = min(most, max(16, (64 * keys.count()).bit_length()))
    word = F.shiftrightunsigned("key", 64 - size + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int))")
    table = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << size - 6, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Bits(size, words)


def counted(docs: DataFrame, k: int, below: Bits | None, least: int, together: int = TOGETHER) -> DataFrame:
    """lang, key, first, last, a: the phrases of k words that occur `least` times, of those whose two subphrases are in `below`.

    first and last are the keys of the subphrases; for k = 1 the word's own and 0, and a row with null keys for all words
    of a language. A slice of text sends the subphrases of each of its phrases once, with a count; the key follows from
    them, so only frequent phrases get theirs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(below) if below else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "first", "last", "a"]
        for lang, texts in batches_of(batches, together):
            words = Words(lang, texts)
            sub, inside = words.phrases(max(1, k - 1))
            if k == 1:
                key, first, last = sub, sub, np.zeros(len(sub), np.uint64)
            else:
                known = shared.value.has(sub) & inside
                at = np.flatnonzero(known[:-1] & known[1:] & words.joined[: max(0, len(known) - 1)])
                first, last = sub[at], sub[at + 1]
                key = key_of(first, last)
            key, where, n = np.unique(key, return_index=True, return_counts=True)
            if len(key):
                signed = [pa.array(x[where].view(np.int64)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), *signed, pa.array(n.astype(np.int64))], names)
                if k == 1:
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "first": pa.array([None], pa.int64()), "last": pa.array([None], pa.int64()), "a": pa.array([len(sub)])})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("first", "last"))
            key = first if k == 1 else key_of(first, last)
            yield batch.append_column("key", pa.array(key.view(np.int64), mask=batch.column("first").is_null().to_numpy(zero_copy_only=False)))

    rows = docs.mapInArrow(run, "lang string, first long, last long, a long").groupBy("lang", "first", "last").agg(F.sum("a").alias("a"))
    rows = rows.where((F.col("a") >= least) | F.col("first").isNull())
    return rows.mapInArrow(named, "lang string, first long, last long, a long, key long").select("lang", "key", "first", "last", "a")


def dealt(many: DataFrame, one: DataFrame, *by: str) -> DataFrame:
    """`many` joined with `one`, which has one row for each value of `by`; rows of a frequent value stay dealt by a salt."""
    many = many.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)))
    found = many.select(*by, "salt").distinct().join(one.hint("merge"), [*by])
    return many.join(found.hint("merge"), [*by, "salt"]).drop("salt")


def best(rows: DataFrame, top: int, *order: Column | str) -> DataFrame:
    """The `top` rows of each language with their rank: first of each salt, so that no task gets more than SALTS * top rows of one."""
    salt = F.pmod(F.col("key"), F.lit(SALTS))
    few = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def phrase_levels(docs: DataFrame, longest: int = 5, least: int = 100, most_bits: int = MOST_BITS, together: int = TOGETHER) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for 1 to `longest` words, the stored table of frequent phrases: lang, key, first, last, a, heads, tails.

    heads[j] is the count of a phrase's first j + 1 words, tails[j] that of its last j + 1; the last of both is its own.
    """
    own = F.array("a")
    words = stored(counted(docs, 1, None, least, together), "level1")
    totals = words.where("key is null").select("lang", F.col("a").alias("n"))
    levels = [words.where("key is not null").select("*", own.alias("heads"), own.alias("tails"))]
    for k in range(2, longest + 1):
        below = levels[-1]
        level = stored(counted(docs, k, bits_of(below.select("key"), most_bits), least, together), f"count{k}")
        level = dealt(level, below.select("lang", F.col("key").alias("first"), F.col("heads").alias("head")), "lang", "first")
        level = dealt(level, below.select("lang", F.col("key").alias("last"), F.col("tails").alias("tail")), "lang", "last")
        levels.append(stored(level.select("lang", "key", "first", "last", "a", F.concat("head", own).alias("heads"), F.concat("tail", own).alias("tails")), f"level{k}"))
    return totals, levels


def scored(totals: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The phrases of two words or more that no longer one replaces, with their lowest-scoring cut: lang, words, key, a, l, r, n, score.

    A phrase goes if a longer one that holds it is as frequent: then one of a single word more is.
    """
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    out = None
    for k in range(2, len(levels) + 1):
        level = levels[k - 1]
        if k < len(levels):
            above = levels[k]
            longer = above.select("lang", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"), "a").groupBy("lang", "key").agg(F.max("a").alias("most"))
            level = level.join(longer, ["lang", "key"], "left").where("most is null or most < a")
        level = dealt(level, totals, "lang")
        cut = F.expr(f"array_min(transform(sequence(1, {k - 1}), c -> struct((cast(1000 as decimal(4,0)) * a_ * n_) div (cast(heads[c - 1] as decimal(19,0)) * cast(tails[{k - 1} - c] as decimal(19,0))) as score, c as cut)))")
        level = level.withColumns({"a_": wide("a"), "n_": wide("n")}).withColumn("best", cut)
        level = level.select("lang", F.lit(k).alias("words"), "key", "a", F.expr("heads[best.cut - 1]").alias("l"), F.expr(f"tails[{k - 1} - best.cut]").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
        out = level if out is None else out.unionByName(level)
    return out


def spelled(docs: DataFrame, wanted: DataFrame, longest: int, together: int = TOGETHER) -> DataFrame:
    """The wanted phrases (lang, words, key) in letters: lang, words, key, phrase. One more pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(wanted.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, set[int]] = {}
        for lang, texts in batches_of(batches, together):
            words = Words(lang, texts)
            value, inside = words.hash, np.ones(len(words.hash), bool)
            for k in range(2, longest + 1):
                value, inside = words.longer(value, inside)
                at = np.flatnonzero(shared.value.has(value) & inside)
                key, where = np.unique(value[at], return_index=True)
                seen = told.setdefault(k, set())
                new = np.array([i for i, x in enumerate(key.tolist()) if x not in seen], np.int64)
                if len(seen) < 1_000_000:
                    seen.update(key[new].tolist())
                if len(new):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(new), "words": pa.array([k] * len(new), pa.int32()), "key": pa.array(key[new].view(np.int64)), "phrase": words.spelled(at[where[new]], k)})

    rows = docs.mapInArrow(run, "lang string, words int, key long, phrase string")
    return rows.groupBy("lang", "words", "key").agg(F.min("phrase").alias("phrase"))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, most_bits: int = MOST_BITS, together: int = TOGETHER) -> DataFrame:
    """Each language's `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), cut into pieces at . , ; : ! ? and line ends, and pieces into words at blanks and tabs.
    n: words of the language, a: occurrences of the phrase (overlaps count), l and r: those of the two parts of the cut of
    the lowest score, 1000 * a * n / (l * r) rounded down; ties of cuts go to the shorter first part, ties of phrases to
    the larger a and then to the smaller phrase. A null text counts as empty, a null lang as `und`. A very long text is
    worked on in stretches that end at a mark; a piece without any mark is held whole. Repeated rows count each; other
    columns play no part; an empty table, or one without a frequent phrase, gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text.alias("text"))
    totals, levels = phrase_levels(docs, longest, least, most_bits, together)
    found = stored(scored(totals, levels), "scored")
    # the score and count of the last row that can be in, per language; what ties with it needs its letters to be told apart
    last = best(found, top, F.desc("score"), F.desc("a"), "words", "key").groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    wanted = stored(dealt(found, last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last"), "wanted")
    named = wanted.join(spelled(docs, wanted, longest, together).hint("merge"), ["lang", "words", "key"])
    ranked = best(named, top, F.desc("score"), F.desc("a"), "phrase")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
