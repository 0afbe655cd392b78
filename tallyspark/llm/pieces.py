"""SentencePiece encoding (merge type) by a table of last tokens.

For a merge tokenizer, the encoding of every prefix of a text ends in one token, and a sequence is an encoding exactly
if each two neighbours in it are compatible: encoded together, they stay as they are. So for each prefix, an automaton
gives the tokens that end there, longest first, and the first one that is compatible with the last token of the prefix
before it is the prefix's last token. The ids follow from the table, from the back.

Texts are cut where no token of the vocabulary can cross, and each distinct stretch is encoded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct stretches and token pairs that a worker remembers before it starts afresh.
REMEMBERED = 400_000
LETTER = re.compile(r"[^\W\d_]")


def stretches(pieces: list[str]) -> re.Pattern[str]:
    """A pattern of stretches that no token crosses: letters, or other characters, each with the spaces before them.

    Letters that stand beside other characters in some token count as others. If that doesn't part the two kinds, the
    stretches are words.
    """
    bare = [p.lstrip(SPACE) for p in pieces]
    if any(SPACE in p for p in bare):
        raise ValueError("a token crosses from a word into the space after it")
    mixed = lambda other: [p for p in bare if len({bool(LETTER.match(c)) and c not in other for c in p}) > 1]
    other = "".join(sorted({c for p in mixed("") for c in p if LETTER.match(c)}))
    if mixed(other):
        return re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
    own = re.escape(other)
    return re.compile(rf"{SPACE}*[^\W\d_{own}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{own}])+|{SPACE}+")


class PieceModel:
    """A merge-type SentencePiece vocabulary with a leading space and identity normalisation; others raise."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        if len(self.byte_id) != 256 or any(sp.is_unused(i) for i in range(size)) or sp.encode("A  b") == sp.encode("a b"):
            raise ValueError("only vocabularies with byte fallback and identity normalisation are supported")
        self.cut = stretches(list(self.rank))
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        for p in self.rank:
            if len(p) > 1 and (halves := self._last_merge(p)):  # the others are never made by merging
                self.halves[p] = halves
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def _last_merge(self, token: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a token joins, or None if merging doesn't end in the token."""
        parts = list(token)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == np.inf:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens stay two when they stand side by side.

        Their merges are undone, latest first. If the parts that meet at the boundary at some moment could be merged
        before the next merge was made, the tokens would not have come about.
        """
        rank, halves, limit = self.rank, self.halves, np.inf
        while True:
            if rank.get(left + right, np.inf) < limit:
                return False
            a, b = halves.get(left), halves.get(right)
            if a and (not b or rank[left] > rank[right]):
                limit, left = rank[left], a[1]
            elif b:
                limit, right = rank[right] + 0.5, b[0]  # an equal merge further left goes first
            else:
                return True

    def tokens(self, stretch: str) -> list[str]:
        """The tokens of a stretch; characters outside the vocabulary stand alone."""
        n = len(stretch)
        ending: list[list[str]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(stretch):
            ending[end].append(token)
        last, pairs = [""] * n, self.pairs
        if len(pairs) > REMEMBERED:
            pairs.clear()
        for end in range(n):
            for token in (*ending[end], stretch[end]):
                start = end - len(token)
                if start < 0:
                    last[end] = token
                    break
                before = last[start]
                fits = pairs.get((before, token))
                if fits is None:
                    fits = pairs[before, token] = self.compatible(before, token)
                if fits:
                    last[end] = token
                    break
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids(self, stretch: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(stretch):
            found = self.id.get(token)
            if found is None:
                out.extend(self.byte_id[b] for b in token.encode())
            else:
                out.append(found)
        return out

    def text(self, ids: list[int]) -> str:
        """The text of ids, with the leading space still on; bytes that are no UTF-8 become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + run.decode(errors="replace")

    def encode(self, text: str) -> tuple[bytes, str]:
        """A whole text: its ids as little-endian 32-bit integers, and the text decoded from them."""
        if not text:
            return b"", ""
        known, ids, texts = self.known, [], []
        for stretch in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(stretch)
            if found is None:
                own = self.ids(stretch)
                found = (np.array(own, "<i4").tobytes(), self.text(own))
                if len(stretch) < 64:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[stretch] = found
            ids.append(found[0])
            texts.append(found[1])
        return b"".join(ids), "".join(texts)[1:]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Encode every whole text and decode it again: key, ids (array of int), decoded.

    `path`: a merge-type SentencePiece model that every executor can open. No begin or end ids. A null text counts as
    empty; an empty text has no ids and decodes to an empty text. Repeated rows give repeated results, other columns of
    `df` are ignored, and an empty table gives an empty one. A very long text is encoded whole, in stretches between places
    that no token crosses. A worker holds at most REMEMBERED stretches and pairs.
    """
    kind = df.schema[key].dataType

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [tok.encode(x or "") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x, _ in rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(x for x, _ in rows), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([x for _, x in rows], pa.string())], ["key", "ids", "decoded"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(coded, f"key {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("key", key)
