"""Language identification by a byte convolutional network, trained and applied with numpy.

Texts are cut into fixed windows of bytes. Filters of several widths slide over the bytes of a window, their largest
responses are pooled, and a softmax over these gives the languages; a document's prediction is the mean over all of its
windows. A filter on raw bytes is a table with one row per byte value and place, so applying it is table lookups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released
from .telephony import in_slices

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: The largest training sample: documents per language, and bytes of a document's excerpt. The excerpt starts anywhere.
PER_LANGUAGE, EXCERPT = 400, 1024
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteNet:
    """tables[w][k]: (257, filters) for place k of width w; byte 256 is padding. dense: (features + 1, languages)."""

    languages: list[str]
    tables: list[np.ndarray]
    dense: np.ndarray


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each padded with 256, and the text that each belongs to."""
    counts = np.array([max(1, -(-len(x) // WINDOW)) for x in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = (np.cumsum(counts) - counts) * WINDOW
    cells = np.full(int(counts.sum()) * WINDOW, 256, np.int16)
    for x, at in zip(texts, starts.tolist(), strict=True):
        cells[at : at + len(x)] = np.frombuffer(x, np.uint8)
    return cells.reshape(-1, WINDOW), owner


def responses(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """(windows, places, filters) of the filters of one width."""
    width, span = len(table), WINDOW - len(table) + 1
    out = table[0].take(cells[:, :span], axis=0)
    for k in range(1, width):
        out += table[k].take(cells[:, k : k + span], axis=0)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteNet:
    """Fit by Adam on cross entropy. The gradient of max pooling goes to the place of each filter's largest response."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return ByteNet(languages, [], np.zeros((1, len(languages)), np.float32))
    rng = np.random.default_rng(seed)
    cells, owner = windows(texts)
    truth = np.array([languages.index(x) for x in labels])[owner]
    weights = [rng.normal(0, 0.3, (w, 257, FILTERS)).astype(np.float32) for w in WIDTHS]
    for t in weights:
        t[:, 256] = 0
    weights.append(rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(languages))).astype(np.float32))
    mean, square, step = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(p := rng.permutation(len(cells)), max(1, len(p) // batch)):
            x, y = cells[rows], truth[rows]
            tops, where = [], []
            for table in weights[:-1]:
                r = responses(table, x)
                at = r.argmax(axis=1)
                where.append(at)
                tops.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
            pooled = np.concatenate([np.maximum(t, 0) for t in tops] + [np.ones((len(x), 1), np.float32)], axis=1)
            error = softmax(pooled @ weights[-1])
            error[np.arange(len(x)), y] -= 1
            error /= len(x)
            back = (error @ weights[-1].T)[:, :-1] * (pooled[:, :-1] > 0)
            grads = []
            for i, table in enumerate(weights[:-1]):
                g = np.zeros_like(table)
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(len(table)):
                    np.add.at(g[k], (x[np.arange(len(x))[:, None], where[i] + k], np.arange(FILTERS)[None, :]), own)
                g[:, 256] = 0
                grads.append(g)
            grads.append(pooled.T @ error)
            step += 1
            for w, g, m, s in zip(weights, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, weights[:-1], weights[-1])


def predict(net: ByteNet, texts: list[bytes], lanes: int = 96) -> np.ndarray:
    """(texts, languages): the mean probability over all windows of each text."""
    cells, owner = windows(texts)
    total = np.zeros((len(texts), len(net.languages)))
    for at in range(0, len(cells), lanes):
        part = cells[at : at + lanes]
        pooled = [np.maximum(responses(t, part).max(axis=1), 0) for t in net.tables]
        probability = softmax(np.concatenate([*pooled, np.ones((len(part), 1), np.float32)], axis=1) @ net.dense)
        np.add.at(total, owner[at : at + lanes], probability)
    return total / np.bincount(owner, minlength=len(texts))[:, None]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """About `per_language` excerpts of each label of `docs` (doc_id, text, lang), picked by a hash of the text.

    Only counts are gathered to find each label's share; then the excerpts come to the driver. That is a bounded sample:
    a few hundred rows per language of EXCERPT bytes at most.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30))
    # copies of a text share one draw, so a language's share is that of its different texts
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return [], []
    shares = [(lang, min(1 << 30, int((1 << 30) * per_language / n))) for lang, n in counts.items()]
    labelled = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long")), "lang")  # a row per label
    start = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.length("text") - EXCERPT // 2, F.lit(1))) + 1
    rows = labelled.where(draw < F.col("share")).select("lang", F.substring("text", start.cast("int"), F.lit(EXCERPT // 2)).cast("binary").alias("text"))
    # equal draws are copies of one text: one of them serves, and none can exceed the bound
    rows = rows.distinct().orderBy("lang", F.xxhash64("text"), "text").limit(2 * per_language * len(counts)).collect()
    return [bytes(r["text"]) for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNet:
    """A network for the labels of `docs`, from a bounded sample."""
    return train(*sample(docs, per_language))


def identify(docs: DataFrame, net: ByteNet) -> DataFrame:
    """`docs` with lang_pred and score (the mean probability of that language over the whole text's windows).

    A null text and a text without letters are `und` with score 0; of languages with equal scores the first by name
    counts. Texts are worked on by bytes, so memory follows neither rows nor batches; a very long text is a slice by
    itself, at two bytes a byte. Repeated rows have equal results. Other columns pass through, whatever their names,
    but for earlier lang_pred and score columns, which are replaced. Empty in, empty out.
    """
    keep = [x for x in docs.columns if x not in ("lang_pred", "score")]
    at_text = keep.index("text")
    known = docs.sparkSession.sparkContext.broadcast(net)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        released()
        for batch in batches:
            for part in in_slices([batch], at_text):
                texts = part.column(at_text).to_pylist()
                able = [i for i, x in enumerate(texts) if x and net.languages and LETTER.search(x)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if able:
                    p = predict(net, [texts[i].encode() for i in able])
                    for i, k, s in zip(able, p.argmax(axis=1), p.max(axis=1), strict=True):
                        lang[i], score[i] = net.languages[k], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score)], [*keep, "lang_pred", "score"])
        released()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep).mapInArrow(judged, f"{schema}, lang_pred string, score double")
