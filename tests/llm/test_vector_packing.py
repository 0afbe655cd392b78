from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyspark.llm import queries, vectorpacking
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.vectorpacking import Limits, packed


def sequences(rows, limits):
    """The rows by sequence, after a check of places."""
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in inside.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= limits.tokens and len(places) <= limits.segments
    return inside


def padding(inside, capacity):
    totals = [sum(n for _, n in x) for x in inside.values()]
    return sum(capacity - t for t in totals if t & t - 1)


def whole(rows, ids_of):
    """Each id of each row's text lies in exactly one piece."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == set(ids_of)
    for key, found in pieces.items():
        want = defaultdict(int)
        for ids in ids_of[key]:
            want[len(ids)] += len(ids)
            for a, n, crc, tokens in found:
                assert tokens != len(ids) or len(ids_of[key]) > 1 or zlib.crc32(ids[a : a + n].tobytes()) == crc
        have = defaultdict(int)
        for _, n, _, tokens in found:
            have[tokens] += n
        assert have == want


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_query_packs_every_id_without_padding(spark, sf_dir, bpe):
    rows = queries.QUERIES["op13_vector_packing"](spark, sf_dir).collect()
    texts = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        texts[r["doc_id"]].append(bpe(r["text"]))
    whole(rows, texts)
    inside = sequences(rows, Limits())
    assert padding(inside, 1024) == 0 and len(inside) <= -(-sum(r["length"] for r in rows) // 1024) + 10


def test_awkward_documents(spark, docs, no_docs, texts, bpe):
    rows = vectorpacking.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), Limits(512, 8)).collect()
    want = defaultdict(list)
    for key, text in texts:
        want[key].append(bpe(text))
    whole(rows, want)
    assert padding(sequences(rows, Limits(512, 8)), 512) == 0
    assert vectorpacking.pack_documents(no_docs, tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_a_very_long_text_crosses_every_pool(spark, bpe):
    text = "lorem ipsum dolor sit amet " * 120_000
    rows = vectorpacking.pack_documents(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).collect()
    whole(rows, {1: [bpe(text)], 2: [bpe("a")]})
    assert padding(sequences(rows, Limits()), 1024) == 0


def test_instruction_data_keeps_all_three_limits(spark):
    rng = np.random.default_rng(3)
    rows, ids = [], {}
    for i in range(3000):
        n = int(rng.integers(1, 300))
        ids[i] = rng.integers(0, 50_000, n).astype("<u4")
        rows.append((i, ids[i].tobytes(), int(rng.integers(0, n + 1)), "extra"))
    rows += [(-1, b"", 3, ""), (-2, None, None, "")]
    limits = Limits(1024, 12, 600)
    loss = {r[0]: r[2] for r in rows}
    got = vectorpacking.pack_examples(spark.createDataFrame(rows, "doc_id long, ids binary, loss long, length string").repartition(2), limits).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids) and all(r["start"] == 0 and r["length"] == len(ids[r["doc_id"]]) for r in got)
    bearing = defaultdict(int)
    for r in got:
        bearing[r["sequence_id"]] += loss[r["doc_id"]]
    assert max(bearing.values()) <= 600
    inside = sequences(got, limits)
    bound = max(sum(map(len, ids.values())) / 1024, 3000 / 12, sum(loss[i] for i in ids) / 600)
    assert len(inside) <= 1.06 * bound + 4
    with pytest.raises(ValueError):
        vectorpacking.pack_examples(spark.createDataFrame(rows[:1], "doc_id long, ids binary, loss long, length string"), Limits(0))


def test_the_heuristic_against_plain_loops():
    """The sequence that is open takes the example with the largest dot product, the first seen of equal sizes."""
    rng = np.random.default_rng(5)
    limits = Limits(100, 6, 60)
    sizes = [(int(n), int(rng.integers(0, n + 1))) for n in rng.integers(1, 70, 200)]
    sizes = [(n, min(x, 60)) for n, x in sizes]
    got = defaultdict(list)
    for part in packed(((i, np.zeros(n, "<u4").tobytes(), x) for i, (n, x) in enumerate(sizes)), limits, cut=False):
        for piece, sequence, _ in part:
            got[sequence].append((piece.length, piece.loss))
    left, want = list(sizes), []
    order = list(dict.fromkeys(sizes))
    while left:
        mean = [sum(n for n, _ in left) / len(left) / 100**2, 1 / 6**2, sum(x for _, x in left) / len(left) / 60**2]
        room, inside = [100, 6, 60], []
        while room[1]:
            fit = [s for s in order if s in left and s[0] <= room[0] and s[1] <= room[2]]
            if not fit:
                break
            value = [s[0] * mean[0] * room[0] + mean[1] * room[1] + s[1] * mean[2] * room[2] for s in fit]
            best = fit[int(np.argmax(np.round(value, 12)))]
            left.remove(best)
            inside.append(best)
            room = [room[0] - best[0], room[1] - 1, room[2] - best[1]]
        want.append(inside)
    assert [got[k] for k in sorted(got)] == want
