"""Tokens, passages, near copies, repeats and packing against brute force, over awkward texts and empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import near, packing, passages, pieces, repeats
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.runindex import RunIndex


def test_sentencepiece_matches_the_library(docs, no_docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode_decode(docs, "doc_id", "text", path).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = sp.encode(r["text"] or "")
        want[r["doc_id"], tuple(ids), sp.decode(ids)] += 1
    assert got == want
    assert pieces.encode_decode(no_docs, "doc_id", "text", path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeilnorst TH.,'é　日😀\n0123"), max_size=60))
def test_sentencepiece_on_any_text(text):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, decoded = pieces.model(path).encode(text)
    want = sp.encode(text)
    assert np.frombuffer(ids, "<i4").tolist() == want and decoded == sp.decode(want)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_gapless_and_tight(docs, capacity):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = packing.pack_documents(docs, path, capacity).collect()
    assert Counter(tuple(r[:5]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in held.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(held) <= math.ceil(1.02 * sum(r["length"] for r in rows) / capacity) + 1


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_bin_plan_uses_every_piece(counts):
    used = Counter()
    for repeats_, inside in packing.bin_plan(counts, 40):
        assert sum(length * n for length, n in inside) <= 40
        for length, n in inside:
            used[length] += n * repeats_
    assert dict(used) == counts


def brute_components(rows, size, percent):
    """(n_shingles, component) of each row; rows of one id are one document."""
    sets = []
    for i, x in rows:
        words = tuple((x or "").encode().lower().split())
        sets.append((i, {words[k : k + size] for k in range(len(words) - size + 1)} if len(words) >= size else {words} if words else set()))
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets:
        for j, other in sets:
            if i < j and own and other and 100 * len(own & other) >= percent * len(own | other):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return Counter((i, len(own), top(i)) for i, own in sets)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_components(docs, no_docs, size, percent):
    named = docs.where("doc_id is not null")
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.near_components(named, size, percent).collect())
    assert got == brute_components(rows, size, percent)
    assert near.near_components(no_docs).count() == 0
    every = near.near_components(docs, size, percent).collect()
    assert len(every) == docs.count()
    assert all(r["component_id"] is None and r["kept"] for r in every if r["doc_id"] is None)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in every if r["doc_id"] is not None)


def test_a_loose_family_is_joined_through_its_middle(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    steps = [" ".join(words[:k] + [f"x{j}" for j in range(k, 0, -1)] + words[2 * k :]) for k in range(0, 40)]
    rows = list(enumerate(steps))
    for block in (512, 8, 1):  # the family as a whole, in pairs of blocks, and bucket by bucket
        monkeypatch.setattr(near, "BLOCK_DOCS", block)
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
        assert got == brute_components(rows, 3, 85)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 2, 3), (3, 2, 1, 0)])
def test_an_id_with_several_texts_links_what_they_are_like(spark, order):
    rows = [(5, "q r s t u v w"), (5, "a b c d e f g"), (3, "a b c d e f g"), (9, "q r s t u v w")]
    docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in near.near_components(docs, 3, 85).collect())
    assert got == [(3, 5, 3, True), (5, 5, 3, False), (5, 5, 3, False), (9, 5, 3, False)]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.85, 0.95):
        found = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = int(600 * 2 * share / (1 + share))
            y = np.concatenate([x[:n], rng.integers(0, 1 << 63, 600 - n, dtype=np.uint64)])
            a, b = (near.samples(np.sort(z), np.array([0, len(z)])) for z in (x, y))
            apart = int(np.bitwise_count((near.odd_sketch(a) ^ near.odd_sketch(b)).view(np.uint64)).sum())
            found.append(1 + math.log(1 - 2 * apart / near.BITS) * near.BITS / (4 * near.SAMPLES))
        assert abs(np.mean(found) - share) < 0.02


def brute_repeats(rows, span=repeats.SPAN):
    order = sorted({(repeats.LAST if i is None else i) for i, _ in rows})
    seen, out = set(), Counter()
    for key in order:
        same = [(i, (x or "").encode()) for i, x in rows if (repeats.LAST if i is None else i) == key]
        for i, x in same:
            gone = bytearray(len(x))
            for p in range(len(x) - span + 1):
                if x[p : p + span] in seen:
                    gone[p : p + span] = b"\1" * span
            kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
            runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone, strict=False) if b and not a)
            out[i, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
        for _, x in same:
            seen.update(x[p : p + span] for p in range(len(x) - span + 1))
    return out


@pytest.mark.parametrize(("batch", "hot"), [(1_500_000, 2048), (2000, 3)])
def test_repeats_match_brute_force(docs, no_docs, batch, hot):
    small = docs.select("doc_id", "text", "key")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(small, batch=batch, hot=hot).collect())
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert repeats.without_repeats(no_docs).count() == 0


def test_repeats_give_texts_and_keep_columns(docs):
    out = repeats.without_repeats(docs, texts=True)
    assert [c for c in out.columns if c in docs.columns and c != "n_bytes"] == [c for c in docs.columns if c != "n_bytes"]
    for r in out.collect():
        assert (r["text"] is None) == (r["doc_id"] == 80)
        if r["n_removed"] == 0 and r["text"] is not None:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


few_bytes = st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 12), few_bytes, few_bytes, st.data())
def test_run_index(depth, held, asked, data):
    asked = [*asked, *(a + h[: len(h) // 2 + 4] for a, h in zip(asked, held, strict=False))]
    weights = [data.draw(st.integers(0, 9)) for _ in held]
    flat = lambda strings: (np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    index = RunIndex(*flat(held), np.array(weights, np.int64), depth)
    want = [min([w for w, t in zip(weights, held, strict=True) if s[i : i + depth] in t], default=repeats.LAST) for s in asked for i in range(len(s) - depth + 1)]
    assert index.matched(*flat(asked)).tolist() == want


def test_passages_cover_every_exact_repeat(docs, no_docs):
    unique = docs.where("doc_id is not null and doc_id not in (7, 96)")
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in unique.collect()}
    found = passages.near_passages(unique, batch=4000).collect()
    covered = defaultdict(list)
    shingled = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for r in found:
        covered[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
        a = shingled(words[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]])
        b = shingled(words[r["other_id"]][r["other_start"] : r["other_start"] + r["other_words"]])
        assert r["other_id"] < r["doc_id"] and r["n_words"] >= 50
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"], abs=1e-5) and r["similarity"] >= 0.8
    seen = set()
    for i in sorted(words):
        own = {tuple(words[i][p : p + 50]): p for p in range(len(words[i]) - 49)}
        for w, p in own.items():
            if w in seen:
                assert any(a <= p and p + 50 <= b for a, b in covered[i]), (i, p)
        seen.update(own)
    assert passages.near_passages(no_docs).count() == 0


@pytest.mark.parametrize("block", [512, 2])
def test_passages_alike_that_differ_from_their_first_holder(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = np.random.default_rng(11)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    words, families = {}, range(0, 600, 100)
    for base in families:
        passage = prose(60)
        edited = lambda at: [f"{w}x" if k == at else w for k, w in enumerate(passage)]  # noqa: E731,B023
        for i in range(1, 13):  # every 5 words of the passage stand in one of these, too few in a row
            words[base + i] = prose(60) + (passage[:32] if i % 2 else passage[28:]) + prose(60)
        words[base + 13] = prose(40) + passage + prose(40)
        words[base + 14] = prose(40) + edited(30) + prose(40)
        again = prose(60)  # its first holder has it in parts before it has it as a whole
        words[base + 50] = sum((prose(60) + (again[:32] if k % 2 else again[28:]) for k in range(12)), []) + prose(60) + again
        words[base + 51] = prose(40) + again + prose(40)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    found = passages.near_passages(docs).collect()
    shingled = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for r in found:
        a = shingled(words[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]])
        b = shingled(words[r["other_id"]][r["other_start"] : r["other_start"] + r["other_words"]])
        assert r["other_id"] < r["doc_id"] and r["n_words"] >= 50
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"], abs=1e-5) and r["similarity"] >= 0.8
    pairs = {(r["doc_id"], r["other_id"]) for r in found}
    assert len(found) == len(set(found))
    assert all((base + 14, base + 13) in pairs and (base + 51, base + 50) in pairs for base in families)
