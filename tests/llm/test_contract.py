"""Every registered query over a whole small table: columns and types, and values against plain Python where it is quick."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import language, passages, queries
from tallyspark.llm.queries import tokenizer_path

COLUMNS = {
    "op1_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op3_compact_windows": {"doc_id": "bigint", "start_word": "bigint", "n_words": "bigint", "other_id": "bigint", "other_start": "bigint", "other_words": "bigint", "similarity": "double"},
    "op4_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op5_bin_slack": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_odd_sketch": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_jump_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_run_index": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op13_vector_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    results = {}

    def run(name):
        if name not in results:
            df = queries.QUERIES[name](spark, sf_dir)
            results[name] = ({f.name: f.dataType.simpleString() for f in df.schema}, df.collect())
        return results[name]

    return texts, run


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(found, name):
    texts, run = found
    kinds, rows = run(name)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if "doc_id" in COLUMNS[name] and name not in ("op3_compact_windows", "op5_bin_slack", "op13_vector_packing"):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)


def test_tokens_and_pieces(found):
    import sentencepiece
    from tokenizers import Tokenizer

    texts, run = found
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in run("op1_sentencepiece")[1]:
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    bins = defaultdict(list)
    for r in run("op5_bin_slack")[1]:
        ids = np.array([*bpe.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in bins.values():
        ends = np.cumsum([n for _, n in sorted(inside)])
        assert [at for at, _ in sorted(inside)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_shards_are_those_of_a_plain_jump_hash(found):
    def jump(key, n):
        state, b, j = key & (1 << 64) - 1, -1, 0
        while j < n:
            b, state = j, (state * 2862933555777941757 + 1) & (1 << 64) - 1
            j = int((b + 1) * ((1 << 31) / ((state >> 33) + 1)))
        return b

    texts, run = found
    slots = defaultdict(list)
    for r in run("op8_jump_shards")[1]:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 16), jump(r["doc_id"], 17))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_held_out_languages(spark, sf_dir, found):
    _, run = found
    rows = {r["doc_id"]: r for r in run("op9_language")[1]}
    labels = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select("doc_id", "lang").collect()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    own = [(rows[r["doc_id"]]["lang_pred"], r["lang"]) for r in labels if rows[r["doc_id"]]["held_out"] and rows[r["doc_id"]]["lang_pred"] != "und"]
    assert sum(a == b for a, b in own) >= 0.9 * len(own) > 0


def test_media_hold_the_texts(found):
    texts, run = found
    for r in run("op4_media")[1]:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] > len(payload) and r["feature"]


def test_predictions_equal_plain_loops():
    """Every window, place and filter by loops, on texts that end inside a window and one that fills several."""
    net = language.train([b"the cat and the dog", b"le chat et le chien", b"der hund und die katze"] * 8, ["en", "fr", "de"] * 8)
    texts = [b"a", b"the end of the matter " * 30, bytes(range(1, 256)), b"x" * language.WINDOW]
    got = language.predict(net, texts, lanes=3)
    for text, row in zip(texts, got, strict=True):
        total, count = np.zeros(len(net.languages)), 0
        for at in range(0, max(1, len(text)), language.WINDOW):
            cells = [*text[at : at + language.WINDOW]]
            cells += [256] * (language.WINDOW - len(cells))
            pooled = [max(0.0, *(float(sum(table[k][cells[p + k]][f] for k in range(len(table)))) for p in range(language.WINDOW - len(table) + 1))) for table in net.tables for f in range(table[0].shape[1])]
            score = np.array([*pooled, 1.0]) @ net.dense
            total += np.exp(score - score.max()) / np.exp(score - score.max()).sum()
            count += 1
        assert row == pytest.approx(total / count, abs=1e-4)


def test_components_and_repeats(spark, sf_dir, found):
    from test_text_operators import brute_components, brute_repeats

    texts, run = found
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run("op7_odd_sketch")[1]) == brute_components(list(texts.items()), 3, 85)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op10_run_index")[1])
    assert got == brute_repeats(list(texts.items()))


def test_the_pipeline_runs_from_end_to_end(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    bins = defaultdict(int)
    for r in out.collect():
        bins[r["sequence_id"]] += r["length"]
    assert bins and max(bins.values()) <= 2048


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def edited(rng, words, times):
    out = list(words)
    for at in rng.choice(len(words) - 10, times, replace=False) + 5:
        out[at] = f"e{rng.integers(1 << 40)}"
    return out


def alike(a, b):
    shingled = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    x, y = shingled(a), shingled(b)
    return len(x & y) / len(x | y)


def test_recall_of_near_passages(spark):
    """At least 0.95 of planted passages of a similarity of 0.8 or more are found, and 0.9 of those that are close to it."""
    rng = np.random.default_rng(21)
    rows, planted = [], []
    for k, (length, times) in enumerate([(60, 1), (100, 2), (200, 4), (90, 1)] * 30):
        passage = prose(rng, length)
        other = edited(rng, passage, times)
        rows += [(2 * k, " ".join(prose(rng, 70) + passage + prose(rng, 70))), (2 * k + 1, " ".join(prose(rng, 70) + other + prose(rng, 70)))]
        if alike(passage, other) >= 0.8:
            planted.append((2 * k + 1, 2 * k))
    found = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(120)} and sum(p in found for p in planted) >= 0.95 * len(planted) > 80


def changed(rng, words, how):
    """A passage with one large edit: words put in, left out, or a stretch of them moved to the end."""
    at, n = len(words) // 2, max(1, len(words) // 11)
    if how == "inserted":
        return words[:at] + prose(rng, n) + words[at:]
    if how == "deleted":
        return words[:at] + words[at + n :]
    return words[:at] + words[at + n :] + words[at : at + n]


@pytest.mark.parametrize("batch", [1, None])
def test_recall_of_passages_with_large_edits(spark, batch):
    """Insertions, deletions and moved text, in the earlier or the later document, whichever documents are worked on together."""
    rng = np.random.default_rng(31)
    rows, planted = [], set()
    for k in range(96):
        passage = prose(rng, (70, 84, 130, 400)[k % 4])
        other = changed(rng, passage, ("inserted", "deleted", "moved")[k // 4 % 3])
        pair = [passage, other] if k // 12 % 2 else [other, passage]
        rows += [(2 * k + s, " ".join(prose(rng, 60) + x + prose(rng, 60))) for s, x in enumerate(pair)]
        if alike(*pair) >= 0.8:
            planted.add((2 * k + 1, 2 * k))
    tail = prose(rng, 404)  # 70 words put in before the last 40, which no window reaches
    rows += [(1000, " ".join(tail)), (1001, " ".join(tail[:364] + prose(rng, 70) + tail[364:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.near_passages(docs, **({"batch": batch} if batch else {})).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    assert found <= {(2 * k + 1, 2 * k) for k in range(96)} | {(1001, 1000)}
    assert len(planted) > 60 and sum(p in found for p in planted) >= 0.95 * len(planted)
    assert max(r["other_words"] for r in got if r["doc_id"] == 1001) >= 360


def test_variants_of_one_passage_are_joined(spark):
    """Many documents hold a passage, each with an edit of its own; the smallest id has one that is too far from all."""
    rng = np.random.default_rng(22)
    passage = prose(rng, 120)
    texts = {i: prose(rng, 60) + edited(rng, passage, 9 if i == 0 else 1) + prose(rng, 60) for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in passages.near_passages(docs).collect():
        a, b = texts[r["doc_id"]][r["start_word"] :][: r["n_words"]], texts[r["other_id"]][r["other_start"] :][: r["other_words"]]
        assert r["n_words"] >= 50 and alike(a, b) == pytest.approx(r["similarity"], abs=1e-5) and r["similarity"] >= 0.8
        root[top(r["doc_id"])] = top(r["other_id"])
    assert Counter(top(i) for i in range(1, 60)).most_common(1)[0][1] >= 0.95 * 59


def test_chains_of_variants_stay_joined(spark):
    """Each of a chain differs from the one before by a word, and is alike with no other; the ids say nothing of the order."""
    rng = np.random.default_rng(5)
    rows, links = [], []
    for c in range(40):
        chain = [prose(rng, 50)]
        for at in rng.permutation(np.arange(5, 45, 6))[:5]:
            chain.append([*chain[-1][:at], f"e{rng.integers(1 << 40)}", *chain[-1][at + 1 :]])
        ids = (100 * c + rng.permutation(6)).tolist()
        rows += [(i, " ".join(prose(rng, 60) + x + prose(rng, 60))) for i, x in zip(ids, chain, strict=True)]
        links += [(i, j) for i, j, x, y in zip(ids, ids[1:], chain, chain[1:]) if alike(x, y) >= 0.8]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch=4000).collect():
        assert r["doc_id"] // 100 == r["other_id"] // 100
        root[top(r["doc_id"])] = top(r["other_id"])
    assert len(links) == 200 and all(top(i) == top(j) for i, j in links)


def test_passages_against_every_stretch():
    """Edits anywhere, those at the ends too: a pair is found if and only if some two stretches of 46 tokens or more are alike."""
    rng = np.random.default_rng(1)
    shingled = lambda w: np.array([hash(tuple(w[k : k + 5])) & 0xFFFFFFFF for k in range(len(w) - 4)], np.uint32)
    pairs = 0
    for _ in range(400):
        length = int(rng.choice([50, 55, 60, 80, 120, 200]))
        one = rng.integers(0, 1 << 40, length).tolist()
        two = list(one)
        for _ in range(int(rng.integers(1, 1 + max(2, length // 25)))):
            at, many = int(rng.integers(len(two))), int(rng.integers(1, 1 + max(1, length // 15)))
            two[at : at + (0, 1, many)[many % 3]] = rng.integers(0, 1 << 40, (many, 1, 0)[many % 3]).tolist()
        x, y = (shingled([*rng.integers(0, 1 << 40, 60).tolist(), *w, *rng.integers(0, 1 << 40, 60).tolist()]) for w in (one, two))
        _, run, place = np.intersect1d(x, y, return_indices=True)
        run, place = np.sort(run), np.sort(place)
        both = np.arange(len(run))[None, :] - np.arange(len(run))[:, None] + 1
        wide, far = (np.maximum(46, v[None, :] - v[:, None] + 1) for v in (run, place))
        real = bool((5 * both >= 4 * (wide + far - both)).any())
        got = passages.alike(x, y, 46, 80)
        assert bool(got) == real == bool(passages.alike(y, x, 46, 80))
        for a, b, c, d, share in got:
            left, right = set(x[a:b].tolist()), set(y[c:d].tolist())
            assert min(b - a, d - c) >= 46 and share == len(left & right) / len(left | right) >= 0.8
        pairs += real
    assert pairs > 200


def test_an_id_with_several_texts_and_copies(spark):
    rng = np.random.default_rng(23)
    passage, whole = prose(rng, 80), prose(rng, 300)
    rows = [(7, " ".join(prose(rng, 60) + passage)), (7, " ".join(passage + prose(rng, 40))), (9, " ".join(prose(rng, 30) + passage)), *[(i, " ".join(whole)) for i in (3, 4, 5, 5)], (None, " ".join(whole)), (11, None), (12, "")]
    for parts in (1, 4):
        got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert {(r["doc_id"], r["other_id"]) for r in got} == {(9, 7), (4, 3), (5, 3)}
        assert all((r["start_word"], r["n_words"], r["similarity"]) == (0, 300, 1.0) for r in got if r["doc_id"] < 7)
