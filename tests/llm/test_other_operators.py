"""Search, media, archive, sharding, language and the pipeline."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, language, sharding, telephony, topk, warc


def brute_top_k(rows, step, k):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append([int(np.floor(64 * float(np.float32(x)))) for x in v])
    out = []
    for q in whole:
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(min(whole[q]), v, strict=False)), c) for c in whole if c != q for v in whole[c])
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-3, 3, 8) / 8)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [None, 1.0]), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, [1.0] * 8), (205, [0.5] * 3), (7, [0.25] * 8), (7, [0.25] * 8), (20, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    for k in (3, 20, 500):
        got = sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k).collect()))
        assert got == brute_top_k(rows, 20, k)
    assert topk.top_k(df.where("false"), "vec_id", "embedding", F.lit(True), 3).count() == 0


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 3, 6))]) for i in range(300)] + [(i, [1.0] * 6) for i in range(400, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 7).collect())) == brute_top_k(rows, 20, 7)


def test_codec_tables():
    for table, peak in ((telephony.MULAW, 32124), (telephony.ALAW, 32256)):
        assert len(set(table.tolist())) >= 255 and table.max() == peak and table.min() == -peak
    assert telephony.ALAW[0xD5] == 8 and telephony.MULAW[0xFF] == 0


def plain_adpcm(block):
    steps = telephony.adpcm_steps()
    sample, index = struct.unpack("<h", block[:2])[0], min(88, block[2])
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(steps[index])
            diff = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if nibble & 8 else sample + diff))
            index = max(0, min(88, index + telephony.INDEX_MOVES[nibble]))
            out.append(sample)
    return out


def plain_mulaw(code):
    code = ~code & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return -size if code & 128 else size


def plain_alaw(code):
    code ^= 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = size if exponent == 0 else (size + 256) << (exponent - 1)
    return size if code & 128 else -size


def test_adpcm_of_many_blocks_is_that_of_each():
    blocks = np.random.default_rng(8).integers(0, 256, (50, 64), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks, lanes=7)
    for block, pcm in zip(blocks, got, strict=True):
        assert pcm.tolist() == plain_adpcm(block.tobytes())


def test_features_are_those_of_the_stored_samples(spark, monkeypatch):
    monkeypatch.setattr(telephony, "TOGETHER", 500)
    texts = ["", "Ärger, ça va? 你好 " * 40, "a" * 191, "b" * 192, "c" * 193]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def summary(x):
        return f"{max(map(abs, x))}:{sum(v * v for v in x) // len(x)}:{sum((p < 0) != (q < 0) for p, q in zip(x, x[1:], strict=False))}"

    for rate in (4000, 8000, 16000):
        for r in telephony.text_media(docs, "mulaw", rate).collect():
            raw = texts[r["doc_id"]].encode()
            raw += b" " * (-len(raw) % 192 if raw else 192)
            pcm = [plain_mulaw(c) for c in raw]
            if rate == 4000:
                pcm = [(p + q) >> 1 for p, q in zip(pcm[::2], pcm[1::2], strict=True)]
            if rate == 16000:
                pcm = [v for p, q in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for v in (p, (p + q) >> 1)]
            crc = zlib.crc32(struct.pack(f"<{len(pcm)}h", *pcm))
            adpcm = [v for k in range(0, len(raw), 192) for v in plain_adpcm(raw[k : k + 192])]
            assert r["feature"] == f"mulaw {summary(pcm)} {crc} alaw {summary([plain_alaw(c) for c in raw])} adpcm {summary(adpcm)}"


def test_the_query_resamples_what_it_stores(spark):
    """By default the stored samples are at twice the source's rate, and the features are those of that signal."""
    docs = spark.createDataFrame([(1, "Ärger, ça va? 你好 " * 40), (2, None)], "doc_id long, text string")
    got, same, twice = ({r["doc_id"]: r["feature"] for r in x.collect()} for x in (telephony.text_media(docs), telephony.text_media(docs, rate=8000), telephony.text_media(docs, rate=16000)))
    assert got == twice and all(got[k] != same[k] for k in got)
    pcm = np.random.default_rng(3).integers(-32768, 32768, 1000).astype(np.int16)
    for x in (pcm, pcm[:2], telephony.resampled(pcm, 8000, 16000)):
        assert telephony.unfolded(telephony.folded(x, 16000), 16000).tolist() == x.tolist()
    assert len(telephony.folded(telephony.resampled(pcm, 8000, 16000), 16000)) == 2004


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_media_round_trip(docs, no_docs, codec):
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        whole = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[r["doc_id"], len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:])] += 1
    rows = telephony.text_media(docs, codec).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert telephony.text_media(no_docs).count() == 0


def pages(spark):
    big, other = "<p>" + "é" * 800, "x" * 1000
    rows = [(1, "http://a/?q=é", big), (2, "b", big), (3, None, big), (4, "d", other), (5, "e", "short"), (6, "f", "short"), (7, "g", None), (8, "h", ""), (9, "http://b.c/%20?x=1+2&y=%C3", "a\r\n\r\nb" * 400), (12, "", "empty url"), (13, "two words\r\n", "z"), (14, None, "no url"), (None, "j", other), (4, "d", other)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_archive_gives_every_page_back(spark):
    table = pages(spark)
    archive = warc.write_archive(table)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in warc.read_archive(archive).collect())
    best = {}
    for r in table.collect():
        best[r["html"] or ""] = max(best.get(r["html"] or "", -1), -1 if r["page_id"] is None else r["page_id"])
    want = Counter()
    for r in table.collect():
        body = (r["html"] or "").encode()
        revisit = len(body) >= 1000 and r["page_id"] != best[r["html"] or ""]
        want[r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best[r["html"] or ""] if revisit else None, r["url"]] += 1
    assert got == want
    assert archive.payloads.count() == len(best)
    for r in warc.records(archive).where("page_id = 9").collect():
        assert bytes(r["record"]).endswith(("a\r\n\r\nb" * 400).encode() + b"\r\n\r\n") and bytes(r["record"]).startswith(b"WARC/1.1\r\n")
    assert warc.read_archive(warc.write_archive(table.where("false"))).count() == 0


def test_a_spoilt_payload_is_found(spark):
    archive = warc.write_archive(pages(spark))
    spoilt = warc.Archive(archive.headers, archive.payloads.withColumn("frame", warc.squeezed(F.lit(b"other"))))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spoilt).count()


def test_sharding_moves_rows_only_into_the_new_shard(spark, docs, no_docs):
    rows = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in rows)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.shard_documents(no_docs).count() == 0
    keys = np.arange(100_000)
    for n in (1, 2, 16, 1000):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert before.max() < n and set(after[after != before]) <= {n}
        assert abs((after != before).mean() - 1 / (n + 1)) < 0.01
    with pytest.raises(ValueError, match="at least 1"):
        sharding.shard_of(F.lit(1), 0)


def test_language_is_learned_and_defined_for_every_text(spark, docs, no_docs, sf_dir):
    known = common.read(spark, sf_dir, "documents")
    train, rest = known.where("doc_id % 2 = 0"), known.where("doc_id % 2 = 1")
    net = language.fit(train)
    judged = language.identify(rest, net).where("lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged)
    out = language.identify(docs, net)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert out.count() == docs.count() and out.columns[-2:] == ["lang_pred", "score"]
    assert all(rows[i] == ("und", 0.0) for i in (80, 81, 82, 83)) and all(0 <= s <= 1 for _, s in rows.values())
    assert language.identify(no_docs, net).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(no_docs)).collect()} == {"und"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 900), (900, 5), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), 1: 1, 900: 1, 5: 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_against_brute_force(spark, docs, sf_dir):
    import corpus_pipeline
    from test_text_operators import brute_components, brute_repeats

    stages = dict(corpus_pipeline.STAGES)
    raw = common.read(spark, sf_dir, "documents")
    kept = common.stored(stages["language ID"](spark, raw, sf_dir), "t0")
    assert kept.columns == raw.columns and 0.97 * raw.count() <= kept.count() <= raw.count()
    once = common.stored(stages["MinHash near-dedup"](spark, kept, sf_dir), "t1")
    components = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert {r["doc_id"] for r in once.collect()} == {c for _, _, c in components} and once.columns == raw.columns
    clean = common.stored(stages["suffix-array dedup"](spark, once, sf_dir), "t2")
    want = {i: sha for (i, _, _, _, sha) in brute_repeats([(r["doc_id"], r["text"]) for r in once.collect()])}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in clean.collect())
    packed = stages["best-fit packing"](spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
