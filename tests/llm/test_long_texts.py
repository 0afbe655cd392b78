"""Single texts that are longer than every slice and batch."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import language, packing, passages, pieces, repeats, telephony
from tallyspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(77)
    words = ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    first = prose(450_000)
    assert len(first) > 2_500_000
    return {1: first, 2: prose(50) + first[1_000_000:2_600_000] + prose(50), 3: "short"}


@pytest.fixture(scope="module")
def docs(spark, long_texts):
    return spark.createDataFrame([(k, x, "en") for k, x in long_texts.items()], "doc_id long, text string, lang string")


def test_tokens(docs, long_texts):
    import sentencepiece
    from tokenizers import Tokenizer

    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in pieces.encode_decode(docs, "doc_id", "text", tokenizer_path("piece_bpe_32k.model")).collect():
        ids = sp.encode(long_texts[r["doc_id"]])
        assert list(r["ids"]) == ids and r["decoded"] == sp.decode(ids)
    ids = {k: np.array([*bpe.encode(x, add_special_tokens=False).ids, 0], "<u4") for k, x in long_texts.items()}
    got = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))


def test_repeats_and_passages(docs, long_texts):
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    raw, first = long_texts[2].encode(), long_texts[1].encode()
    shared = long_texts[1][1_000_000:2_600_000].encode()
    at = raw.index(shared)
    assert got[1]["n_removed"] == got[3]["n_removed"] == 0 and got[2]["n_bytes"] == len(raw)
    a, b = at, at + len(shared)  # the stretch may go on by chance on either side
    while a and raw[a - 1 : a + 49] in first:
        a -= 1
    while b < len(raw) and raw[b - 49 : b + 1] in first:
        b += 1
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (b - a, 1) and got[2]["kept_sha256"] == hashlib.sha256(raw[:a] + raw[b:]).hexdigest()
    links = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(docs).collect()}
    assert links == {(2, 1)}


def test_media_and_language(docs, long_texts):
    for r in telephony.text_media(docs).collect():
        raw = long_texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192)
        assert (r["n_bytes"], r["payload_sha256"]) == (len(raw), hashlib.sha256(payload).hexdigest())
    net = language.train([b"the cat and the dog", b"le chat et le chien"] * 8, ["en", "fr"] * 8)
    for r in language.identify(docs, net).collect():
        want = language.predict(net, [long_texts[r["doc_id"]].encode()])[0]
        assert r["lang_pred"] == net.languages[int(want.argmax())] and r["score"] == pytest.approx(float(want.max()), abs=1e-9)
