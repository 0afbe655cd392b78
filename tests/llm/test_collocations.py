from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import collocations


def brute(rows, longest, least, top):
    """The contract in plain Python: rows of (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = []
        frequent = {p: v for p, v in f.items() if v >= least}
        covered = {q for p, v in frequent.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if f[q := p[i : i + m]] <= v}
        for p, a in frequent.items():
            if len(p) > 1 and p not in covered:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, phrase.decode(), -a, x, y, n, -score) for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(rng, n):
    words = ["the", "of", "New", "york", "city", "a", "b", "Ärger", "日本", "x y", "z\x1cq"]
    marks = [" "] * 12 + [". ", ",", "\n", "\t", " \t ", "!?", ": ", "\x0b", "\x0c", "\r\n"]
    return "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    rows = [(rng.choice(["en", "de", None]), made(rng, rng.randint(0, 120))) for _ in range(60)]
    copy = "Once upon a time there was a very small house by the sea"
    rows += [("en", copy)] * 7 + [("de", None), ("de", ""), ("fr", " \t "), ("fr", "one two one two one two one two"), ("und", "the of the of the of the of a b a b")]
    return rows + [("en", "no no no no no no no no. No no")]


@pytest.mark.parametrize(("bits", "together"), [(29, 2_000_000), (7, 300)])
def test_equals_brute_force(spark, rows, bits, together):
    """With few bits nearly every phrase is let through; with small slices every text is cut at marks. The rows are the same."""
    docs = spark.createDataFrame([(i, lang, text, 1, 2) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, `key` long, a long").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, 5, 4, 2000, most_bits=bits, together=together).collect()))
    assert got == brute(rows, 5, 4, 2000) and len(got) > 50


def test_ties_at_the_last_place(spark, rows):
    docs = spark.createDataFrame([(lang, text) for lang, text in rows], "lang string, text string")
    for top in (1, 5):
        assert sorted(map(tuple, collocations.collocations(docs, 3, 3, top).collect())) == brute(rows, 3, 3, top)


def test_long_text_without_marks_and_empty_tables(spark):
    text = "a bb ccc " * 400 + ". " + "dd e " * 300
    docs = spark.createDataFrame([("en", text), (None, None)], "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 5, 100, 2000, together=200).collect())) == brute([("en", text)], 5, 100, 2000)
    assert collocations.collocations(docs.where("false")).collect() == []
    assert collocations.collocations(docs.where("lang is null")).collect() == []


def test_counts_past_64_bits():
    """1000 * a * n and l * r are decimals: 1000 * 1e12 * 1e13 over 1e12 * 1e12."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    big = 1_000_000_000_003
    level = spark.createDataFrame([("en", 5, 1, 2, big, [big + 9, big], [big + 7, big])], "lang string, key long, first long, last long, a long, heads array<long>, tails array<long>")
    totals = spark.createDataFrame([("en", 10_000_000_000_007)], "lang string, n long")
    row = collocations.scored(totals, [level, level]).first()
    assert row["score"] == 1000 * big * 10_000_000_000_007 // ((big + 9) * (big + 7)) and (row["l"], row["r"]) == (big + 9, big + 7)
