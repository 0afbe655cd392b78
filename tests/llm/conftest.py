from __future__ import annotations

import random

import pytest

#: Texts with nulls, empties, ties, repeats, very long ones, near copies, shared passages and characters of many kinds.


def made_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgilmnorstuéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(300), prose(70)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(1, 200))) for i in range(30)]
    rows += [(40, base), (41, base), (42, base.upper()), (43, base)]
    for i in range(50, 62):  # near copies, from light to heavy edits
        words = base.split()
        for _ in range(i - 49):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, f"{prose(40)}\n{passage}\n{prose(40)}") for i in range(70, 76)]
    rows += [(80, None), (81, ""), (82, "   \n\t "), (83, "12 34 !?"), (84, "a"), (85, "a b"), (86, "a b"), (87, "日本語 текст 😀 <|endoftext|> x"), (88, "é \x1c\x85\xa0   y\x00z")]
    rows += [(90, "ab" * 3000), (91, prose(9000)), (92, "x" * 49), (93, "x" * 50), (94, "x" * 51), (95, " leading  and trailing ")]
    rows += [(None, prose(60)), (7, prose(20)), (7, prose(20)), (96, base), (96, base)]
    return rows


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_bytes long, `key` string, score double"
    rows = [(i, x, "en" if k % 2 else None, f"s{k % 3}", len(x) if x else None, None, "clash", 0.5) for k, (i, x) in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
