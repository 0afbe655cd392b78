"""Near passages among texts that repeat one word many times."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyspark.llm import passages

WIDTH, PERCENT = 46, 80


def runs(*parts: tuple[int, int]) -> np.ndarray:
    """Tokens: each of (token, times)."""
    return np.concatenate([np.full(n, token, np.uint32) for token, n in parts])


def counted_walks(monkeypatch) -> list:
    calls, walk = [], passages.walked
    monkeypatch.setattr(passages, "walked", lambda *args: calls.append(args) or walk(*args))
    return calls


def members(texts: list[np.ndarray], place: int) -> pa.Table:
    n = len(texts)
    columns = {"value": [7] * n, "asks": [True] * n, "linked": [False] * n, "lab": [0] * n, "own": [0] * n, "i": [0] * n, "j": [0] * n, "doc": range(n), "batch": range(n), "nth": [0] * n, "c": [place] * n, "a": [0] * n}
    return pa.table({k: pa.array(v) for k, v in columns.items()} | {"tokens": pa.array([t.tobytes() for t in texts], pa.binary())})


def test_a_class_that_shares_a_run_too_short_for_a_passage_is_not_walked(monkeypatch):
    calls = counted_walks(monkeypatch)
    texts = [runs((100 * k + 1, 40), *((100 * k + j, 1) for j in range(2, 6)), (7, 42), *((100 * k + j, 1) for j in range(6, 10)), (100 * k + 10, 40)) for k in range(1, 21)]
    out = passages.class_passages(WIDTH, PERCENT)(members(texts, 60))
    assert out.num_rows == 0 and not calls


def test_a_class_that_shares_a_long_run_is_still_joined():
    texts = [runs(*((100 * k + j, 1) for j in range(1, 10)), (7, 60 + k), *((100 * k + j, 1) for j in range(10, 20))) for k in range(1, 21)]
    out = passages.class_passages(WIDTH, PERCENT)(members(texts, 40)).to_pydict()
    group = list(range(20))
    for x, y in zip(out["doc"], out["other"], strict=True):
        group = [group[y] if g == group[x] else g for g in group]
    assert len(set(group)) == 1 and min(out["similarity"]) >= PERCENT / 100


def test_passages_are_those_of_the_walks():
    rng, some = np.random.default_rng(5), 0
    for _ in range(1500):
        words = rng.integers(2, 30)
        mine = runs(*((int(t), int(n)) for t, n in zip(rng.integers(0, words, 12), rng.choice([1, 1, 2, 5, 20, 45, 60], 12), strict=True)))[:200]
        theirs = mine.copy() if rng.random() < 0.5 else runs(*((int(t), int(n)) for t, n in zip(rng.integers(0, words, 12), rng.choice([1, 1, 2, 5, 20, 45, 60], 12), strict=True)))[:200]
        swapped = rng.integers(0, len(theirs), int(rng.integers(0, 15)))
        theirs[swapped] = rng.integers(50, 90, len(swapped))
        want = passages.in_step(mine, theirs, WIDTH, PERCENT)
        if want is None:
            want = passages.walked(mine, theirs, WIDTH, PERCENT) or [(x, y, a, b, j) for a, b, x, y, j in passages.walked(theirs, mine, WIDTH, PERCENT)]
        some += bool(want)
        assert passages.alike(mine, theirs, WIDTH, PERCENT) == want
    assert 150 < some < 1400
