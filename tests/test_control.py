from __future__ import annotations

import pytest

from tallyspark import cli
from tallyspark.sources import control as C


def test_progress(tmp_path):
    p = C.Progress.load(tmp_path / "none.json")
    p.mark_schedule("completed")
    p.mark_game("box", "2", False)
    p.mark_game("box", "1", True)
    assert p.pending("box", ["1", "2"]) == ["2"] and not p.complete("box", ["1", "2"])
    p.mark_game("box", "2", True)
    p.save(tmp_path / "a" / "p.json")
    again = C.Progress.load(tmp_path / "a" / "p.json")
    assert again == p and again.complete("box", ["1", "2"]) and again.games["box"]["failed"] == []
    assert [x.name for x in (tmp_path / "a").iterdir()] == ["p.json"]
    with pytest.raises(ValueError, match="unknown state"):
        p.mark_schedule("started")


def test_raw_paths():
    assert str(C.raw_path("r", "box", "2024_25", "regular_season", "22400001")) == "r/box/2024_25/regular_season/0022400001.json"
    with pytest.raises(ValueError, match="not a game id"):
        C.raw_path("r", "box", "2024_25", "regular_season", "../x")


def limiter(**x):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    return C.RateLimiter(jitter=0.0, clock=lambda: now[0], sleep=sleep, **x), slept, now


def test_rate_limit():
    lim, slept, now = limiter(limit=3, seconds=60)
    for _ in range(7):
        lim.acquire()
    assert slept == [0, 0, 0, 60, 0, 0, 60] and now[0] == 120


def test_retries():
    lim, slept, _ = limiter(limit=100)
    answers = iter([(429, {}), TimeoutError(), (200, {"ok": 1})])

    def get(endpoint, params):
        assert list(params) == ["a", "b"]
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert C.fetch(get, "log", {"b": 1, "a": 2}, lim) == {"ok": 1}
    assert [s for s in slept if s] == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="status 404"):
        C.fetch(lambda e, p: (404, {}), "log", {}, lim)


def test_command_line(spark, tmp_path):
    assert cli.main(["query", "--name", "s23_missing_games", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert cli.main(["query", "--name", "nothing", "--tables", "x", "--out", "y"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["process"])
