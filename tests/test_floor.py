"""Substitutes whose family name two players have."""

from __future__ import annotations

import pytest

from tallyspark.operators import names as N
from tallyspark.operators import sequence as S

EVENTS = "game_id string, feed_pos long, period int, at double, kind string, side string, pid long, sub_name string, pts int"


@pytest.fixture(scope="module")
def floor(spark):
    """Home 1-5 with Williams (3) starting, Williams (6) and Foye (7) on the bench; away 11-15."""
    rows = [("g", k, 1, 5.0, "shot", "home" if p < 10 else "away", p, None, 2) for k, p in enumerate([1, 2, 3, 4, 5, 11, 12, 13, 14, 15])]
    rows += [
        ("g", 20, 1, 100.0, "sub", "home", 1, "Williams", 0),  # 3 is on the floor: it is 6
        ("g", 21, 1, 150.0, "shot", "home", 6, None, 3),
        ("g", 22, 1, 200.0, "sub", "home", 3, "Foye", 0),
        ("g", 23, 1, 300.0, "sub", "home", 2, "Williams", 0),  # now 3 is off it, and 6 is on
        ("g", 24, 1, 400.0, "shot", "home", 3, None, 2),
    ]
    roster = spark.createDataFrame([("g", "home", p, f, n, f"{f[0]}. {n}") for p, f, n in [(1, "A", "Ames"), (2, "B", "Bell"), (3, "Carl", "Williams"), (4, "D", "Dunn"), (5, "E", "East"), (6, "Zed", "Williams"), (7, "F", "Foye")]], "game_id string, side string, person_id long, first_name string, family_name string, name_i string")
    events = spark.createDataFrame(rows, EVENTS)
    mentions = N.resolved(events.where("sub_name is not null").selectExpr("game_id", "side", "feed_pos", "sub_name as name"), roster).selectExpr("game_id", "feed_pos", "person_id as sub_in", "candidates")
    return events.join(mentions, ["game_id", "feed_pos"], "left")


def test_who_is_off_the_floor_comes_in(floor):
    start = S.period_starters(floor)
    assert {r["pid"] for r in start.where("side = 'home'").collect()} == {1, 2, 3, 4, 5}
    got = [(r["start_at"], r["end_at"], r["home_lineup"]) for r in S.stints(floor, start).orderBy("stint_idx").collect()]
    assert got == [(0, 100, [1, 2, 3, 4, 5]), (100, 200, [2, 3, 4, 5, 6]), (200, 300, [2, 4, 5, 6, 7]), (300, 720, [3, 4, 5, 6, 7])]


def test_two_who_are_both_off_the_floor_cannot_be_told(spark, floor):
    """Without the first substitution both Williamses may sit when the second is made."""
    both_off = floor.where("feed_pos <> 20 and feed_pos <> 21")
    got = S.stints(both_off, S.period_starters(both_off))
    assert got.collect() == []
    audit = S.stint_audit(both_off, got).first()
    assert (audit["usable"], audit["seconds"]) == (False, 0.0)


def test_events_without_candidates_are_as_before(floor):
    plain = floor.drop("candidates")
    assert S.stints(plain, S.period_starters(plain)).collect() == []
