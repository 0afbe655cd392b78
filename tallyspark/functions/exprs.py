"""Scalar expressions of the domain. A zero denominator gives null, never an error; null stands for a missing value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613
#: Share of free throws that end a possession.
FT_TRIP = 0.44


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clean(x: str | Column) -> Column:
    """NaN and infinities as null."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def shooting(prefix: str = "") -> dict[str, Column]:
    """Effective field goals, turnovers per possession used, and free throws per shot of one side's counts."""
    c = lambda x: F.col(f"{prefix}{x}")
    return {
        "efg_pct": ratio(c("fgm") + 0.5 * c("fg3m"), c("fga")),
        "tov_pct": ratio(c("tov"), c("fga") + FT_TRIP * c("fta") + c("tov")),
        "ft_rate": ratio(c("fta"), c("fga")),
    }


def four_factors() -> dict[str, Column]:
    """The eight factors of a paired team-game row, and the margin. Each side rebounds against the other's defence."""
    own, other = shooting(), shooting("opp_")
    out = {f"off_{k}": v for k, v in own.items()} | {f"def_{k}": v for k, v in other.items()}
    out["off_orb_pct"] = ratio("oreb", F.col("oreb") + F.col("opp_dreb"))
    out["def_orb_pct"] = ratio("opp_oreb", F.col("opp_oreb") + F.col("dreb"))
    out["margin"] = F.col("pts") - F.col("opp_pts")
    return out


def possessions(prefix: str = "") -> Column:
    c = lambda x: F.col(f"{prefix}{x}")
    return c("fga") + FT_TRIP * c("fta") - c("oreb") + c("tov")


def game_score(**names: str) -> Column:
    """A player's line in one number. Keyword arguments rename the counts."""
    n = lambda x: F.col(names.get(x, x))
    return n("pts") + 0.4 * n("fgm") - 0.7 * n("fga") - 0.4 * (n("fta") - n("ftm")) + 0.7 * n("oreb") + 0.3 * n("dreb") + n("stl") + 0.7 * n("ast") + 0.7 * n("blk") - 0.4 * n("pf") - n("tov")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would skip a null


def iso_clock_seconds(x: str | Column) -> Column:
    """Seconds of a clock such as PT06M43.00S, null if it is none."""
    part = lambda i: F.regexp_extract(col(x), r"^PT(\d+)M([\d.]+)S$", i)
    return F.when(part(1) != "", part(1).try_cast("double") * 60 + part(2).try_cast("double"))


def minutes_of(x: str | Column) -> Column:
    """Minutes of MM:SS, of a plain number, or of an ISO clock; null if it is none of them."""
    c = F.trim(col(x))
    parts = F.split(c, ":")
    pair = parts[0].try_cast("double") + F.try_element_at(parts, F.lit(2)).try_cast("double") / 60
    return F.coalesce(F.when(c.contains(":"), pair), iso_clock_seconds(c) / 60, c.try_cast("double"))


def season_start(season: str | Column) -> Column:
    return F.substring(col(season), 1, 4).cast("int")


def season_name(year: Column) -> Column:
    """2023 as 2023_24."""
    return F.concat(year.cast("string"), F.lit("_"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def season_of(date: str | Column, first_month: int = 7) -> Column:
    """The season of a date; seasons start in `first_month`."""
    c = col(date)
    return season_name(F.year(c) - (F.month(c) < first_month).cast("int"))


def season_shift(season: str | Column, years: int) -> Column:
    return season_name(season_start(season) + years)


def game_id_parts(game_id: str | Column, pivot: int = 90) -> dict[str, Column]:
    """Kind, start year and season of a 10-digit id: the third digit says the kind, the next two the year."""
    g = F.lpad(col(game_id), 10, "0")
    kind = {"1": "preseason", "2": "regular_season", "3": "all_star", "4": "playoffs", "5": "play_in"}
    name = F.lit(None).cast("string")
    for digit, word in kind.items():
        name = F.when(F.substring(g, 3, 1) == digit, word).otherwise(name)
    two = F.substring(g, 4, 2).cast("int")
    year = two + F.when(two >= pivot, 1900).otherwise(2000)
    return {"season_type": name, "start_year": year, "season": season_name(year)}


def name_key(x: str | Column) -> Column:
    """A name in lower case, without accents, points, apostrophes and a generation suffix."""
    plain = F.translate(F.lower(F.trim(col(x))), "áàâäãåçčćéèêëíìîïñóòôöõøšúùûüýžđģķņļ", "aaaaaaccceeeeiiiinoooooosuuuuyzdgknl")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[.'’]", ""), r"\s+(jr|sr|ii|iii|iv|v)$", ""))


def normal_cdf(z: str | Column) -> Column:
    """The normal distribution function, by a published rational approximation (error below 8e-8)."""
    c = col(z)
    t = 1 / (1 + 0.2316419 * F.abs(c))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-c * c / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(c >= 0, 1 - tail).otherwise(tail)


def win_probability(margin: str | Column, sigma: float, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(normal_cdf(col(margin) / sigma), F.lit(eps)), F.lit(1 - eps))


def logit_shift(p: str | Column, by: str | Column, eps: float = 1e-6) -> Column:
    """p moved by `by` on the logit scale."""
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + col(by))))


def decay(age: str | Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), col(age) / half_life)


def shot_zone(distance: str | Column, three: str | Column, deep: float = 27.0) -> Column:
    """rim, paint, mid, three or deep; a three-pointer is never anything else."""
    d = col(distance)
    return F.when(col(three) & (d >= deep), "deep").when(col(three), "three").when(d < 4, "rim").when(d < 14, "paint").otherwise("mid")


def shot_angle(x: str | Column, y: str | Column) -> Column:
    """Degrees off the base line, 0 to 90."""
    return F.degrees(F.atan2(F.abs(col(y)), F.abs(col(x))))


def first_match(text: str | Column, groups: dict[str, str], other: str = "other") -> Column:
    """The name of the first group whose substring is in the text."""
    out = F.lit(other)
    for name, part in reversed(groups.items()):
        out = F.when(F.lower(col(text)).contains(part), name).otherwise(out)
    return out


def bracket(x: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals: label i for edges[i] < x <= edges[i + 1], else null."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = F.when((col(x) > low) & (col(x) <= high), label).otherwise(out)
    return out
