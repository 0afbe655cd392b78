"""A registry of named queries, and the SQL views that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TEAM = """
two AS (SELECT l_orderkey, min(l_suppkey) AS home FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND min(l_suppkey) <> max(l_suppkey)),
lines AS (
    SELECT l.l_orderkey AS o, l.l_suppkey AS s, home, CAST(o_orderdate AS DATE) AS game_date, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q,
           CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
    FROM lineitem l JOIN two USING (l_orderkey) JOIN orders ON o_orderkey = l.l_orderkey
),
counted AS (
    SELECT *, 28 + p % 25 AS c_fgm, 70 + q % 30 AS c_fga, 5 + d AS c_fg3m, 20 + q % 20 AS c_fg3a, least(10 + p % 21, 8 + t) AS c_ftm,
           10 + p % 21 AS c_fta, p % 17 AS c_oreb, 20 + q % 23 AS c_dreb, p % 19 AS c_tov FROM lines
),
team AS (
    SELECT lpad(CAST(o AS VARCHAR), 10, '0') AS game_id, game_date,
           CAST(y AS VARCHAR) || '_' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, 'regular_season' AS season_type,
           s AS team_id, 'T' || CAST(s AS VARCHAR) AS team_abbr, (s = home AND o % 40 <> 7) AS is_home, (o % 40 = 7) AS is_neutral,
           CAST(u * c_fgm AS BIGINT) AS fgm, CAST(u * c_fga AS BIGINT) AS fga, CAST(u * c_fg3m AS BIGINT) AS fg3m, CAST(u * c_fg3a AS BIGINT) AS fg3a,
           CAST(u * c_ftm AS BIGINT) AS ftm, CAST(u * c_fta AS BIGINT) AS fta, CAST(u * c_oreb AS BIGINT) AS oreb, CAST(u * c_dreb AS BIGINT) AS dreb,
           CAST(u * c_tov AS BIGINT) AS tov, CAST(u * (2 * c_fgm + c_fg3m + c_ftm) AS BIGINT) AS pts
    FROM (SELECT *, CASE WHEN o % 50 <> 0 THEN 1 ELSE 0 END AS u, CAST(year(game_date) - CASE WHEN month(game_date) < 7 THEN 1 ELSE 0 END AS INTEGER) AS y FROM counted)
),
paired AS (
    SELECT a.*, b.team_id AS opp_team_id, b.team_abbr AS opp_team_abbr, b.fgm AS opp_fgm, b.fga AS opp_fga, b.fg3m AS opp_fg3m, b.fg3a AS opp_fg3a,
           b.ftm AS opp_ftm, b.fta AS opp_fta, b.oreb AS opp_oreb, b.dreb AS opp_dreb, b.tov AS opp_tov, b.pts AS opp_pts
    FROM team a JOIN team b ON a.game_id = b.game_id AND a.team_id <> b.team_id
),
fact AS (
    SELECT *, (fgm + 0.5 * fg3m) / nullif(fga, 0) AS off_efg_pct, tov / nullif(fga + 0.44 * fta + tov, 0) AS off_tov_pct,
           oreb / nullif(oreb + opp_dreb, 0) AS off_orb_pct, fta / nullif(fga, 0) AS off_ft_rate,
           (opp_fgm + 0.5 * opp_fg3m) / nullif(opp_fga, 0) AS def_efg_pct, opp_tov / nullif(opp_fga + 0.44 * opp_fta + opp_tov, 0) AS def_tov_pct,
           opp_oreb / nullif(opp_oreb + dreb, 0) AS def_orb_pct, opp_fta / nullif(opp_fga, 0) AS def_ft_rate, pts - opp_pts AS margin
    FROM paired
),
live AS (
    SELECT *, off_efg_pct - def_efg_pct AS efg_d, off_orb_pct - def_orb_pct AS oreb_d, def_tov_pct - off_tov_pct AS tov_d, off_ft_rate - def_ft_rate AS ftr_d,
           ftm / nullif(fga, 0) - opp_ftm / nullif(opp_fga, 0) AS ftmfga_d,
           ((fga + 0.44 * fta - oreb + tov) + (opp_fga + 0.44 * opp_fta - opp_oreb + opp_tov)) / 2 AS pace
    FROM fact WHERE NOT (pts = 0 AND opp_pts = 0)
)
"""

PLAYER = """
log AS (
    SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS game_id, CAST(ts AS DATE) AS game_date, ts,
           CASE WHEN ts < TIMESTAMP '2024-01-16' THEN '2023_24' ELSE '2024_25' END AS season, user_id % 30 AS team_id, event_id % 2 = 0 AS is_home,
           user_id AS person_id, CASE event_type WHEN 'error' THEN 'inactive' WHEN 'signup' THEN 'dnp_coach' ELSE 'played' END AS status,
           CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(10 + CAST(props->>'$.k' AS INTEGER) % 30 AS INTEGER) END AS minutes,
           CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(round(value * 100) AS BIGINT) END AS score
    FROM events
)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL that says the same where there is some."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def with_team(sql: str) -> str:
    return f"WITH {TEAM} {sql}"


def with_player(sql: str) -> str:
    return f"WITH {PLAYER} {sql}"


def ols_sql(source: str, by: str, features: list[str], tag: str = "") -> str:
    """SQL tables after which `ols` (its name begins with `tag`) has `by`, factor, beta, se, n of least squares on `source` (`by`, x: target, 1, features).

    Sums of products in long form; sweeping all other columns out of them by self-joins leaves a coefficient and its
    precision, sweeping out all of them the squared errors.
    """
    last = len(features) + 2
    tables = [f"{tag}z AS (SELECT {by}, i, j, sum(x[i] * x[j]) AS v, count(*) AS n FROM {source}, range(1, {last + 1}) AS a(i), range(1, {last + 1}) AS b(j) GROUP BY {by}, i, j)"]

    def swept(table: str, columns: list[int], name: str) -> str:
        for step, k in enumerate(columns):
            now = f"{tag}{name}_{step}"
            tables.append(
                f"{now} AS (SELECT a.{by}, a.i, a.j, a.v - p.v * q.v / d.v AS v FROM {table} a JOIN {table} p ON p.{by} = a.{by} AND p.i = a.i AND p.j = {k} JOIN {table} q ON q.{by} = a.{by} AND q.i = a.j AND q.j = {k} "
                f"JOIN {table} d ON d.{by} = a.{by} AND d.i = {k} AND d.j = {k} WHERE a.i <> {k} AND a.j <> {k})"
            )
            table = now
        return table

    rest = swept(f"{tag}z", list(range(2, last + 1)), "rest")
    parts = []
    for k, factor in enumerate(["intercept", *features], 2):
        own = swept(f"{tag}z", [c for c in range(2, last + 1) if c != k], f"of_{k}")
        parts.append(f"SELECT a.{by}, '{factor}' AS factor, a.v / b.v AS beta, sqrt(greatest(r.v, 0) / greatest(c.n - {last - 1}, 1) / b.v) AS se, c.n FROM {own} a JOIN {own} b ON b.{by} = a.{by} AND b.i = {k} AND b.j = {k} JOIN {rest} r ON r.{by} = a.{by} JOIN {tag}z c ON c.{by} = a.{by} AND c.i = 1 AND c.j = 1 WHERE a.i = 1 AND a.j = {k}")
    return ", ".join([*tables, f"{tag}ols AS ({' UNION ALL '.join(parts)})"])
