from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest

from tallyspark import cli
from tallyspark.sources import boxscores as B
from tallyspark.sources import parts as P


def test_documents_and_optional_sources(spark, tmp_path):
    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("# A\n\nbody")
    (tmp_path / "d" / "x" / "b.md").write_text("b")
    (tmp_path / "d" / "c.txt").write_text("c")
    assert {(r["name"], r["text"]) for r in P.documents(spark, str(tmp_path / "d")).collect()} == {("a.md", "# A\n\nbody"), ("b.md", "b")}
    gone = P.optional(spark, str(tmp_path / "none.csv"), "a int, b string")
    assert gone.columns == ["a", "b"] and gone.count() == 0
    (tmp_path / "s.csv").write_text("a,b\n1,x\n")
    assert P.optional(spark, str(tmp_path / "s.csv"), "a int, b string").collect() == [(1, "x")]


def test_live_lines_replace_their_season(spark):
    schema = "team string, season string, total double, source string"
    history = spark.createDataFrame([("a", "2023_24", 40.0, "h"), ("a", "2024_25", 41.0, "h")], schema)
    live = spark.createDataFrame([("a", "2024_25", 50.0, "x"), ("a", "2024_25", 52.0, "y")], schema)
    assert sorted(map(tuple, P.combined_lines(history, live, ["team"], "season", "total").collect())) == [("a", "2023_24", 40.0), ("a", "2024_25", 51.0)]


def test_parts_are_made_once(spark, tmp_path):
    root, calls = str(tmp_path / "p"), []

    def make(name):
        calls.append(name)
        return spark.range(2)

    assert P.build_parts(spark, root, "season", ["a", "b"], make) == ["a", "b"]
    assert P.build_parts(spark, root, "season", ["a", "b", "c"], make) == ["c"] and calls == ["a", "b", "c"]
    assert spark.read.parquet(root).count() == 6


def test_parts_stop_at_their_budget(spark, tmp_path):
    ticks = iter([0.0, 0.0, 5.0, 11.0])
    made = P.build_parts(spark, str(tmp_path / "p"), "season", ["a", "b", "c"], lambda n: spark.range(1), 10.0, lambda: next(ticks))
    assert made == ["a", "b"] and P.build_parts(spark, str(tmp_path / "p"), "season", ["a", "b", "c"], lambda n: spark.range(1)) == ["c"]


def test_word_files_and_other_formats(spark, tmp_path):
    line = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{P.WORD[1:-1]}"><w:body>{line("Title", "Heading1")}{line("Body")}<w:p/></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no archive")
    assert {(r["name"], r["text"]) for r in P.word_documents(spark, str(tmp_path)).collect()} == {("a.docx", "# Title\n\nBody"), ("b.docx", None)}
    df = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "k long, v array<double>")
    for kind in ("csv", "json"):
        P.write_as(df.select("k"), str(tmp_path / kind), kind, ["k"])
        assert [r["k"] for r in spark.read.schema("k long").option("header", True).format(kind).load(str(tmp_path / kind)).orderBy("k").collect()] == [1, 2]
    P.write_arrays(df, str(tmp_path / "x.npz"), ["k", "v"])
    assert np.load(tmp_path / "x.npz")["v"].shape == (2, 2)
    with pytest.raises(ValueError, match="more than 1 rows"):
        P.write_arrays(df, str(tmp_path / "y.npz"), ["k"], 1)
    with pytest.raises(ValueError, match="unknown format"):
        P.write_as(df, str(tmp_path / "z"), "xls")


def log(path, games):
    headers = ["GAME_ID", "GAME_DATE", "MATCHUP", "TEAM_ID", "TEAM_ABBREVIATION", "FGM", "FGA", "FG3M", "FG3A", "FTM", "FTA", "OREB", "DREB", "TOV", "PTS"]
    rows = [[f"{g}", "2024-11-01", m, t, m[:3], 36, 80, 12, 33, 18, 25, 9, 31, 11, 102 + t] for g in games for t, m in enumerate(("KEL vs. ORN", "ORN @ KEL"))]
    path.write_text(json.dumps({"resultSets": [{"name": "LeagueGameLog", "headers": headers, "rowSet": rows}]}))


def test_commands_fill_what_is_missing(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    for season in ("2023_24", "2024_25"):
        log(tmp_path / "raw" / f"{season}.json", ["22400001"])
    out = str(tmp_path / "facts")
    fill = ["backfill", "--raw", str(tmp_path / "raw"), "--out", out, "--seasons", "2023_24", "2024_25"]
    assert cli.main(fill) == 0 and cli.main(fill) == 0 and capsys.readouterr().out == "made: 2023_24 2024_25\nmade: none\n"
    assert cli.main(["process", "--raw", str(tmp_path / "raw" / "2024_25.json"), "--out", str(tmp_path / "one"), "--season", "2024_25"]) == 0
    log(tmp_path / "raw" / "2024_25.json", ["22400001", "22400002"])
    more = ["incremental", "--raw", str(tmp_path / "raw" / "2024_25.json"), "--out", str(tmp_path / "one"), "--season", "2024_25"]
    assert cli.main(more) == 0 and cli.main(more) == 0 and capsys.readouterr().out == "games: 1\ngames: 0\n"
    assert spark.read.parquet(str(tmp_path / "one")).count() == 4


def test_commands_index_and_ask(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("# Rest\n\nTeams with two days of rest shoot better.\n\n# Travel\n\nLong flights cost points.")
    assert cli.main(["index", "--texts", str(tmp_path / "t"), "--index", str(tmp_path / "i")]) == 0
    assert cli.main(["ask", "--index", str(tmp_path / "i"), "--question", "What do flights cost?", "--k", "1"]) == 0
    assert capsys.readouterr().out.strip() == "[1] Long flights cost points.\n\nQuestion: What do flights cost?"


def test_a_season_can_be_dealt_over_files(spark, tmp_path):
    rows = [(f"{g:010}", __import__("datetime").date(2024, 11, 1), "2024_25", "regular_season", t, "A", t == 1, False, *[1] * 10) for g in range(40) for t in (1, 2)]
    df = spark.createDataFrame(rows, B.TEAM_SCHEMA)
    B.write_processed(df, str(tmp_path / "p"), dealt=4, rows=15)
    files = list((tmp_path / "p").rglob("*.parquet"))
    assert len(files) >= 6 and spark.read.parquet(str(tmp_path / "p")).count() == 80


def test_parameters_and_single_arrays_come_back(spark, tmp_path):
    values = {"weights": np.arange(6, dtype="<f4").reshape(2, 3), "base": np.float64(0.5), "names": ("a", "b"), "tree": {"cut": [1, 2], "empty": np.zeros((0, 2))}, "none": None}
    P.write_parameters(str(tmp_path / "m.json"), **values)
    got = P.read_parameters(str(tmp_path / "m.json"))
    assert np.array_equal(got["weights"], values["weights"]) and got["weights"].dtype == np.float32
    assert (got["base"], got["names"], got["tree"]["cut"], got["tree"]["empty"].shape, got["none"]) == (0.5, ["a", "b"], [1, 2], (0, 2), None)
    P.write_arrays(spark.createDataFrame([(1.0,), (2.0,)], "x double"), str(tmp_path / "x.npy"), ["x"])
    assert sorted(np.load(tmp_path / "x.npy").tolist()) == [1.0, 2.0]


def test_scans_read_the_columns_that_are_asked_for_and_push_filters(spark, sf_dir, capsys):
    from tallyspark import plans

    plans.QUERIES["j1_p1_four_factors"](spark, sf_dir).where("team_id = 5").explain("formatted")
    plan = capsys.readouterr().out
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("l_comment" not in x and "o_comment" not in x and "l_extendedprice" not in x for x in schemas)
    assert any("l_suppkey" in x and "l_quantity" in x for x in schemas) and "PushedFilters: [IsNotNull" in plan
