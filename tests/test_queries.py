"""Every query against its SQL on a small scale factor."""

from __future__ import annotations

import pytest
from compare import difference, oracle

from tallyspark import plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, plans.QUERIES[name], plans.ORACLES[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_the_training_operators_are_apart():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "tallyspark").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), p
