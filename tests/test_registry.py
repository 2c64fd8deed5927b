import ast
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kinsieve.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(rows):
    return sorted((tuple(None if x != x else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(f"select {', '.join(names)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(names).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "kinsieve").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "kinsieve").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_the_entry_works_without_the_text_operators(monkeypatch):
    monkeypatch.setattr(entry, "_has", lambda name: False)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)
    assert "kinsieve.plans.catalogue" in sys.modules


def test_public_names():
    import kinsieve

    assert all(getattr(kinsieve, name) is not None for name in kinsieve.__all__)
    with pytest.raises(AttributeError):
        kinsieve.nothing  # noqa: B018
