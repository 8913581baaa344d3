"""The driver's contract, and rules that hold for the whole package."""

import ast
import os
import re

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
DATA = "/root/testdata/sf0.001"


def sources(folder="wayweft"):
    for at, _, files in os.walk(os.path.join(ROOT, folder)):
        for f in sorted(files):
            if f.endswith(".py"):
                yield os.path.relpath(os.path.join(at, f), ROOT), open(os.path.join(at, f), encoding="utf-8").read()


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    assert all(f"p{n}_found" in queries for n in (1, 2, 3, 4, 5)) and len(queries) > 50
    assert all(k in queries for k in entry.data_queries.QUERIES)


def test_nothing_outside_imports_the_subpackage():
    for path, text in sources():
        if f"{os.sep}llm{os.sep}" in path:
            continue
        for node in ast.walk(ast.parse(text)):
            found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in name.split(".") for name in found), path


def test_forbidden_calls():
    for path, text in sources():
        assert not re.search(r"\.(localCheckpoint|crossJoin|toPandas|rdd)\b", text), path


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["snap_date", "id", "change_kind"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found", "p5_report", "ref_g8_interpolate", "ref_w5_split_at_junctions", "ref_j3_isolated_seeds", "ref_n10_rlis_names"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    a = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    b = sorted(str(tuple(r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert a == b
