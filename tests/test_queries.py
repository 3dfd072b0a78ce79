"""Every query that SQL can express gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from tallyroom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or str(value) in ("<NA>", "nan", "NaT"):
        return None
    if isinstance(value, float) or type(value).__name__ in ("float32", "float64", "Decimal"):
        return round(float(value), 9)
    if type(value).__name__.startswith("bool"):
        return bool(value)
    if type(value).__name__.startswith(("int", "uint")):
        return int(value)
    return value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


def test_every_query_has_its_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


def test_most_texts_are_truncated(spark, duck):
    """All texts of four lines lose some, not only those of thirty."""
    lines = "len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END"
    four = duck.execute(f"SELECT count(*) FROM documents WHERE {lines} >= 4").fetchall()[0][0]
    assert catalogue.queries()["truncate_lines"](spark, SF).where("cut").count() == four > 100
