import re

import duckdb
import pytest

import __spark_entry__ as entry
from closura import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_like_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.select(*cols).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_does_not_need_the_corpus_operators():
    from pathlib import Path

    root = Path(catalog.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
