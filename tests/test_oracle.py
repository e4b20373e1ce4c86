"""Every registered query with SQL gives DuckDB's rows on the small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in names) for r in df.collect())
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(c) for c in names]
    assert ours == Counter(tuple(r[i] for i in at) for r in relation.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
