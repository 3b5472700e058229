"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from reelwork.plans.registry import ORACLE, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return str(float(v)) and f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, database, name):
    df = QUERIES[name](spark, str(FOLDER))
    cursor = database.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in row) for row in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0
