import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from semclean.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(frame):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return ""
        if str(v) in ("True", "False"):
            return str(v)
        try:
            return repr(float(v))
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
