"""Every query with a twin in SQL equals it on a small scale."""

import os

import duckdb
import pytest
from feedloom.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def lines(rows):
    return sorted("|".join(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, db, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    twin = db.sql(ORACLES[name])
    assert sorted(twin.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    assert lines(map(tuple, df.select(*names).collect())) == lines(twin.select(quoted).fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
