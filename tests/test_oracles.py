"""Every query of the engine against its SQL on DuckDB, row by row."""

import math

import duckdb
import pytest

from kinfold.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return f"{float(value):.6f}" if isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    rel = db.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted([plain(row[names.index(c)]) for c in columns] for row in rel.fetchall())
    assert got == want
    assert got or name == "authority_id"
