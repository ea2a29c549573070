"""Every query against its SQL over the smallest data folder."""

import duckdb
import pytest
from assayer.plans import queries, records, shapes  # noqa: F401  (they register their queries)
from assayer.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection(sf_dir):
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return made


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, connection, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    assert rows
    if name in ORACLES:
        cursor = connection.execute(ORACLES[name])
        named = [c[0] for c in cursor.description]
        assert sorted(named) == columns
        assert sorted(repr(tuple(plain(r[named.index(c)]) for c in columns)) for r in cursor.fetchall()) == rows


def test_deep_documents_are_read_whole(spark, sf_dir):
    rows = QUERIES["depth_guard"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count() and {(r["refused"], r["nodes"]) for r in rows} == {(True, 0), (False, 101)}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 60
