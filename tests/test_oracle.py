"""Every registered query against its DuckDB statement."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fleetlens.plans import registry
from tools.check_queries import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for file in sorted(Path(SF).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def test_every_query_has_a_statement():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo_id", "language", "n_files"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, database, name):
    df = entry.queries()[name](spark, SF)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = database.execute(entry.oracle_sql()[name])
    assert ours == rows_of([c[0] for c in cursor.description], cursor.fetchall())
