"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import bag

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"max_temp_directory_size": "2GB"})
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    got = bag(frame.columns, frame.collect())
    assert got
    if name in contract.oracle_sql():
        result = duck.execute(contract.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert got == bag(names, result.fetchall())
