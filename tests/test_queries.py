"""Every registered query beside its SQL counterpart, on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    if name not in oracle_sql():
        assert len(got) > 0
        return
    result = duck.execute(oracle_sql()[name])
    want = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert sorted(entry(spark).columns) == ["client_id", "reason_codes"]
    assert entry(spark).count() == 14
