"""Stored tables: upserts, versions, checks."""

import os

import pytest

from lexmill.sources import stored

KINDS = "id long, name string, v double"


def rows_of(frame):
    return sorted(map(tuple, frame.select("id", "name", "v").collect()))


def test_upserts_versions_and_readers(spark, tmp_path):
    table = stored.KeyedTable(spark, str(tmp_path), "id")
    first = [(i, f"n{i}", float(i)) for i in range(300)]
    assert table.create(spark.createDataFrame(first, KINDS)) == 1
    reader = table.read()  # holds on to its version
    new = spark.createDataFrame([(5, "five", None), (900, "new", 1.0)], KINDS)
    assert table.upsert(new) == 2
    want = sorted([r for r in first if r[0] != 5] + [(5, "five", None), (900, "new", 1.0)])
    assert rows_of(table.read()) == want and rows_of(reader) == first and rows_of(table.read(1)) == first
    table.upsert(new)
    assert rows_of(table.read()) == want and table.versions() == [1, 2, 3]
    written = [f for f in os.listdir(f"{tmp_path}/data")]
    sizes = sorted(sum(x.startswith("bucket=") for x in os.listdir(f"{tmp_path}/data/{f}")) for f in written)
    assert sizes[:2] == [2, 2] and sizes[2] > 50  # an upsert of two keys writes two buckets
    table.prune(1)
    assert table.versions() == [3] and rows_of(table.read()) == want and len(os.listdir(f"{tmp_path}/data")) == 2


def test_what_may_not_be_stored(spark, tmp_path):
    table = stored.KeyedTable(spark, str(tmp_path), "id")
    for bad in ([(1, "a", 1.0), (1, "b", 1.0)], [(None, "a", 1.0)]):
        with pytest.raises(ValueError):
            table.create(spark.createDataFrame(bad, KINDS))
    assert table.versions() == []
    table.create(spark.createDataFrame([], KINDS))
    assert rows_of(table.read()) == []
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "a")], "id long, other string"))
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0)], KINDS))
    table.upsert(spark.createDataFrame([(1, "a", 1.0)], "id long, name string, v double").select("v", "name", "id"))
    assert rows_of(table.read()) == [(1, "a", 1.0)]


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    table = stored.KeyedTable(spark, str(tmp_path), "id")
    table.create(spark.createDataFrame([(1, "a", 1.0)], KINDS))
    broken = spark.createDataFrame([(2, "b", 1.0)], KINDS).selectExpr("id", "name", "IF(id = 2, raise_error('lost'), v) AS v").selectExpr("id", "name", "CAST(v AS double) AS v")
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.versions() == [1] and rows_of(table.read()) == [(1, "a", 1.0)]
