"""Rows that share a position."""

import duckdb

from evalgate.operators import sampling as D
from evalgate.plans.catalog import ORACLES, QUERIES

from .oracle import normal


def test_rows_of_one_position_have_one_order(spark):
    rows = [(1, 5, "b", 9), (1, 5, "a", 2), (1, 5, "a", 9), (1, 7, "c", 1), (1, 5, "c", 4)]
    found = []
    for part in (rows, rows[::-1], rows[2:] + rows[:2]):
        inputs = spark.createDataFrame([(*r, 25) for r in part], "k long, position long, segment string, samples long, total long").coalesce(1)
        found.append(sorted((r.first_index, r.segment, r.samples, r.group_index) for r in D.segment_groups(inputs, ["k"], "total").collect()))
    assert found[0] == [(0, "a", 2, 0), (2, "c", 4, 0), (6, "a", 9, 0), (15, "b", 9, 0), (24, "c", 1, 0)]
    assert found[1] == found[0] and found[2] == found[0]


def test_rows_of_one_position_stay_in_table_order(spark, tmp_path):
    rows = [(k, 7, 1, flag, quantity) for k in range(40) for flag, quantity in (("R", 30.0), ("A", float(k % 5)), ("N", 12.0), ("A", float(4 + k % 3)))]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = QUERIES["d8_segment_groups"](spark, str(tmp_path)).toPandas()
    assert len(got) > 40 and normal(got) == normal(con.execute(ORACLES["d8_segment_groups"]).df())
