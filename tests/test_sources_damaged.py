"""Untidy files whose first lines can't be read in part."""

import os

import duckdb
import pytest
from oracle import assert_same, run_sql

from tidewatt.queries import ORACLE_SQL, QUERIES
from tidewatt.sources import tables

SF = "/root/testdata/sf0.01"
HEADER = ["TIMESTAMP", "PRICE", "ORDERS", "COMMENT"]


def test_damaged_rows_are_no_header():
    above, good = [["Станция", "ПС-2"], ["высота", "12"], []], ["01.02.2021 00:00", "1,5", "7", "день 032"]
    for bad in (["нет", "1,5", "5", "день 033"], ["01.02.2021 00:00", "сбой", "3", "день 034"], ["нет", "сбой", "33", "день 035"]):
        assert tables.guess_header_row([*above, HEADER, bad, good, good]) == 3
        assert tables.guess_header_row([*above, HEADER, good, bad, good, good]) == 3
        assert tables.guess_header_row([*above, HEADER, *[bad] * 60]) == 3
    assert tables.guess_header_row([["latitude", "longitude"], ["52.5", "13.4"], [], ["time", "temp"], ["2021-01-01T00:00", "1"], ["2021-01-01T01:00", "2"]]) == 3


def test_time_column_whose_first_values_cannot_be_read(spark):
    df = spark.createDataFrame([("нет" if i < 60 else "01.02.2021 00:00", "x") for i in range(300)], "t string, n string").coalesce(1)
    assert not tables.looks_like_time(df, "t") and tables.find_time(df) == "t"
    assert tables.find_time(df.select("n")) is None and tables.find_time(df.limit(90)) is None


@pytest.mark.parametrize("name", ["source_untidy", "source_info", "source_preview"])
def test_six_times_the_orders(spark, tmp_path, name):
    for t in os.listdir(SF):
        if t != "orders.parquet":
            os.symlink(f"{SF}/{t}", tmp_path / t)
    duckdb.sql(f"COPY (SELECT o.* REPLACE (o_orderkey + 1000000 * i AS o_orderkey) FROM '{SF}/orders.parquet' o, range(6) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert_same(QUERIES[name](spark, str(tmp_path)).toPandas(), run_sql(ORACLE_SQL[name], str(tmp_path)))
