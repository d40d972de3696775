"""Untidy files of which most cells can't be read, or that hold no rows, and means of many prices."""

import os
import random
from fractions import Fraction

import duckdb
import pytest
from oracle import assert_same, run_sql

from tidewatt import queries
from tidewatt.sources import tables

SF = "/root/testdata/sf0.001"
TIMES = "SELECT o.* REPLACE (o_orderkey + 1000000 * i AS o_orderkey) FROM '{SF}/orders.parquet' o, range({n}) r(i)"


def orders(folder, sql: str) -> str:
    for t in os.listdir(SF):
        if t != "orders.parquet":
            os.symlink(f"{SF}/{t}", folder / t)
    duckdb.sql(f"COPY ({sql}) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


# Of 3 orders a day most prices can't be read, of 12 most times. Then no day, a day whose time is lost, one whose price is.
@pytest.mark.parametrize("sql", [*(TIMES.format(SF=SF, n=n) for n in (3, 12)), f"FROM '{SF}/orders.parquet' LIMIT 0", *(f"SELECT * REPLACE (TIMESTAMP '1995-03-04' AS o_orderdate) FROM '{SF}/orders.parquet' LIMIT {n}" for n in (12, 13))])
def test_most_cells_lost(spark, tmp_path, sql):
    sf = orders(tmp_path, sql)
    assert_same(queries.QUERIES["source_untidy"](spark, sf).toPandas(), run_sql(queries.ORACLE_SQL["source_untidy"], sf))


@pytest.mark.parametrize("seed", [0, 4, 8, 9])
def test_mean_next_to_a_tie(spark, tmp_path, seed):
    """37 prices, each 3,000 times: the mean and what is added before rounding are 5e-10 below a tie."""
    rng = random.Random(seed)
    cents = [rng.randrange(100_000, 50_000_000) for _ in range(37)]
    cents[0] += (24 - sum(cents)) % 37
    prices = ", ".join(f"({c}::DOUBLE / 100)" for c in cents)
    sf = orders(tmp_path, f"SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, p AS o_totalprice, TIMESTAMP '1995-03-04' AS o_orderdate, '1' AS o_orderpriority FROM range(3000) r(i), (VALUES {prices}) v(p)")
    assert queries.daily(spark, sf).first().price == round((Fraction(sum(cents), 3700) + Fraction("1.3e-8")) * 10**6) / 10**6


def test_time_column_by_its_name(spark):
    df = spark.createDataFrame([("нет" if i < 60 else "01.02.2021 00:00", "x", "20210201") for i in range(90)], "`Дата и время` string, n string, time string")
    assert tables.find_time(df) == "Дата и время" and tables.find_time(df.select("n", "time")) is None


def test_header_above_no_or_lost_rows():
    above = [["Станция", "ПС-2"], ["высота", "12"], [], ["TIMESTAMP", "PRICE", "ORDERS", "COMMENT"]]
    assert tables.guess_header_row(above) == tables.guess_header_row([*above, ["нет", "1,5", "5", "день 033"]]) == 3
