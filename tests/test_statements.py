"""Registered queries against their SQL on tables made for what the given ones lack."""

import duckdb
import pytest

import __spark_entry__ as entry


def same_as_sql(spark, folder, name, **tables):
    """Whether the query returns the rows of its SQL over these tables (name: schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, expected = entry.queries()[name](spark, str(folder)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True).to_dict("records") for x in (got, expected))
    return a == b and len(a) > 0


@pytest.mark.parametrize("name", ["export_diagram", "export_polygons"])
def test_exports_round_as_their_sql(spark, tmp_path, name):
    prices = (65025.5, 64266.5, 64189.5, 16026.5, 16061.5)  # a thousandth of each is printed as a half, but is less
    rows = [(i, 5.0, p) for i, p in enumerate(prices)]
    assert same_as_sql(spark, tmp_path, name, lineitem=("l_orderkey long, l_quantity double, l_extendedprice double", rows[:1] + [(0, 9.0, rows[1][2])])), name
