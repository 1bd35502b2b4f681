"""Exports with minutes of three digits, which only larger tables hold, against their SQL."""

import datetime

import duckdb

from leafmark import plans, registry  # noqa: F401
from leafmark.plans.source_queries import exported
from leafmark.sources import files

from . import compare


def orders_of_a_long_film(spark, folder):
    day = datetime.date(1996, 1, 1)
    spark.createDataFrame([(1, "O", "5-LOW", day), (2, "F", "1-URGENT", day)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    rows = [(1, 2, 19371, 832, "N", "O"), (1, 1, 5, 9, "R", "F"), (2, 2, 59, 3, "A", "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")


def test_exports_with_minutes_of_three_digits(spark, tmp_path):
    orders_of_a_long_film(spark, tmp_path)
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    t = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    assert any("[S832, 322:51]" in r["markdown"] for r in files.export_runs(*exported(t)).collect())
    for name in ("a17_export_runs", "a17_export_sections"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(registry.ORACLE_SQL[name])
        names, want = [d[0] for d in cur.description], cur.fetchall()
        assert compare.rows_of(got.columns, got.collect()) == compare.rows_of(names, want)
