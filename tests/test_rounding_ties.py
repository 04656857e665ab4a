"""Prices whose share is a tie at the fourth digit are rounded as the SQL rounds them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from eventide.plans import catalogue


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """Tables of orders at all ties up to 500,000, one line item each."""
    sf = str(tmp_path_factory.mktemp("ties"))
    n = spark.range(10000).select(F.col("id").alias("k"))
    day = F.timestamp_seconds(F.lit(800000000) + F.col("k") * 86400)
    n.select(F.col("k").alias("o_orderkey"), (F.col("k") % 40).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (F.col("k") * 50.0 + 25).alias("o_totalprice"), day.alias("o_orderdate")).write.parquet(f"{sf}/orders.parquet")
    n.select(F.col("k").alias("l_orderkey"), (F.col("k") % 97).alias("l_partkey"), (F.col("k") % 31).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(7.0).alias("l_quantity"), F.lit(0.06).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.element_at(F.array(*map(F.lit, "ANR")), (F.col("k") % 3 + 1).cast("int")).alias("l_returnflag")).write.parquet(f"{sf}/lineitem.parquet")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return sf, con


@pytest.mark.parametrize("name", ["q_api_events", "q_explanation_rows", "q_grounded_claims", "q_profile_rank"])
def test_ties(spark, ties, name):
    sf, con = ties
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLE_SQL[name])
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
