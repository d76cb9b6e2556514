"""The choosers of the sampling queries: found once, in one pass over the lines."""

from pyspark.sql.types import LongType, StructField, StructType

from larkwing import queries as Q


def test_dearest_lines(spark, tmp_path):
    # ties of the price: the smallest order, then the smallest line; a repeated order, an order without lines, lines without an order
    lines = [(1, 1, 10, 5.0), (1, 2, 11, 7.0), (2, 1, 12, 7.0), (2, 2, 13, 1.0), (3, 2, 14, 9.0), (3, 1, 15, 9.0), (4, 1, 16, 3.0), (None, 1, 17, 99.0), (9, 1, 18, 99.0), (6, 1, 19, None)]
    orders = [(1, 100), (2, 100), (3, 101), (4, 102), (4, 102), (5, 103), (6, None), (None, 104)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, float(k)) for k in range(10, 20)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    who, alts = Q._supplier_choice(spark, str(tmp_path))
    assert who.schema == StructType([StructField("c_custkey", LongType()), StructField("choice", LongType())]) and alts.count() == 10
    assert sorted(who.collect(), key=str) == sorted([(100, 11), (101, 15), (102, 16), (None, 19)], key=str)
    # what reads them does not go through the lines again
    assert not any(word in who._jdf.queryExecution().optimizedPlan().toString() for word in ("lineitem", "Join", "Aggregate"))
