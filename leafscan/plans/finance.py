"""Queries: finance formulas over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscan.operators import finance as N
from leafscan.plans.base import query, r3, table


@query("i1_difference", "SELECT o_orderkey, round(o_totalprice - c_acctbal, 4) AS result FROM orders JOIN customer ON c_custkey = o_custkey")
def i1(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select("o_orderkey", F.round(N.difference(F.col("o_totalprice"), F.col("c_acctbal")), 4).alias("result"))


@query(
    "i2_list_sum",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n,
      round(sum(l_quantity + l_discount + l_tax), 4) AS result FROM lineitem GROUP BY ALL""",
)
def i2(spark, d):
    rows = table(spark, d, "lineitem").withColumn("s", N.list_sum(F.array("l_quantity", "l_discount", "l_tax")))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("result"))


@query(
    "i3_ratio",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice / l_quantity * 1000 + 0.50001) / 1000.0 AS ratio,
      CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax * 100, 4) END AS percent FROM lineitem""",
)
def i3(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r3(N.ratio(F.col("l_extendedprice"), F.col("l_quantity"))).alias("ratio"),
        F.round(N.percent(F.col("l_discount"), F.col("l_tax")), 4).alias("percent"),
    )


@query("i4_yoy_reverse", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / (1 + l_tax), 4) AS base FROM lineitem")
def i4(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(N.yoy_reverse(F.col("l_extendedprice"), F.col("l_tax")), 4).alias("base"),
    )


@query(
    "i5_bond_interest",
    """SELECT o_orderkey, floor(o_totalprice * 0.015 * date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) / 365 * 1000 + 0.50001) / 1000.0 AS interest FROM orders""",
)
def i5(spark, d):
    days = F.datediff("o_orderdate", F.lit("1990-01-01"))
    return table(spark, d, "orders").select(
        "o_orderkey", r3(N.bond_interest(F.col("o_totalprice"), F.lit(0.015), days)).alias("interest")
    )


@query(
    "i6_deductible_claim",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
      round(greatest(0, l_extendedprice - l_quantity * 100 - 20000) * (1 - l_discount), 4) AS payout FROM lineitem""",
)
def i6(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(
            N.deductible_claim(F.col("l_extendedprice"), F.lit(20000.0), F.col("l_quantity") * 100, 1 - F.col("l_discount")), 4
        ).alias("payout"),
    )


@query(
    "i7_calculate",
    """WITH t AS (SELECT o_orderkey AS k, o_orderkey % 8 AS m, o_totalprice AS p, o_custkey AS c FROM orders)
    SELECT k, CASE m WHEN 0 THEN round(p - c, 4) WHEN 1 THEN round(p + c, 4) WHEN 2 THEN CASE WHEN c % 7 = 0 THEN NULL ELSE round(p / (c % 7), 4) END
        WHEN 3 THEN round(p / 1.25, 4) WHEN 4 THEN round(p * 0.02 * 30 / 365, 4) WHEN 5 THEN round(greatest(0, p - 100000), 4) END AS result,
      CASE WHEN m = 2 AND c % 7 = 0 THEN 'denominator must not be zero' WHEN m = 6 THEN 'unsupported operation: median'
        WHEN m = 7 THEN 'b must be a number' END AS error FROM t""",
)
def i7(spark, d):
    ops = F.array(*[F.lit(x) for x in ("difference", "sum", "Ratio ", "yoy_reverse", "bond_interest", "deductible_claim", "median", "difference")])
    m, price, cust = F.col("o_orderkey") % 8, F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    params = (
        F.when(m == 0, F.create_map(F.lit("a"), price, F.lit("b"), cust))
        .when(m == 2, F.create_map(F.lit("numerator"), price, F.lit("denominator"), (F.col("o_custkey") % 7).cast("string")))
        .when(m == 3, F.create_map(F.lit("current"), price, F.lit("growth_rate"), F.lit("0.25")))
        .when(m == 4, F.create_map(F.lit("B"), price, F.lit("i"), F.lit("0.02"), F.lit("t"), F.lit("30")))
        .when(m == 5, F.create_map(F.lit("expense"), price, F.lit("deductible"), F.lit("100000")))
        .when(m == 7, F.create_map(F.lit("a"), price, F.lit("b"), F.lit("x")))
    )
    calls = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.element_at(ops, (m + 1).cast("int")).alias("operation"), params.alias("params"),
        F.when(m == 1, F.array(price, cust)).alias("values"),
    )
    return N.calculate(calls).select("k", F.round("result", 4).alias("result"), "error")
