"""The reference's tables re-derived from the shared driver tables.

``rates`` / ``transactions`` come from ``events``; ``trades`` joins the order tables.
The same definitions exist as DuckDB SQL in ``ledgerspark.plans.oracle`` so the two
engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.sources.readers import table


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "purchase")
              .select(F.col("user_id").alias("currency"),
                      F.col("ts").cast("date").alias("exchange_date"),
                      F.col("value").alias("exchange_rate")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type") == "click")
              .select(F.col("user_id").alias("currency"),
                      F.col("ts").cast("date").alias("trans_date"))
              .distinct())


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense-grid stress series: lineitem discount per supplier and ship day."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("key"),
                     F.col("l_shipdate").cast("date").alias("d"),
                     F.col("l_discount").alias("rate"))


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with trade-like fields; nulls injected by fixed key rules.

    The small tables are joined to each other first, and the part while the lines are narrow, so that the lines are
    shuffled twice at most.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = o.join(c.join(n, F.col("c_nationkey") == n.n_nationkey), F.col("o_custkey") == c.c_custkey)
    j = li.join(p, li.l_partkey == p.p_partkey).join(orders, li.l_orderkey == F.col("o_orderkey"))
    k = F.col("l_orderkey")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return j.select(
        "l_orderkey", "l_linenumber",
        F.col("c_name").alias("client"),
        F.col("l_linestatus").alias("leg_type"),
        _null_when(k % 97 == 0, F.col("p_type")).alias("product_name"),
        _null_when(k % 53 == 0, F.upper("p_type")).alias("product_group"),
        F.col("n_name").alias("currency"),
        F.col("n_regionkey").alias("office"),
        F.col("o_orderpriority").alias("risk"),
        F.col("o_orderstatus").alias("source_system"),
        F.col("l_shipdate").cast("date").alias("d"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("trade_date"),
        F.col("l_extendedprice").alias("notional"),
        (1 - F.col("l_discount")).alias("fx_rate"),
        F.when(k % 211 == 0, F.lit(0.0)).otherwise(net).alias("gbp"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
               & (F.col("l_discount") >= 0.09), 1).otherwise(0).alias("flag"),
    )
