"""Data-quality queries (Q1, Q4, Q5, Q11, Q12, E10) on the trade fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import quality
from ledgerspark.plans import trade_fixture as tf
from ledgerspark.plans.catalog import register
from ledgerspark.plans.oracle import with_fixtures

TRADE_COLS = ["l_orderkey", "l_linenumber", "client", "leg_type", "product_name", "product_group", "currency",
              "office", "risk", "source_system", "d", "trade_date", "notional", "fx_rate", "gbp", "flag"]


def _null_audit_sql(cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls FROM trades"
             for c in cols]
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE nulls > 0"


@register("null_audit", "Q1 P8", with_fixtures(_null_audit_sql(TRADE_COLS), "trades"))
def q_null_audit(spark, sf):
    return quality.null_audit(tf.trades(spark, sf))


@register("fd_violations", "Q4", with_fixtures("""
SELECT product_name, CAST(count(DISTINCT product_group) AS BIGINT) AS num_values FROM trades
WHERE product_name IS NOT NULL AND product_group IS NOT NULL
GROUP BY product_name HAVING count(DISTINCT product_group) > 1""", "trades"))
def q_fd_violations(spark, sf):
    return quality.fd_violations(tf.trades(spark, sf), "product_name", "product_group")


@register("fd_violations_office", "Q4", with_fixtures("""
SELECT office, CAST(count(DISTINCT currency) AS BIGINT) AS num_values FROM trades
WHERE office IS NOT NULL AND currency IS NOT NULL
GROUP BY office HAVING count(DISTINCT currency) > 1""", "trades"))
def q_fd_violations_office(spark, sf):
    return quality.fd_violations(tf.trades(spark, sf), "office", "currency")


@register("amount_consistency", "Q5 F13 A21", with_fixtures("""
WITH p AS (SELECT coalesce(abs(notional * fx_rate - gbp) / nullif(gbp, 0) < 0.001, false) AS ok FROM trades)
SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS num_pass, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS num_fail
FROM p""", "trades"))
def q_amount_consistency(spark, sf):
    return quality.amount_consistency(tf.trades(spark, sf), "notional", "fx_rate", "gbp")


@register("bad_dates", "Q11 F3", with_fixtures("""
SELECT CAST(count(*) FILTER (WHERE trade_date IS NOT NULL AND try_strptime(trade_date, '%d/%m/%Y') IS NULL) AS BIGINT)
         AS num_bad,
       CAST(count(*) FILTER (WHERE trade_date IS NULL) AS BIGINT) AS num_missing
FROM trades""", "trades"))
def q_bad_dates(spark, sf):
    return quality.bad_dates(tf.trades(spark, sf), "trade_date")


@register("low_amounts", "Q12 P7", with_fixtures("""
SELECT l_orderkey, l_linenumber, round(notional, 6) AS notional, round(gbp, 6) AS gbp FROM trades
WHERE gbp < 0.5 OR notional < 0.5""", "trades"))
def q_low_amounts(spark, sf):
    t = quality.low_amounts(tf.trades(spark, sf), ["gbp", "notional"])
    return t.select("l_orderkey", "l_linenumber", F.round("notional", 6).alias("notional"),
                    F.round("gbp", 6).alias("gbp"))


def _constant_sql(cols: list[str]) -> str:
    parts = [f"""SELECT '{c}' AS column, CASE WHEN min({c}) IS NULL THEN 0 WHEN min({c}) = max({c}) THEN 1 ELSE 2 END
       AS num_values FROM trades""" for c in cols]
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE num_values <= 1"


_CONST_COLS = TRADE_COLS + ["const_leg"]


@register("constant_columns", "E10", with_fixtures(
    _constant_sql(_CONST_COLS).replace("FROM trades", "FROM (SELECT *, 'OTC' AS const_leg FROM trades)"), "trades"))
def q_constant_columns(spark, sf):
    # a deliberately single-valued column stands in for the reference's one-valued leg type
    t = tf.trades(spark, sf).withColumn("const_leg", F.lit("OTC"))
    return quality.constant_columns(t).withColumn("num_values", F.col("num_values").cast("int"))
