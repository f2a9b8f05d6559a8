"""Job B cleaning and feature queries (G5) on the ``trades`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import features as fe
from ledgerspark.operators import quality
from ledgerspark.plans import trade_fixture as tf
from ledgerspark.plans.catalog import register
from ledgerspark.plans.oracle import with_fixtures

KEYS = ["l_orderkey", "l_linenumber"]


def _r(c, n=6):
    return F.round(F.col(c), n)


def _sql(body: str) -> str:
    return with_fixtures("WITH " + tf.CLEAN_SQL + "\n" + body, "trades")


@register("impute_group", "P14 I5 F14 S9", _sql("""
SELECT l_orderkey, l_linenumber, product_name, product_group_i AS product_group FROM c0"""))
def q_impute_group(spark, sf):
    t = fe.impute_group(tf.trades(spark, sf), "product_name", "product_group", tf.GROUP_MAP)
    return t.select(*KEYS, "product_name", "product_group")


@register("product_type", "E1 J1", _sql("SELECT l_orderkey, l_linenumber, product_name, product_type FROM c0"))
def q_product_type(spark, sf):
    t = fe.product_type(tf.trades(spark, sf), "product_name", tf.TYPE_MAP)
    return t.select(*KEYS, "product_name", "product_type")


@register("currency_reduced", "E2 J1", _sql("""
SELECT t.l_orderkey, t.l_linenumber, t.currency, cm.v AS currency_reduced
FROM trades t LEFT JOIN cmap cm ON cm.k = t.currency"""))
def q_currency_reduced(spark, sf):
    t = fe.currency_reduced(tf.trades(spark, sf), "currency", tf.CURRENCY_MAP)
    return t.select(*KEYS, "currency", "currency_reduced")


@register("date_features", "E3 F3 F4 F5 F6 F7 F8 F9 F10", _sql("""
SELECT l_orderkey, l_linenumber, trade_date, date, CAST(month(date) AS INTEGER) AS month,
       day(date) = 1 AS is_month_start, last_day(date) = date AS is_month_end,
       CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(quarter(date) AS INTEGER) AS quarter,
       isodow(date) - 1 >= 5 AS is_weekend, day(date) > 27 AS near_month_end, day(date) < 3 AS near_month_begin
FROM c0"""))
def q_date_features(spark, sf):
    t = fe.date_features(tf.trades(spark, sf), "trade_date", extra=True)
    return t.select(*KEYS, "trade_date", "date", "month", "is_month_start", "is_month_end", "weekday", "quarter",
                    "is_weekend", "near_month_end", "near_month_begin")


@register("log_amount", "E4 F11 Q3", _sql("""
SELECT l_orderkey, l_linenumber, round(log10(gbp), 6) AS gbp_log_amount FROM trades WHERE gbp >= 0.01"""))
def q_log_amount(spark, sf):
    t = quality.nonzero_amount_rows(tf.trades(spark, sf), "gbp")
    t = fe.log_amount(t, "gbp")
    return t.select(*KEYS, _r("gbp_log_amount").alias("gbp_log_amount"))


@register("log_amount_floored", "P15 F11", _sql("""
SELECT l_orderkey, l_linenumber, round(log10(greatest(coalesce(gbp, 0.01), 0.01)), 6) AS gbp_log_amount
FROM trades"""))
def q_log_amount_floored(spark, sf):
    t = fe.log_amount(tf.trades(spark, sf), "gbp", floor=0.01)
    return t.select(*KEYS, _r("gbp_log_amount").alias("gbp_log_amount"))


@register("amount_bucket", "E5 A24", _sql("""
, cuts AS (SELECT quantile_cont(gbp, 0.10) AS q0, quantile_cont(gbp, 0.80) AS q1,
                  quantile_cont(gbp, 0.95) AS q2, quantile_cont(gbp, 0.99) AS q3 FROM trades)
SELECT l_orderkey, l_linenumber, round(gbp, 6) AS gbp,
       CAST((gbp >= q0)::INT + (gbp >= q1)::INT + (gbp >= q2)::INT + (gbp >= q3)::INT AS INTEGER) AS amount_bucket
FROM trades, cuts""".replace("\n, cuts", ",\ncuts", 1)))
def q_amount_bucket(spark, sf):
    t = fe.amount_bucket(tf.stored_trades(spark, sf, *KEYS, "gbp"), "gbp")
    return t.select(*KEYS, _r("gbp").alias("gbp"), F.col("amount_bucket").cast("int").alias("amount_bucket"))


@register("client_summary", "E6 J11 P11 A25", _sql("""
SELECT client_name, num_flags, num_transactions, round(ratio, 6) AS ratio FROM csum"""))
def q_client_summary(spark, sf):
    s = tf.clean(spark, sf).client_summary
    return s.select("client_name", "num_flags", "num_transactions", _r("ratio").alias("ratio"))


@register("client_flags", "E7 P17", _sql("""
SELECT client_name, new_client, frequent_client, suspicious_client, trusted_client FROM cflags"""))
def q_client_flags(spark, sf):
    s = tf.clean(spark, sf).client_summary
    return s.select("client_name", "new_client", "frequent_client", "suspicious_client", "trusted_client")


@register("client_history_asof", "E9", with_fixtures("""
WITH daily AS (SELECT client, d, count(*) AS n, count(*) FILTER (WHERE flag = 1) AS f FROM trades GROUP BY client, d),
hist AS (SELECT client, d,
                coalesce(sum(n) OVER (PARTITION BY client ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_trades,
                coalesce(sum(f) OVER (PARTITION BY client ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_flags
         FROM daily)
SELECT t.l_orderkey, t.l_linenumber, t.client, t.d, CAST(h.prior_trades AS BIGINT) AS prior_trades,
       CAST(h.prior_flags AS BIGINT) AS prior_flags
FROM trades t JOIN hist h ON t.client = h.client AND t.d = h.d""", "trades"))
def q_client_history_asof(spark, sf):
    h = fe.client_history_asof(tf.trades(spark, sf), "client", "d", "flag")
    return h.select(*KEYS, "client", "d", "prior_trades", "prior_flags")


_CLEAN_COLS = ["l_orderkey", "l_linenumber", "office", "risk", "source_system", "flag", "product_type", "date",
               "month", "is_month_start", "is_month_end", "weekday", "quarter", "gbp_log_amount",
               "currency_reduced", "client_name", "suspicious_client", "trusted_client", "new_client",
               "frequent_client"]


@register("clean_rows", "G5 E8 Q2 Q3 P4 P10", _sql("SELECT * REPLACE (round(gbp_log_amount, 6) AS gbp_log_amount) FROM clean"))
def q_clean_rows(spark, sf):
    c = tf.clean(spark, sf).clean
    return c.select(*[(_r(x).alias(x) if x == "gbp_log_amount" else F.col(x)) for x in _CLEAN_COLS])


@register("incomplete_rows", "Q2 P9", _sql("SELECT * REPLACE (round(gbp, 6) AS gbp) FROM incomplete"))
def q_incomplete_rows(spark, sf):
    c = tf.clean(spark, sf).incomplete
    return c.withColumn("gbp", _r("gbp"))


@register("zero_amount_rows", "Q3 P7", _sql("SELECT * REPLACE (round(gbp, 6) AS gbp) FROM zero_amount"))
def q_zero_amount_rows(spark, sf):
    c = tf.clean(spark, sf).zero_amount
    return c.withColumn("gbp", _r("gbp"))
