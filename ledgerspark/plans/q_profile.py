"""Profiling queries (G4: A10-A25, O5-O7) on the ``trades`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import profile
from ledgerspark.plans import trade_fixture as tf
from ledgerspark.plans.catalog import register
from ledgerspark.plans.oracle import with_fixtures


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _t(spark, sf):
    return tf.trades(spark, sf)


@register("value_counts", "A11 A10", with_fixtures("""
SELECT product_name, CAST(count(*) AS BIGINT) AS n FROM trades GROUP BY product_name""", "trades"))
def q_value_counts(spark, sf):
    return profile.value_counts(_t(spark, sf), "product_name")


@register("distinct_values", "A10 O3", with_fixtures("SELECT DISTINCT risk FROM trades", "trades"))
def q_distinct_values(spark, sf):
    return _t(spark, sf).select("risk").distinct().orderBy("risk")


@register("crosstab_margins", "A14", with_fixtures("""
SELECT source_system, flag, CAST(count(*) AS BIGINT) AS n,
       CAST(grouping(source_system) AS INTEGER) AS is_row_margin, CAST(grouping(flag) AS INTEGER) AS is_col_margin
FROM trades GROUP BY CUBE (source_system, flag)""", "trades"))
def q_crosstab_margins(spark, sf):
    return profile.crosstab_margins(_t(spark, sf), "source_system", "flag")


@register("crosstab_margins_nulls", "A14 P8", with_fixtures("""
SELECT product_name, flag, CAST(count(*) AS BIGINT) AS n,
       CAST(grouping(product_name) AS INTEGER) AS is_row_margin, CAST(grouping(flag) AS INTEGER) AS is_col_margin
FROM trades GROUP BY CUBE (product_name, flag)""", "trades"))
def q_crosstab_margins_nulls(spark, sf):
    return profile.crosstab_margins(_t(spark, sf), "product_name", "flag")


@register("crosstab_pivot", "A15", with_fixtures("""
SELECT currency, CAST(count(*) FILTER (WHERE risk = '1-URGENT') AS BIGINT) AS urgent,
       CAST(count(*) FILTER (WHERE risk <> '1-URGENT') AS BIGINT) AS other,
       CAST(count(*) FILTER (WHERE risk IS NULL) AS BIGINT) AS "null" FROM trades GROUP BY currency""", "trades"))
def q_crosstab_pivot(spark, sf):
    p = profile.crosstab_pivot(_t(spark, sf), "currency", "risk", ["1-URGENT"])
    return p.withColumnRenamed("1-URGENT", "urgent")


@register("crosstab_pivot_found", "A15", with_fixtures("""
WITH v AS (SELECT DISTINCT 'office_' || coalesce(CAST(office AS VARCHAR), 'null') AS cell FROM trades UNION SELECT 'office_null'),
k AS (SELECT DISTINCT currency FROM trades),
n AS (SELECT currency, 'office_' || coalesce(CAST(office AS VARCHAR), 'null') AS cell, count(*) AS n FROM trades GROUP BY ALL)
SELECT k.currency, v.cell, CAST(coalesce(n.n, 0) AS BIGINT) AS n
FROM k CROSS JOIN v LEFT JOIN n ON n.currency = k.currency AND n.cell = v.cell""", "trades"))
def q_crosstab_pivot_found(spark, sf):
    p = profile.crosstab_pivot(_t(spark, sf), "currency", "office", prefix="office_")
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("n")) for c in p.columns if c != "currency"])
    return p.select("currency", F.explode(cells).alias("c")).select("currency", "c.cell", "c.n")


@register("crosstab_share", "A16", with_fixtures("""
WITH c AS (SELECT risk, flag, count(*) AS n, grouping(risk) AS gr, grouping(flag) AS gf
           FROM trades GROUP BY CUBE (risk, flag))
SELECT risk, flag, CAST(n AS BIGINT) AS n, CAST(gr AS INTEGER) AS is_row_margin, CAST(gf AS INTEGER) AS is_col_margin,
       round(n / (SELECT count(*) FROM trades), 6) AS share
FROM c""", "trades"))
def q_crosstab_share(spark, sf):
    return profile.crosstab_share(tf.stored_trades(spark, sf, "risk", "flag"), "risk", "flag").withColumn("share", _r("share"))


@register("crosstab_by_office", "A17", with_fixtures("""
SELECT office, currency, flag, CAST(count(*) AS BIGINT) AS n,
       CAST(grouping(currency) AS INTEGER) AS is_row_margin, CAST(grouping(flag) AS INTEGER) AS is_col_margin
FROM trades GROUP BY GROUPING SETS ((office, currency, flag), (office, currency), (office, flag), (office))""",
                                                         "trades"))
def q_crosstab_by_office(spark, sf):
    return profile.crosstab_by_partition(_t(spark, sf), "office", "currency", "flag")


_NUM = ["notional", "fx_rate", "gbp"]


@register("describe_numeric", "A18", with_fixtures("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 5) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM trades""" for c in _NUM),
                                                   "trades"))
def q_describe_numeric(spark, sf):
    d = profile.describe_numeric(tf.stored_trades(spark, sf, *_NUM), _NUM)
    # the mean is shown to 5 places: a sum of many doubles is exact only to ~1e-12,
    # which can flip a 6th-place tie between engines
    return d.select("column", "count", _r("mean", 5).alias("mean"),
                    *[_r(c).alias(c) for c in ("std", "min", "p25", "p50", "p75", "max")])


_CAT = ["source_system", "leg_type", "product_name", "product_group", "currency", "risk", "client"]


_CAT_SQL = ("WITH long AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM trades" for c in _CAT) + """),
f AS (SELECT "column", value, count(*) AS freq FROM long WHERE value IS NOT NULL GROUP BY "column", value),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY freq DESC, value ASC) AS rn FROM f)
SELECT "column", CAST(sum(freq) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique,
       max(CASE WHEN rn = 1 THEN value END) AS top, CAST(max(freq) AS BIGINT) AS freq
FROM r GROUP BY \"column\"""")


@register("describe_categorical", "A19", with_fixtures(_CAT_SQL, "trades"))
def q_describe_categorical(spark, sf):
    return profile.describe_categorical(_t(spark, sf), _CAT)


@register("describe_dates", "A20", with_fixtures("""
WITH x AS (SELECT CAST(d - DATE '1970-01-01' AS INTEGER) AS day FROM trades)
SELECT CAST(count(day) AS BIGINT) AS count, round(avg(day), 6) AS mean_day, CAST(min(day) AS DOUBLE) AS min_day,
       CAST(max(day) AS DOUBLE) AS max_day, round(quantile_cont(day, 0.25), 6) AS p25_day,
       round(quantile_cont(day, 0.5), 6) AS p50_day, round(quantile_cont(day, 0.75), 6) AS p75_day FROM x""",
                                               "trades"))
def q_describe_dates(spark, sf):
    d = profile.describe_dates(tf.stored_trades(spark, sf, "d"), "d")
    return d.select("count", _r("mean_day").alias("mean_day"), "min_day", "max_day",
                    *[_r(c).alias(c) for c in ("p25_day", "p50_day", "p75_day")])


def _hist_sql(col: str, bins: int, src: str = "trades") -> str:
    return f"""
WITH x AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) END + 1 AS INTEGER)
             AS bin, lo, hi FROM x, b)
SELECT bin, CAST(count(*) AS BIGINT) AS n, round(min(lo) + (min(hi) - min(lo)) * (bin - 1) / {bins}, 6) AS lower
FROM h GROUP BY bin"""


@register("histogram", "A23", with_fixtures(_hist_sql("gbp", 10), "trades"))
def q_histogram(spark, sf):
    return profile.histogram(tf.stored_trades(spark, sf, "gbp"), "gbp", 10).withColumn("lower", _r("lower"))


@register("client_histogram", "A23 E6", with_fixtures("""
WITH c AS (SELECT client, count(*) AS num_transactions FROM trades GROUP BY client)""" +
                                                      _hist_sql("num_transactions", 100, "c").replace("WITH", ",", 1),
                                                      "trades"))
def q_client_histogram(spark, sf):
    c = _t(spark, sf).groupBy("client").agg(F.count(F.lit(1)).alias("num_transactions"))
    return profile.histogram(c, "num_transactions", 100).withColumn("lower", _r("lower"))


@register("percentile_cuts", "A24", with_fixtures("""
SELECT round(quantile_cont(gbp, 0.10), 6) AS p10, round(quantile_cont(gbp, 0.80), 6) AS p80,
       round(quantile_cont(gbp, 0.95), 6) AS p95, round(quantile_cont(gbp, 0.99), 6) AS p99 FROM trades""",
                                                  "trades"))
def q_percentile_cuts(spark, sf):
    p = profile.percentile_cuts(tf.stored_trades(spark, sf, "gbp"), "gbp")
    return p.select(*[_r(c).alias(c) for c in p.columns])


@register("trades_per_day", "A12", with_fixtures("""
SELECT d, CAST(count(*) AS BIGINT) AS n FROM trades WHERE d IS NOT NULL GROUP BY d""", "trades"))
def q_trades_per_day(spark, sf):
    return profile.count_per_date(_t(spark, sf), "d")


@register("flagged_per_day", "A12 P6", with_fixtures("""
SELECT d, CAST(count(*) AS BIGINT) AS n FROM trades WHERE d IS NOT NULL AND flag = 1 GROUP BY d""", "trades"))
def q_flagged_per_day(spark, sf):
    return profile.count_per_date(_t(spark, sf), "d", F.col("flag") == 1)


@register("calendar_coverage", "A13 F2", with_fixtures("""
SELECT min(d) AS first_date, max(d) AS last_date, CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS span_days,
       CAST(count(DISTINCT d) AS BIGINT) AS num_dates,
       CAST(date_diff('day', min(d), max(d)) + 1 - count(DISTINCT d) AS BIGINT) AS missing_dates FROM trades""",
                                                    "trades"))
def q_calendar_coverage(spark, sf):
    c = profile.calendar_coverage(_t(spark, sf), "d")
    return c.withColumn("missing_dates", F.col("missing_dates").cast("bigint"))


_CS = """WITH c AS (SELECT client AS client_name, CAST(count(*) FILTER (WHERE flag = 1) AS BIGINT) AS num_flags,
                  CAST(count(*) AS BIGINT) AS num_transactions,
                  count(*) FILTER (WHERE flag = 1) / count(*) AS ratio FROM trades GROUP BY client)
SELECT client_name, num_flags, num_transactions, round(ratio, 6) AS ratio FROM c ORDER BY {order} LIMIT 15"""


def _client_top(spark, sf, order):
    from ledgerspark.operators.features import client_summary
    s = client_summary(_t(spark, sf), "client", "flag")
    return profile.top_k(s, order, 15).select("client_name", "num_flags", "num_transactions",
                                              _r("ratio").alias("ratio"))


@register("top_clients_by_ratio", "O5 E6", with_fixtures(_CS.format(order="ratio DESC, client_name"), "trades"))
def q_top_clients_by_ratio(spark, sf):
    return _client_top(spark, sf, [F.col("ratio").desc(), F.col("client_name")])


@register("top_clients_by_flags", "O5", with_fixtures(_CS.format(order="num_flags DESC, client_name"), "trades"))
def q_top_clients_by_flags(spark, sf):
    return _client_top(spark, sf, [F.col("num_flags").desc(), F.col("client_name")])


@register("top_clients_by_transactions", "O5",
          with_fixtures(_CS.format(order="num_transactions DESC, client_name"), "trades"))
def q_top_clients_by_transactions(spark, sf):
    return _client_top(spark, sf, [F.col("num_transactions").desc(), F.col("client_name")])


@register("shape", "A22", with_fixtures("""
SELECT CAST(count(*) AS BIGINT) AS num_rows, 16 AS num_columns FROM trades""", "trades"))
def q_shape(spark, sf):
    return profile.shape(_t(spark, sf))


_ALL = ("l_orderkey, l_linenumber, client, leg_type, product_name, product_group, currency, office, risk, "
        "source_system, d, trade_date, notional, fx_rate, gbp, flag")


@register("head_rows", "O6 O4", with_fixtures(f"SELECT {_ALL} FROM trades ORDER BY {_ALL} LIMIT 5", "trades"))
def q_head_rows(spark, sf):
    t = _t(spark, sf)
    return profile.head(t, t.columns, 5)


@register("tail_rows", "O6", with_fixtures(
    f"SELECT {_ALL} FROM trades ORDER BY " + ", ".join(c.strip() + " DESC" for c in _ALL.split(",")) + " LIMIT 3",
    "trades"))
def q_tail_rows(spark, sf):
    t = _t(spark, sf)
    return profile.tail(t, t.columns, 3)


_SAMPLE = ["l_orderkey", "l_linenumber", "client", "currency", "notional", "gbp", "flag"]


@register("sample_rows", "O7", with_fixtures(f"""
SELECT {", ".join(_SAMPLE)} FROM trades
ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), {", ".join(c + " NULLS FIRST" for c in _SAMPLE)} LIMIT 15""", "trades"))
def q_sample_rows(spark, sf):
    return profile.sample_rows(_t(spark, sf).select(*_SAMPLE), 15, seed=7, key_cols=["l_orderkey", "l_linenumber"])
