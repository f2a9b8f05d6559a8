"""Sources and sinks (S1-S8): rows are written to a fresh path of the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.plans import jobs
from ledgerspark.plans import trade_fixture as tf
from ledgerspark.plans.catalog import register
from ledgerspark.plans.oracle import with_fixtures
from ledgerspark.plans.q_imputation import _AUGMENTED
from ledgerspark.session import scratch_path
from ledgerspark.sources import fixtures as fx
from ledgerspark.sources import readers, writers

_KEYS = "l_orderkey, l_linenumber"


@register("clean_round_trip", "S4 S5 G5", with_fixtures(f"WITH {tf.CLEAN_SQL}\nSELECT {_KEYS}, product_type, flag FROM clean", "trades"))
def q_clean_round_trip(spark, sf):
    folder = scratch_path(spark, "cleaned")
    jobs.clean_to(tf.clean(spark, sf, store=jobs.stored), folder)
    return readers.read_parquet(spark, f"{folder}/clean", ["l_orderkey", "l_linenumber", "product_type", "flag"])


@register("quarantine_round_trip", "S3 S6 Q2", with_fixtures(
    f"WITH {tf.CLEAN_SQL}\nSELECT {_KEYS}, client, product_type, flag FROM incomplete", "trades"))
def q_quarantine_round_trip(spark, sf):
    path = scratch_path(spark, "incomplete")
    rows = tf.clean(spark, sf).incomplete
    writers.write_quarantine(rows, path)
    back = readers.read_delimited(spark, path, rows.schema, sep=",", columns=["l_orderkey", "l_linenumber", "client", "product_type", "flag"])
    return back


@register("ordered_export", "S1 S2 S7 O1 G1", with_fixtures(f"""WITH {_AUGMENTED}
SELECT transaction_date, currency, round(exchange_rate, 6) AS exchange_rate, is_imputed,
       CAST(row_number() OVER (ORDER BY transaction_date, currency) AS BIGINT) AS line FROM augmented""", "daily", "transactions"))
def q_ordered_export(spark, sf):
    """The line number comes from the files: their order by name, the split of the file, the line in the split."""
    path = scratch_path(spark, "export")
    out = jobs.impute_rates(fx.transactions(spark, sf), fx.rates(spark, sf), export_to=path)
    schema = T.StructType([T.StructField("transaction_date", T.DateType()), T.StructField("currency", out.schema["currency"].dataType),
                           T.StructField("exchange_rate", T.DoubleType()), T.StructField("is_imputed", T.IntegerType())])
    rows = readers.read_delimited(spark, path, schema, columns=["transaction_date", "currency", "exchange_rate", "is_imputed"])
    # rank by the key within the file order: a file that breaks the order would show as a wrong line
    from ledgerspark.operators.ranking import global_row_number
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"))
    return global_row_number(rows, ["file", "block", "at"], "line").select(
        "transaction_date", "currency", F.round("exchange_rate", 6).alias("exchange_rate"), "is_imputed",
        F.col("line").cast("long").alias("line"))


@register("replaced_table", "S8", with_fixtures(
    "SELECT currency, exchange_date, round(exchange_rate, 6) AS exchange_rate FROM daily", "daily"))
def q_replaced_table(spark, sf):
    from ledgerspark.operators import timeseries as ts
    name = f"daily_{uuid.uuid4().hex}"  # a name of its own: runs do not meet
    writers.replace_table(spark.range(1), name, scratch_path(spark, "table"))
    t = writers.replace_table(ts.daily_mean(fx.rates(spark, sf)), name, scratch_path(spark, "table"))
    return t.select("currency", "exchange_date", F.round("exchange_rate", 6).alias("exchange_rate"))


@register("sparse_imputation", "G2 I2 W5", with_fixtures(f"""WITH need AS (
  SELECT trans_date, currency FROM transactions t
  WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.currency = t.currency AND d.exchange_date = t.trans_date)),
u AS (SELECT currency, exchange_date AS day, exchange_rate, 0 AS imputed FROM daily
      UNION ALL SELECT currency, trans_date, NULL, 1 FROM need),
f AS (SELECT currency, day, imputed, last_value(exchange_rate IGNORE NULLS) OVER (
        PARTITION BY currency ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS rate FROM u)
SELECT t.trans_date AS transaction_date, t.currency, round(f.rate, 6) AS exchange_rate, f.imputed AS is_imputed
FROM transactions t LEFT JOIN f ON f.currency = t.currency AND f.day = t.trans_date""", "daily", "transactions"))
def q_sparse_imputation(spark, sf):
    out = jobs.impute_rates(fx.transactions(spark, sf), fx.rates(spark, sf), strategy="sparse")
    return out.withColumn("exchange_rate", F.round("exchange_rate", 6))


_NUM, _CAT = ["notional", "fx_rate", "gbp"], ["source_system", "risk", "product_name", "currency"]
_COLS = tf.COLS
_ALL = ["l_orderkey", "l_linenumber", "client", "leg_type", "product_name", "product_group", "currency", "office", "risk",
        "source_system", "d", "trade_date", "notional", "fx_rate", "gbp", "flag"]


def _facts_sql() -> str:
    def say(c):
        return f"coalesce(CAST({c} AS VARCHAR), '(null)')"

    def moments(c, item, section, std=True):
        own = [("count", f"count({c})"), ("mean", f"avg({c})"), *([("std", f"stddev_samp({c})")] if std else []), ("min", f"min({c})"),
               *[(f"p{q}", f"quantile_cont({c}, {q / 100})") for q in (25, 50, 75)], ("max", f"max({c})")]
        return [f"SELECT '{section}', '{item}', '{m}', CAST({e} AS DOUBLE) FROM t" for m, e in own]

    parts = ["SELECT 'shape' AS section, 'table' AS item, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM t",
             f"SELECT 'shape', 'table', 'columns', CAST({len(_ALL)} AS DOUBLE)"]
    parts += [f"SELECT 'nulls', '{c}', 'n', count(*) - count({c}) FROM t" for c in _ALL]
    parts += [f"SELECT 'frequency', '{c}=' || {say(c)}, 'n', count(*) FROM t GROUP BY {c}" for c in _CAT]
    a, b = _CAT[:2]
    parts.append(f"""SELECT 'margins', CASE WHEN grouping({a}) = 1 THEN 'All' ELSE {say(a)} END || ' x ' ||
        CASE WHEN grouping(flag) = 1 THEN 'All' ELSE CAST(flag AS VARCHAR) END, 'n', count(*) FROM t GROUP BY CUBE ({a}, flag)""")
    parts += [f"SELECT 'pivot', {say(b)}, 'flag {f}', count(*) FILTER (WHERE flag = {f}) FROM t GROUP BY {b}" for f in (0, 1)]
    for c in _NUM:
        parts += moments(c, c, "numeric")
    parts += moments("date_diff('day', DATE '1970-01-01', d)", "d", "dates", std=False)
    for c in _CAT:
        top = f"(SELECT CAST({c} AS VARCHAR) FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"
        most = f"max((SELECT max(n) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})))"
        parts += [f"SELECT 'categorical', '{c} top ' || {top}, '{m}', {e} FROM t"
                  for m, e in (("count", f"count({c})"), ("unique", f"count(DISTINCT {c})"), ("freq", most))]
    parts += ["SELECT 'per_day', CAST(d AS VARCHAR), 'n', count(*) FROM t WHERE d IS NOT NULL GROUP BY d"]
    parts += [f"SELECT 'calendar', 'd', '{m}', {e} FROM t" for m, e in (
        ("days", "count(DISTINCT d)"), ("span", "date_diff('day', min(d), max(d))"), ("missing", "date_diff('day', min(d), max(d)) + 1 - count(DISTINCT d)"))]
    parts.append("""SELECT 'dependency', 'product_name/product_group', 'violations', count(*) FROM (
        SELECT product_name FROM t WHERE product_name IS NOT NULL AND product_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT product_group) > 1)""")
    ok = "coalesce(abs(notional * fx_rate - gbp) / nullif(gbp, 0) < 0.001, FALSE)"
    parts += [f"SELECT 'consistency', 'gbp', 'pass', count(*) FILTER (WHERE {ok}) FROM t", f"SELECT 'consistency', 'gbp', 'fail', count(*) FILTER (WHERE NOT {ok}) FROM t"]
    parts.append("SELECT 'low amounts', 'rows', 'n', count(*) FILTER (WHERE notional < 0.5 OR gbp < 0.5) FROM t")
    parts += [f"SELECT 'top clients', client, '{m}', CAST({m} AS DOUBLE) FROM top" for m in ("trades", "flags", "ratio")]
    body = "\nUNION ALL\n".join(parts)
    return f"""WITH t AS (SELECT * FROM trades),
top AS (SELECT client, count(*) AS trades, count(*) FILTER (WHERE flag = 1) AS flags, round(count(*) FILTER (WHERE flag = 1) / count(*), 6) AS ratio
        FROM t WHERE client IS NOT NULL GROUP BY client ORDER BY ratio DESC, trades DESC, client LIMIT 15),
x AS ({body})
SELECT section, item, measure, round(value, 6) AS value FROM x"""


@register("profile_facts", "G4 Q1 A11 A14 A15 A18 A19 A20 A12 A13 Q4 Q5 Q12 O5", with_fixtures(_facts_sql(), "trades"))
def q_profile_facts(spark, sf):
    facts = jobs.profile_facts(tf.trades(spark, sf), _NUM, _CAT, "d", "flag", "client", ("notional", "fx_rate", "gbp"), ("product_name", "product_group"))
    return facts.withColumn("value", F.round("value", 6))
