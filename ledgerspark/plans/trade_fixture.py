"""How the reference's trade cleaning maps onto the shared ``trades`` fixture view.

The fixture's categories differ from the reference's data, so the lookups are
rebuilt by rule (FIXTURES.md): product group = upper(type); types ECONOMY and
SMALL lump to ``other``, the rest lower-cased; NATION_0..NATION_9 kept,
NATION_10..NATION_23 lumped to ``other``, NATION_24 deliberately unlisted (NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.operators.features import ClientThresholds, CleanResult, TradeColumns, clean_trades
from ledgerspark.session import stored
from ledgerspark.sources import fixtures as fx

P_TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
GROUP_MAP = {t: t.upper() for t in P_TYPES}
TYPE_MAP = {t: ("other" if t in ("ECONOMY", "SMALL") else t.lower()) for t in P_TYPES}
CURRENCY_MAP = {f"NATION_{i}": (f"NATION_{i}" if i < 10 else "other") for i in range(24)}

COLS = TradeColumns(trade_date="trade_date", source_system="source_system", leg_type="leg_type",
                    product_name="product_name", product_group="product_group", currency="currency",
                    notional="notional", fx_rate="fx_rate", gbp="gbp", office="office", risk="risk",
                    client="client", flag="flag", keep=("l_orderkey", "l_linenumber"))

# the fixture's flag ratios are lower than the reference's data (FIXTURES.md)
THRESHOLDS = ClientThresholds(new_below=20, frequent_above=100, susp_ratio=0.05, susp_min_n=5,
                              trust_ratio=0.01, trust_min_n=30)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return fx.trades(spark, sf)


def stored_trades(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The trades (or some columns of them) joined once and stored, for operators that scan their input several times."""
    t = trades(spark, sf)
    return stored(t.select(*columns) if columns else t, "trades")


def clean(spark: SparkSession, sf: str, store=None) -> CleanResult:
    return clean_trades(trades(spark, sf), COLS, GROUP_MAP, TYPE_MAP, CURRENCY_MAP, THRESHOLDS,
                        drop_extra=("d",), store=store)


def values_sql(mapping: dict[str, str], name: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())
    return f"{name}(k, v) AS (VALUES {rows})"


# DuckDB text of the same cleaning, step by step
CLEAN_SQL = ",\n".join([
    values_sql(GROUP_MAP, "gmap"), values_sql(TYPE_MAP, "tmap"), values_sql(CURRENCY_MAP, "cmap"),
    """c0 AS (
  SELECT t.*, COALESCE(t.product_group, gm.v) AS product_group_i, tm.v AS product_type,
         CAST(try_strptime(t.trade_date, '%d/%m/%Y') AS DATE) AS date
  FROM trades t LEFT JOIN gmap gm ON gm.k = t.product_name LEFT JOIN tmap tm ON tm.k = t.product_name)""",
    """c1 AS (
  SELECT l_orderkey, l_linenumber, client, currency, office, risk, source_system, gbp, flag, product_type, date,
         CAST(month(date) AS INTEGER) AS month, day(date) = 1 AS is_month_start,
         last_day(date) = date AS is_month_end, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
         CAST(quarter(date) AS INTEGER) AS quarter
  FROM c0)""",
    """c2 AS (
  SELECT *, (client IS NULL OR currency IS NULL OR office IS NULL OR risk IS NULL OR source_system IS NULL
             OR gbp IS NULL OR flag IS NULL OR product_type IS NULL OR date IS NULL OR month IS NULL
             OR is_month_start IS NULL OR is_month_end IS NULL OR weekday IS NULL OR quarter IS NULL) AS incomplete
  FROM c1)""",
    "incomplete AS (SELECT * EXCLUDE (incomplete) FROM c2 WHERE incomplete)",
    "complete AS (SELECT * EXCLUDE (incomplete) FROM c2 WHERE NOT incomplete)",
    "zero_amount AS (SELECT * FROM complete WHERE gbp < 0.01)",
    """kept AS (
  SELECT complete.* EXCLUDE (gbp, currency), log10(gbp) AS gbp_log_amount, cm.v AS currency_reduced
  FROM complete LEFT JOIN cmap cm ON cm.k = complete.currency WHERE gbp >= 0.01)""",
    f"""csum AS (
  SELECT client AS client_name, CAST(count(*) FILTER (WHERE flag = 1) AS BIGINT) AS num_flags,
         CAST(count(*) AS BIGINT) AS num_transactions,
         count(*) FILTER (WHERE flag = 1) / count(*) AS ratio
  FROM kept WHERE client IS NOT NULL GROUP BY client)""",
    f"""cflags AS (
  SELECT *, num_transactions < {THRESHOLDS.new_below} AS new_client,
         num_transactions > {THRESHOLDS.frequent_above} AS frequent_client,
         ratio > {THRESHOLDS.susp_ratio} AND num_transactions > {THRESHOLDS.susp_min_n} AS suspicious_client,
         ratio < {THRESHOLDS.trust_ratio} AND num_transactions > {THRESHOLDS.trust_min_n} AS trusted_client
  FROM csum)""",
    """clean AS (
  SELECT kept.* EXCLUDE (client), f.suspicious_client, f.trusted_client, f.client_name, f.new_client,
         f.frequent_client
  FROM kept LEFT JOIN cflags f ON kept.client = f.client_name)""",
])
