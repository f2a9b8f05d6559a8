"""Trade cleaning and feature engineering (G5: P14, E1-E10, Q2, Q3).

Column names are parameters (``TradeColumns``); defaults are the reference's raw
trade fields. Lookups are literal maps evaluated inside the scan's projection, so
they cost no join at all. The per-client summary is aggregated with map-side
combine and joined back with a salted join so one very active client cannot
pin a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import calendar as cal
from ledgerspark.functions.lookups import (CURRENCY_TO_REDUCED, PRODUCT_NAME_TO_GROUP, PRODUCT_NAME_TO_TYPE,
                                           map_lookup)
from ledgerspark.operators import quality
from ledgerspark.operators.ranking import exact_quantiles


@dataclass(frozen=True)
class TradeColumns:
    trade_date: str = "Trade Date"
    source_system: str = "Source System"
    leg_type: str = "Leg Type"
    product_name: str = "Product Name"
    product_group: str = "Product Group"
    currency: str = "Notional Amount Currency"
    notional: str = "Notional Amount"
    fx_rate: str = "Fx_rate"
    gbp: str = "Gbp Notional Amount"
    office: str = "CountryCodeOffice"
    risk: str = "ML Risk Rating"
    client: str = "Client Name"
    flag: str = "Flag"
    keep: tuple[str, ...] = field(default_factory=tuple)  # business keys carried through

    @property
    def useless(self) -> list[str]:
        return [self.leg_type, self.notional, self.fx_rate, self.product_name, self.product_group,
                self.trade_date]


REFERENCE_COLUMNS = TradeColumns()


@dataclass(frozen=True)
class ClientThresholds:
    """E7 thresholds: new ``n < new_below``; frequent ``n > frequent_above``;
    suspicious ``ratio > susp_ratio and n > susp_min_n``; trusted ``ratio < trust_ratio and n > trust_min_n``."""
    new_below: int = 20
    frequent_above: int = 100
    susp_ratio: float = 0.6
    susp_min_n: int = 5
    trust_ratio: float = 0.01
    trust_min_n: int = 99


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# --------------------------------------------------------------------------- lookups


def impute_group(df: DataFrame, name_col: str, group_col: str,
                 mapping: Mapping[str, str] = PRODUCT_NAME_TO_GROUP) -> DataFrame:
    """Fill a NULL group from the name's known group (existing groups kept)."""
    return df.withColumn(group_col, F.coalesce(_c(group_col), map_lookup(name_col, mapping)))


def product_type(df: DataFrame, name_col: str, mapping: Mapping[str, str] = PRODUCT_NAME_TO_TYPE,
                 out: str = "product_type") -> DataFrame:
    """Product name -> coarse type (unlisted or NULL name -> NULL)."""
    return df.withColumn(out, map_lookup(name_col, mapping))


def currency_reduced(df: DataFrame, currency_col: str, mapping: Mapping[str, str] = CURRENCY_TO_REDUCED,
                     out: str = "currency_reduced", otherwise: str | None = None) -> DataFrame:
    """Lump rare currencies; unlisted -> NULL (or ``otherwise``)."""
    v = map_lookup(currency_col, mapping)
    if otherwise is not None:
        v = F.coalesce(v, F.lit(otherwise))
    return df.withColumn(out, v)


# --------------------------------------------------------------------------- dates, amounts


def date_features(df: DataFrame, text_col: str, fmt: str = "dd/MM/yyyy", out: str = "date",
                  strict: bool = False, extra: bool = False) -> DataFrame:
    """Parse the trade date (NULL when impossible unless ``strict``) and derive
    month, month start / end, weekday (Mon = 0) and quarter; ``extra`` adds F9 / F10."""
    df = df.withColumn(out, cal.parse_date(text_col, fmt, strict))
    feats = cal.calendar_features(out)
    if extra:
        feats.update(cal.extra_calendar_features(out))
    return df.withColumns(feats)


def log_amount(df: DataFrame, amount: str, out: str = "gbp_log_amount", drop: bool = True,
               floor: float | None = None) -> DataFrame:
    """``log10(amount)``; ``floor`` first lifts NULL / tiny amounts."""
    x = _c(amount)
    if floor is not None:
        from ledgerspark.functions.numeric import floor_amount
        x = floor_amount(amount, floor)
    df = df.withColumn(out, F.log10(x))
    return df.drop(amount) if drop else df


def amount_bucket(df: DataFrame, amount: str, probs: tuple[float, ...] = (0.10, 0.80, 0.95, 0.99),
                  out: str = "amount_bucket") -> DataFrame:
    """E5: ordinal bucket by percentile cut-points (0 below the first cut, len(probs) above the last).

    Cut-points are exact interpolated quantiles computed by a distributed sort and
    attached as scalar values; no row is collected.
    """
    names = [f"_q{i}" for i in range(len(probs))]
    cuts = exact_quantiles(df, amount, list(probs), names).select(F.struct(*names)).scalar()
    b = F.lit(0)
    for nm in names:
        b = b + F.when(_c(amount) >= cuts.getField(nm), 1).otherwise(0)
    return df.withColumn(out, F.when(_c(amount).isNull(), F.lit(None)).otherwise(b))


# --------------------------------------------------------------------------- clients


def client_summary(df: DataFrame, client: str, flag: str, out_client: str = "client_name") -> DataFrame:
    """Per client ``num_flags, num_transactions, ratio`` in one aggregate."""
    return (df.where(_c(client).isNotNull()).groupBy(_c(client).alias(out_client))
              .agg(F.count_if(_c(flag) == 1).alias("num_flags"), F.count(F.lit(1)).alias("num_transactions"))
              .withColumn("ratio", F.col("num_flags") / F.col("num_transactions")))


def client_flags(summary: DataFrame, th: ClientThresholds = ClientThresholds()) -> DataFrame:
    """Boolean client classes from the summary (strict inequalities)."""
    n, r = F.col("num_transactions"), F.col("ratio")
    return summary.withColumns({
        "new_client": n < th.new_below,
        "frequent_client": n > th.frequent_above,
        "suspicious_client": (r > th.susp_ratio) & (n > th.susp_min_n),
        "trusted_client": (r < th.trust_ratio) & (n > th.trust_min_n),
    })


CLIENT_FLAG_COLS = ["suspicious_client", "trusted_client", "new_client", "frequent_client"]


def attach_client_flags(df: DataFrame, flags: DataFrame, client: str, drop_client: bool = True) -> DataFrame:
    """Left join the client classes back onto the trades; ``client_name`` survives. A client with very
    many trades is split by AQE's skew handling (the trades are the side that may be split)."""
    right = flags.select("client_name", *CLIENT_FLAG_COLS)
    j = df.join(right, _c(client) == F.col("client_name"), "left")
    return j.drop(client) if drop_client else j


def client_history_asof(df: DataFrame, client: str, date: str, flag: str) -> DataFrame:
    """Per trade, the client's number of earlier trades and earlier flagged trades
    (strictly before the trade's day) — point-in-time, no look-ahead.

    Trades are first counted per (client, day); the running total is a window
    over that daily table, whose rows per client are bounded by the calendar, not
    by the client's trade volume. The totals join back on (client, day).
    """
    daily = (df.groupBy(_c(client).alias("_cl"), _c(date).alias("_dt"))
               .agg(F.count(F.lit(1)).alias("_n"), F.count_if(_c(flag) == 1).alias("_f")))
    w = Window.partitionBy("_cl").orderBy("_dt").rowsBetween(Window.unboundedPreceding, -1)
    hist = daily.select("_cl", "_dt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("prior_trades"),
                        F.coalesce(F.sum("_f").over(w), F.lit(0)).alias("prior_flags"))
    j = df.join(hist, (_c(client) == F.col("_cl")) & (_c(date) == F.col("_dt")), "left")
    return j.drop("_cl", "_dt")


# --------------------------------------------------------------------------- G5


@dataclass
class CleanResult:
    clean: DataFrame
    incomplete: DataFrame
    zero_amount: DataFrame
    client_summary: DataFrame


def clean_trades(df: DataFrame, cols: TradeColumns = REFERENCE_COLUMNS,
                 group_map: Mapping[str, str] = PRODUCT_NAME_TO_GROUP,
                 type_map: Mapping[str, str] = PRODUCT_NAME_TO_TYPE,
                 currency_map: Mapping[str, str] = CURRENCY_TO_REDUCED,
                 thresholds: ClientThresholds = ClientThresholds(), date_fmt: str = "dd/MM/yyyy",
                 drop_extra: tuple[str, ...] = (), store: Callable[[DataFrame], DataFrame] | None = None) -> CleanResult:
    """G5 in the reference's order: impute group, product type, date features, drop the
    superseded columns, quarantine incomplete rows, quarantine amounts below 0.01, log
    amount, currency lumping, client summary on the survivors, attach client classes.

    Returns lazily defined frames; only a sink runs them. ``store`` writes the tagged rows and reads them
    again, so that several sinks share the work before. ``cols.keep`` columns (business keys) are carried
    through and ignored by the null check.
    """
    x = impute_group(df, cols.product_name, cols.product_group, group_map)
    x = product_type(x, cols.product_name, type_map)
    x = date_features(x, cols.trade_date, date_fmt)
    x = x.drop(*cols.useless, *drop_extra)
    check = [c for c in x.columns if c not in cols.keep]
    bad = quality.any_null(check)
    tagged = x.withColumn("_incomplete", bad)
    if store is not None:
        tagged = store(tagged)
    incomplete = tagged.where("_incomplete").drop("_incomplete")
    complete = tagged.where(~F.col("_incomplete")).drop("_incomplete")
    zero = quality.zero_amount_rows(complete, cols.gbp)
    kept = quality.nonzero_amount_rows(complete, cols.gbp)
    kept = log_amount(kept, cols.gbp)
    kept = currency_reduced(kept, cols.currency, currency_map).drop(cols.currency)
    summary = client_flags(client_summary(kept, cols.client, cols.flag), thresholds)
    clean = attach_client_flags(kept, summary, cols.client)
    return CleanResult(clean, incomplete, zero, summary)
