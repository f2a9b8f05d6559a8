"""Joins of the reference (J1-J8, J11). Which side is broadcast and how skewed keys are
split is left to the planner, which decides under AQE on measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fanout_left_join(transactions: DataFrame, rates: DataFrame, t_key: str = "currency",
                     t_date: str = "trans_date", r_key: str = "currency", r_date: str = "exchange_date",
                     r_value: str = "exchange_rate") -> DataFrame:
    """Transactions left-joined to raw readings; several readings per day multiply the row."""
    r = rates.select(F.col(r_key).alias("_rk"), F.col(r_date).alias(r_date), F.col(r_value).alias(r_value))
    t = transactions.select(t_date, t_key)
    j = t.join(r, (t[t_key] == r["_rk"]) & (t[t_date] == r[r_date]), "left")
    return j.select(t_date, t_key, r_value, r_date)


def need_to_impute(transactions: DataFrame, rates: DataFrame, t_key: str = "currency",
                   t_date: str = "trans_date", r_key: str = "currency", r_date: str = "exchange_date",
                   r_value: str = "exchange_rate") -> DataFrame:
    """Transactions without a usable raw reading on their day.

    Same rows as ``left join ... where rate is null or date is null``: an anti join
    for the unmatched rows plus one row per matched reading whose rate is NULL.
    """
    t = transactions.select(t_date, t_key)
    r = rates.select(F.col(r_key).alias(t_key), F.col(r_date).alias(t_date), F.col(r_value))
    unmatched = t.join(r.select(t_key, t_date), [t_key, t_date], "left_anti")
    null_rate = t.join(r.where(F.col(r_value).isNull()).select(t_key, t_date), [t_key, t_date], "inner")
    return unmatched.unionByName(null_rate).select(t_date, t_key)


def available_and_missing(daily: DataFrame, need: DataFrame, d_key: str = "currency",
                          d_date: str = "exchange_date", d_value: str = "exchange_rate",
                          n_key: str = "currency", n_date: str = "trans_date") -> DataFrame:
    """J6 + J7: full outer join of the daily readings and the needed dates, keys merged.

    ``the_currency, the_date, exch_rate, to_impute``.
    """
    d = daily.select(F.col(d_key).alias("_dk"), F.col(d_date).alias("_dd"), F.col(d_value).alias("exch_rate"))
    n = need.select(F.col(n_key).alias("_nk"), F.col(n_date).alias("_nd"))
    j = d.join(n, (d["_dk"] == n["_nk"]) & (d["_dd"] == n["_nd"]), "full")
    return j.select(F.coalesce("_dk", "_nk").alias("the_currency"), F.coalesce("_dd", "_nd").alias("the_date"),
                    "exch_rate", F.col("exch_rate").isNull().alias("to_impute"))


def calendar_left_join(spine: DataFrame, daily: DataFrame, spine_date: str = "the_date",
                       daily_date: str = "exchange_date") -> DataFrame:
    """Every calendar day with every reading of that day (NULLs on empty days).

    Written as (readings on spine days) + (spine days without a reading): both are joins that
    the planner may broadcast by measured size or split where one day is busy.
    """
    s = spine.select(F.col(spine_date).alias("_sd"))
    hits = daily.join(s, daily[daily_date] == s["_sd"], "left_semi")
    hit_rows = hits.withColumn(spine_date, F.col(daily_date))
    empty = spine.select(spine_date).join(
        daily.select(F.col(daily_date).alias(spine_date)).distinct(), spine_date, "left_anti")
    return hit_rows.unionByName(empty, allowMissingColumns=True)
