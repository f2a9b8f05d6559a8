"""Data-quality checks (Q1-Q12, E10) and quarantine splits.

Each check returns a DataFrame (an empty one means "passes"), so checks compose
into reports and tests without collecting anything to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cnt() -> Column:
    return F.count(F.lit(1))


def null_audit(df: DataFrame, cols: list[str] | None = None, only_with_nulls: bool = True) -> DataFrame:
    """Q1: ``(column, nulls)`` for every column holding at least one NULL — one scan."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls"))
                                           for c in cols])).alias("_s")).select("_s.column", "_s.nulls")
    return long.where(F.col("nulls") > 0) if only_with_nulls else long


def any_null(cols: list[str]) -> Column:
    """True when any of ``cols`` is NULL."""
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in cols])


def incomplete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q2 rejects: rows with a NULL in any of ``cols`` (default all columns)."""
    return df.where(any_null(cols or df.columns))


def complete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P10 / Q2 survivors: ``dropna(how='any')``."""
    return df.na.drop("any", subset=cols)


def zero_amount_rows(df: DataFrame, amount: str, threshold: float = 0.01) -> DataFrame:
    """Q3 rejects: amount below ``threshold`` (NULL amounts are not selected)."""
    return df.where(F.col(amount) < threshold)


def nonzero_amount_rows(df: DataFrame, amount: str, threshold: float = 0.01) -> DataFrame:
    """Q3 survivors."""
    return df.where(F.col(amount) >= threshold)


def fd_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Q4: determinant values mapped to more than one dependent value (NULLs ignored)."""
    return (df.where(F.col(determinant).isNotNull() & F.col(dependent).isNotNull())
              .groupBy(determinant).agg(F.count_distinct(dependent).alias("num_values"))
              .where(F.col("num_values") > 1))


def consistency_pass(a: str, fx: str, target: str, tol: float = 0.001) -> Column:
    """Q5 predicate: ``abs(a * fx - target) / target < tol``; NULL or 0/0 count as failing."""
    rel = F.try_divide(F.abs(F.col(a) * F.col(fx) - F.col(target)), F.col(target))
    return F.coalesce(rel < tol, F.lit(False))


def amount_consistency(df: DataFrame, a: str, fx: str, target: str, tol: float = 0.001) -> DataFrame:
    """Q5: rows passing and failing the derived-amount check."""
    p = consistency_pass(a, fx, target, tol)
    return df.agg(F.count_if(p).alias("num_pass"), F.count_if(~p).alias("num_fail"))


def coverage_violations(transactions: DataFrame, rates: DataFrame, t_key: str = "currency",
                        t_date: str = "trans_date", r_key: str = "currency",
                        r_date: str = "exchange_date") -> DataFrame:
    """Keys whose first transaction precedes their first rate.

    Both sides are pre-aggregated to one row per key before the join, so the join
    never sees the raw rows. A key without any rate is not reported (the
    reference's ``<`` against NULL drops it).
    """
    tran = transactions.groupBy(t_key).agg(F.min(t_date).alias("first_transaction"))
    exch = (rates.groupBy(r_key).agg(F.min(r_date).alias("first_reading"))
                 .withColumnRenamed(r_key, "_rk"))
    j = tran.join(exch, tran[t_key] == exch["_rk"], "left")
    return (j.where(F.col("first_transaction") < F.col("first_reading"))
             .select(F.col(t_key).alias("currency"), "first_transaction", "first_reading"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q7: key combinations that occur more than once."""
    return df.groupBy(*keys).agg(_cnt().alias("num_records")).where(F.col("num_records") > 1)


def bad_dates(df: DataFrame, text_col: str, fmt: str = "dd/MM/yyyy") -> DataFrame:
    """Q11: text present but not a valid date in ``fmt``; plus NULL texts."""
    parsed = F.try_to_date(F.col(f"`{text_col}`"), fmt)
    return df.agg(F.count_if(F.col(f"`{text_col}`").isNotNull() & parsed.isNull()).alias("num_bad"),
                  F.count_if(F.col(f"`{text_col}`").isNull()).alias("num_missing"))


def low_amounts(df: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """Q12: rows with any of ``cols`` below ``threshold``."""
    return df.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`") < threshold for c in cols]))


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, num_values)`` for columns with at most one distinct non-null value.

    A column is constant exactly when its min equals its max, which needs only
    mergeable min / max aggregates (no distinct sets at any scale).
    """
    cols = cols or df.columns
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(f"`{c}`")).alias(f"_mn{i}"), F.max(F.col(f"`{c}`")).alias(f"_mx{i}")]
    wide = df.agg(*aggs)
    nvals = [F.when(F.col(f"_mn{i}").isNull(), 0).when(F.col(f"_mn{i}") == F.col(f"_mx{i}"), 1).otherwise(2)
             for i in range(len(cols))]
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("num_values"))
                                           for c, v in zip(cols, nvals)])).alias("_s")).select("_s.column",
                                                                                              "_s.num_values")
    return long.where(F.col("num_values") <= 1)
