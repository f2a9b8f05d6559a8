"""Profiling (A1-A25, O2, O5-O7): summaries, frequency and contingency tables,
describe, histograms, quantiles, calendar coverage, top-k and sampling.

All aggregates are mergeable (partial aggregation before the shuffle). Distinct days are
counted in bitmaps over day numbers (4 KB for 89 years), which merge like sums, so rows are
not expanded once per distinct column. Exact quantiles are selected by narrowing
(``ranking.quantiles_by_column``), so no task holds or sorts a whole column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.ranking import exact_quantiles, quantiles_by_column


MAX_PIVOT = 1000


def _cnt() -> Column:
    return F.count(F.lit(1))


# --------------------------------------------------------------------------- A1-A9


def _per_bitmap(df: DataFrame, keys: list[str], date: str, *more: Column) -> DataFrame:
    """``keys``, rows, first and last day and the days' bitmap, one row per key and bitmap of 32,768 days."""
    day = F.unix_date(date)
    return df.groupBy(*keys, F.bitmap_bucket_number(day).alias("_bitmap")).agg(
        _cnt().alias("rows"), F.min(date).alias("first_day"), F.max(date).alias("last_day"),
        F.bitmap_construct_agg(F.bitmap_bit_position(day)).alias("_days"), *more)


def _span() -> list[Column]:
    return [F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
            F.date_diff(F.max("last_day"), F.min("first_day")).alias("span_days")]


def table_coverage(df: DataFrame, key: str, date: str) -> DataFrame:
    """A1 + A6: rows, distinct keys and days, first and last day, the days between them, and the mean rows of a day."""
    per = _per_bitmap(df, [key], date)
    days = per.groupBy("_bitmap").agg(F.bitmap_or_agg("_days").alias("_days")).agg(F.sum(F.bitmap_count("_days")).alias("days"))
    return per.agg(F.sum("rows").alias("rows"), F.count_distinct(key).alias("keys"), *_span()).crossJoin(days).withColumn(
        "rows_per_day", F.try_divide(F.col("rows"), F.col("days")))  # one row each


def coverage_by_key(df: DataFrame, key: str, date: str) -> DataFrame:
    """A2: per key ``rows, days`` (distinct dates), first and last day and the days between them."""
    return _per_bitmap(df, [key], date).groupBy(key).agg(F.sum("rows").alias("rows"), F.sum(F.bitmap_count("_days")).alias("days"), *_span())


def value_stats_by_key(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """A3 + A4: ``coverage_by_key`` with least, greatest and mean value, population deviation and the
    deviation relative to the mean."""
    per = _per_bitmap(df, [key], date, F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"),
                      F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    merged = per.groupBy(key).agg(
        F.sum("rows").alias("rows"), F.sum(F.bitmap_count("_days")).alias("days"), *_span(), F.min("_lo").alias("least"), F.max("_hi").alias("greatest"),
        F.try_divide(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).alias("mean"),
        F.collect_list(F.struct("_n", "_m", "_v")).alias("_parts"))  # one a bitmap
    total = F.aggregate("_parts", F.lit(0.0), lambda at, p: at + F.coalesce(p["_n"] * (p["_v"] + (p["_m"] - F.col("mean")) ** 2), F.lit(0.0)))
    n = F.aggregate("_parts", F.lit(0).cast("long"), lambda at, p: at + p["_n"])
    return merged.withColumn("deviation", F.when(n > 0, F.sqrt(total / n))).withColumn(
        "relative_deviation", F.try_divide("deviation", "mean")).drop("_parts")


def repeated_day_report(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """The ``value_stats_by_key`` of keys with more readings than days, most surplus first (O2)."""
    s = value_stats_by_key(df, key, date, value).withColumn("surplus", F.col("rows") - F.col("days"))
    return s.where("surplus > 0").orderBy(F.desc("surplus"), key)


def grid_shape(grid: DataFrame, key: str, date: str) -> DataFrame:
    """Rows against distinct keys times distinct dates; ``missing`` is 0 for a complete grid."""
    g = table_coverage(grid, key, date).select("keys", "days", "rows")
    return g.withColumn("missing", F.col("keys") * F.col("days") - F.col("rows"))


# --------------------------------------------------------------------------- frequency tables


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Frequency of every value, NULL included; sort at the sink by ``n`` desc."""
    return df.groupBy(col).agg(_cnt().alias(out))


def crosstab_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of row x col with row, column and grand totals.

    ``row_total`` / ``col_total`` (0/1 grouping bits) tell a margin from a NULL category.
    """
    return (df.cube(row, col)
              .agg(_cnt().alias("n"), F.grouping(row).cast("int").alias("is_row_margin"),
                   F.grouping(col).cast("int").alias("is_col_margin")))


def crosstab_pivot(df: DataFrame, row: str, col: str, values: list | None = None, prefix: str = "",
                   null_name: str = "null", other_name: str = "other") -> DataFrame:
    """Row x col counts as a wide table; zero cells shown as 0.

    Without ``values`` the columns are found by a distinct aggregate; more than ``MAX_PIVOT`` of them
    are an error (use ``crosstab_margins``, which is long). NULL has a column of its own, and with given
    ``values`` everything else is counted under ``other_name``: no row is lost.
    """
    if values is None:
        found = df.select(F.col(col).alias("v")).where("v IS NOT NULL").distinct()
        values = sorted(r["v"] for r in found.limit(MAX_PIVOT + 1).collect())
        if len(values) > MAX_PIVOT:
            raise ValueError(f"{col} has more than {MAX_PIVOT} values: too many for columns")
        rest = []
    else:
        rest = [F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(list(values))).alias(f"{prefix}{other_name}")]
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{prefix}{v}") for v in values], *rest,
                               F.count_if(F.col(col).isNull()).alias(f"{prefix}{null_name}"))


def crosstab_share(df: DataFrame, row: str, col: str) -> DataFrame:
    """The margins table normalised by the grand total."""
    m = crosstab_margins(df, row, col)
    total = df.select(_cnt()).scalar()
    return m.withColumn("share", F.col("n") / total)


def crosstab_by_partition(df: DataFrame, part: str, row: str, col: str) -> DataFrame:
    """Row x col with margins inside every value of ``part`` in one pass (no driver loop)."""
    return (df.groupingSets([[part, row, col], [part, row], [part, col], [part]], part, row, col)
              .agg(_cnt().alias("n"), F.grouping(row).cast("int").alias("is_row_margin"),
                   F.grouping(col).cast("int").alias("is_col_margin")))


# --------------------------------------------------------------------------- describe


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column count, mean, sample std, min, 25 / 50 / 75 % (interpolated), max.

    One aggregate for the moments of all columns, one value-count pass for their quantiles. The mean is taken around
    a first one, so that its last digits do not hang on the order of the rows.
    """
    first = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    about = [m if m is not None and math.isfinite(m) else 0.0 for m in first]
    stats = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.lit(m).alias("m"))
                                          for c, m in zip(cols, about)])).alias("s")).groupBy("s.column").agg(
        F.count("s.x").alias("count"), (F.max("s.m") + F.avg(F.col("s.x") - F.col("s.m"))).alias("mean"), F.stddev_samp("s.x").alias("std"),
        F.min("s.x").alias("min"), F.max("s.x").alias("max"))
    q = quantiles_by_column(df, cols, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return q.join(stats, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column non-null count, distinct values, most frequent value (ties: smallest) and its count."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("_s")).select("_s.column", "_s.value")
    freq = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(_cnt().alias("freq"))
    return freq.groupBy("column").agg(
        F.sum("freq").alias("count"), _cnt().alias("unique"),
        F.min_by("value", F.struct((-F.col("freq")).alias("nf"), F.col("value"))).alias("top"),
        F.max("freq").alias("freq"))


def describe_dates(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, min, quartiles and max of a date column, in days since 1970-01-01."""
    d = df.select(F.unix_date(col).alias("_day"))
    s = describe_numeric(d, ["_day"])
    return s.select("count", F.col("mean").alias("mean_day"), F.col("min").alias("min_day"), F.col("max").alias("max_day"),
                    F.col("p25").alias("p25_day"), F.col("p50").alias("p50_day"), F.col("p75").alias("p75_day"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed on the right.

    ``bin`` is 1-based; ``lower`` is the bin's left edge; empty bins are not listed.
    """
    x = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    lo = x.select(F.min("_x")).scalar()
    hi = x.select(F.max("_x")).scalar()
    raw = F.floor((F.col("_x") - lo) / (hi - lo) * bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))) + 1
    return (x.withColumn("bin", b.cast("int")).groupBy("bin").agg(_cnt().alias("n"))
             .withColumn("lower", lo + (hi - lo) * (F.col("bin") - 1) / bins))


def percentile_cuts(df: DataFrame, col: str, probs: tuple[float, ...] = (0.10, 0.80, 0.95, 0.99)) -> DataFrame:
    """Exact (interpolated) cut-points."""
    return exact_quantiles(df, col, list(probs))


# --------------------------------------------------------------------------- dates, top-k, samples


def count_per_date(df: DataFrame, date: str, where: Column | None = None) -> DataFrame:
    """Rows per date (NULL dates excluded); sort by date at the sink."""
    x = df if where is None else df.where(where)
    return x.where(F.col(date).isNotNull()).groupBy(date).agg(_cnt().alias("n"))


def calendar_coverage(df: DataFrame, date: str) -> DataFrame:
    """First and last date, span, number of dates present and missing."""
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                  F.date_diff(F.max(date), F.min(date)).alias("span_days"),
                  F.count_distinct(date).alias("num_dates")).withColumn(
        "missing_dates", F.col("span_days") + 1 - F.col("num_dates"))


def top_k(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``by`` (give a total order). Runs as TakeOrderedAndProject:
    every task keeps its own k best, the driver merges k per task."""
    return df.orderBy(*by).limit(k)


def head(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order (file order has no meaning in Spark)."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    """Last ``n`` rows in an explicit order."""
    rev = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    return df.orderBy(*rev).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """Simple random sample of exactly ``n`` rows, reproducible for a seed.

    Rows are ranked by MD5 of the seed and ``key_cols`` as text (all columns by default), so
    the pick does not depend on partitioning, survives recomputation and is the same in any engine.
    """
    cols = key_cols or df.columns
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])
    return df.orderBy(F.md5(text), *cols, *[c for c in df.columns if c not in cols]).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(_cnt().alias("num_rows")).withColumn("num_columns", F.lit(len(df.columns)))


def count_true(df: DataFrame, cond: Column, name: str = "n") -> DataFrame:
    """Number of rows where ``cond`` holds."""
    return df.agg(F.count_if(cond).alias(name))
