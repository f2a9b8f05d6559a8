"""Exact global ranks, quantiles and running sums without a single-partition window.

Ranks and running sums: every row gets a range bucket that is a pure function of its own
order columns. Cut points are taken once from a bounded sample, then a row finds its bucket
by binary search, in one array of cuts, or, beyond ``COARSE`` buckets, in two levels: the
coarse cuts, then the array of its coarse bucket's own cuts. The number of buckets follows
the rows, so a bucket holds about ``BUCKET_ROWS`` of them at any size. Rows are numbered (or
summed) inside their bucket and shifted by the totals of the earlier buckets, a table with
one row per bucket. Because a row's bucket never depends on how an exchange happens to be
laid out, the branches of a plan always agree.

Quantiles are selected, not sorted: a mergeable sketch brackets each wanted rank, the rows
below a bracket are counted exactly, and brackets are narrowed until they hold few rows or
one value; only those are put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import checkpoint_dir

SAMPLE_PER_BUCKET = 32
BUCKET_ROWS = 500_000
COARSE = 1024            # buckets of the first level, and of each of these at most
BRACKET_ROWS = 100_000   # rows that one task may order for a quantile
_GRID, _ACCURACY = 1000, 10_000


def _order_key(order: list[Column | str]) -> Column:
    """The order columns as one ascending, comparable struct (NULL first)."""
    return F.struct(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])


def _not_above(cuts: Column, size: int, key: Column) -> Column:
    """How many of the sorted ``cuts`` (at most ``size``) are not above ``key``, by binary search."""
    steps = [1 << i for i in range(max(size, 1).bit_length() - 1, -1, -1)]
    return F.reduce(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at))


def _cuts(keys: Column, parts: int) -> Column:
    """``parts - 1`` evenly spaced, different ones of an array's sorted values."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)),
                                        lambda i: F.get(keys, F.least(F.floor(F.size(keys) * i / parts).cast("int"), F.size(keys) - 1))))


def range_bucket(df: DataFrame, order: list[Column | str], buckets: int | None = None, out: str = "_rb") -> DataFrame:
    """Adds ``out``: 0-based range bucket of the row in ascending ``order``; ``buckets`` or more of them."""
    key = _order_key(order)
    x = df.select(key.alias("k"))
    rows = x.count()
    n = max(buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    coarse = min(n, COARSE)
    if coarse < 2 or not rows:
        return df.withColumn(out, F.lit(0))

    def sampled(frame: DataFrame, wanted: int) -> DataFrame:
        return frame.where(F.rand(7) < min(1.0, SAMPLE_PER_BUCKET * wanted / rows))

    # about 32 keys per bucket, of at most COARSE buckets, meet in one row
    found = sampled(x, coarse).agg(F.array_sort(F.collect_list("k")).alias("ks")).select(
        F.when(F.size("ks") > 0, _cuts(F.col("ks"), coarse)).alias("cuts")).first()["cuts"] or []
    if not found:
        return df.withColumn(out, F.lit(0))
    fields = x.schema["k"].dataType.fields
    lits = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, fields)]) for c in found])
    first = _not_above(lits, len(found), key)
    each = min(-(-n // coarse), COARSE)
    if each < 2:
        return df.withColumn(out, first)
    checkpoint_dir(df.sparkSession)  # taken once: all branches see the same cuts
    fine = sampled(x.withColumn("_c1", _not_above(lits, len(found), F.col("k"))), coarse * each).groupBy("_c1").agg(
        F.array_sort(F.collect_list("k")).alias("ks")).select("_c1", _cuts(F.col("ks"), each).alias("_fine")).checkpoint(eager=True)
    # at most COARSE rows of at most COARSE cuts
    both = df.withColumn("_c1", first).join(F.broadcast(fine), "_c1", "left")
    inner = F.when(F.col("_fine").isNull(), 0).otherwise(_not_above(F.col("_fine"), each - 1, key))
    return both.withColumn(out, F.col("_c1") * each + inner).drop("_c1", "_fine")


def global_row_number(df: DataFrame, order: list[Column | str], out: str = "_grank",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole frame in ascending ``order`` (ties: give a total order)."""
    x = range_bucket(df, order, partitions)
    counts = x.groupBy("_rb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_rb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_rb").orderBy(_order_key(order))
    # offs has one row per bucket: rows / BUCKET_ROWS of them
    return x.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(offs), "_rb").withColumn(
        out, F.col("_off") + F.col("_i")).drop("_rb", "_i", "_off")


def cumulative_sums(df: DataFrame, order: list[Column | str], cols: list[str], suffix: str = "_cum",
                    partitions: int | None = None) -> DataFrame:
    """Running totals of ``cols`` over the whole frame in ascending ``order`` (inclusive of the row).

    Same answer as ``sum(c) OVER (ORDER BY ... ROWS UNBOUNDED PRECEDING)`` for a total order.
    """
    x = range_bucket(df, order, partitions)
    totals = x.groupBy("_rb").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_rb", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    inside = Window.partitionBy("_rb").orderBy(_order_key(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = x.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in cols])
    return local.join(F.broadcast(offs), "_rb").select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(c + suffix) for c in cols])


class _Wanted:
    """One quantile: its ranks (0-based) and the bracket they lie in."""

    def __init__(self, column: str, name: str, at: float, grid: list[float], size: int):
        self.column, self.name, self.share = column, name, at - math.floor(at)
        self.low, self.high = math.floor(at), math.ceil(at)
        self.grid, self.below, self.size, self.wide, self.settled = grid, 0, size, 2, False
        self.narrow()

    def narrow(self) -> None:
        """The bracket between the sketch's values beside the ranks, ``wide`` steps away; ``below`` and ``size`` are of the
        rows that were sketched."""
        k = (self.low - self.below) * _GRID // max(self.size, 1)
        self.lo, self.hi = self.grid[max(k - self.wide, 0)], self.grid[min(k + 1 + self.wide, _GRID)]

    def inside(self, x: Column) -> Column:
        return (x >= F.lit(self.lo)) & (x <= F.lit(self.hi))


def _sketch(x: Column) -> Column:
    return F.percentile_approx(x, [i / _GRID for i in range(_GRID + 1)], _ACCURACY)


def quantiles_by_column(df: DataFrame, cols: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """One row per column (``column``) with its linearly interpolated quantiles (pandas / ``quantile_cont``).

    All columns share the passes: one sketches them, one counts below and inside the brackets (more of both only while a
    bracket holds over ``BRACKET_ROWS`` rows of different values), one brings the brackets' values in order. A column
    without values has NULL quantiles.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    slim = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x.values())])
    x = {c: F.col(f"x{i}") for i, c in enumerate(cols)}
    first = slim.agg(*[a for i, c in enumerate(cols) for a in (F.count(x[c]).alias(f"n{i}"), _sketch(x[c]).alias(f"g{i}"))]).first()
    wanted = [_Wanted(c, name, p * (first[f"n{i}"] - 1), first[f"g{i}"], first[f"n{i}"])
              for i, c in enumerate(cols) if first[f"n{i}"] for p, name in zip(probs, names)]
    open_ = list(wanted)
    while open_:
        got = slim.agg(*[a for i, w in enumerate(open_) for a in (F.count_if(x[w.column] < F.lit(w.lo)).alias(f"b{i}"),
                                                                F.count_if(w.inside(x[w.column])).alias(f"s{i}"))]).first()
        again = []
        for i, w in enumerate(open_):
            below, size = got[f"b{i}"], got[f"s{i}"]
            if not below <= w.low <= w.high < below + size:
                w.wide *= 4  # beyond the sketch's error: a wider bracket of the same sketch, at most all of it
                w.narrow()
                again.append(w)
            else:
                w.settled = size > 0.9 * w.size  # narrowing has stopped helping: equal values
                w.below, w.size = below, size
        large = [w for w in open_ if w not in again and w.size > BRACKET_ROWS and w.lo < w.hi and not w.settled]
        if large:
            inner = slim.agg(*[_sketch(F.when(w.inside(x[w.column]), x[w.column])).alias(f"g{i}") for i, w in enumerate(large)]).first()
            for i, w in enumerate(large):
                w.grid = inner[f"g{i}"]
                w.narrow()
                again.append(w)
        open_ = again
    schema = "column string, name string, value double"
    known = [(w.column, w.name, float(w.lo)) for w in wanted if w.lo == w.hi]
    rest = [w for w in wanted if w.lo < w.hi]
    values = df.sparkSession.createDataFrame(known, schema)
    if rest:
        cells = F.array(*[F.when(w.inside(x[w.column]), F.struct(F.lit(i).alias("w"), x[w.column].alias("x"))) for i, w in enumerate(rest)])
        held = slim.select(F.explode(F.array_compact(cells)).alias("s")).groupBy("s.w", "s.x").agg(F.count(F.lit(1)).alias("n"))
        # a window is one bracket: at most BRACKET_ROWS different values
        run = held.withColumn("hi", F.sum("n").over(Window.partitionBy("w").orderBy("x"))).withColumn("lo", F.col("hi") - F.col("n"))
        facts = df.sparkSession.createDataFrame([(i, w.column, w.name, w.low - w.below, w.high - w.below, float(w.share)) for i, w in enumerate(rest)],
                                                "w int, column string, name string, a long, z long, share double")

        def at(rank: str) -> Column:
            return F.max(F.when((F.col("lo") <= F.col(rank)) & (F.col(rank) < F.col("hi")), F.col("x")))

        values = values.unionByName(run.join(F.broadcast(facts), "w").groupBy("column", "name").agg(
            (at("a") + (at("z") - at("a")) * F.max("share")).alias("value")))
    found = values.groupBy("column").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(found, "column", "left")


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str] | None = None) -> DataFrame:
    """One row with the linearly interpolated quantiles of ``col``."""
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    return quantiles_by_column(df, [col], list(probs), names).drop("column")
