"""Train / test splits (M1-M3) and stratified fold ids.

Exact and reproducible: within each class the rows are ordered by a seeded hash of their
key columns and the first ``ceil(frac * n_class)`` go to the test part. A split needs no
rank per row, only the one (hash, keys) that ends each class's test part: counts per hash
range say in which range it lies, and only that range is sorted. The wide rows are then
labelled where they are, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.ranking import _order_key, range_bucket
from ledgerspark.session import checkpoint_dir

#: rows of a class that one task may have to order
RANGE_ROWS = 20_000


def _hash(key_cols: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key_cols])


def _range_shift(df: DataFrame) -> int:
    """So many low bits of the hash are dropped that a range holds about RANGE_ROWS rows, at any size."""
    return 64 - min(40, max(1, math.ceil(math.log2(max(2, df.count() / RANGE_ROWS)))))


def class_rank(df: DataFrame, label: str, key_cols: list[str], seed: int, out: str = "_crank") -> DataFrame:
    """Rank inside each class by a seeded hash of ``key_cols`` (ties: the key columns), by (class, hash
    range) plus the sizes of the class's earlier ranges. Adds the class size as ``_n``."""
    keys = [F.col(f"`{c}`") for c in key_cols]
    lbl = F.col(f"`{label}`")
    x = df.withColumn("_h", _hash(key_cols, seed)).withColumn("_hb", F.shiftright("_h", _range_shift(df)))
    counts = x.groupBy(lbl.alias("_lbl"), F.col("_hb").alias("_ob")).agg(F.count(F.lit(1)).alias("_bn"))
    wc = Window.partitionBy("_lbl").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    wn = Window.partitionBy("_lbl")
    offs = counts.select("_lbl", "_ob", F.coalesce(F.sum("_bn").over(wc), F.lit(0)).alias("_off"),
                         F.sum("_bn").over(wn).alias("_n"))
    # one row per class and hash range of about RANGE_ROWS rows
    j = x.join(F.broadcast(offs), lbl.eqNullSafe(F.col("_lbl")) & (F.col("_hb") == F.col("_ob")))
    wr = Window.partitionBy("_lbl", "_hb").orderBy("_h", *keys)
    return j.withColumn(out, F.col("_off") + F.row_number().over(wr)).drop("_h", "_hb", "_ob", "_off", "_lbl")


def _spot(keys: list[str], seed: int) -> Column:
    return F.struct(_hash(keys, seed).alias("h"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)])


def _with_ends(df: DataFrame, label: str, frac: float, seed: int, keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: the spot of the last one of each class's first ``ceil(frac * n)`` rows."""
    lbl = F.col(f"`{label}`")
    slim = df.select(lbl.alias("_lbl"), _spot(keys, seed).alias("_at")).withColumn("_hb", F.shiftright("_at.h", _range_shift(df)))
    counts = slim.groupBy("_lbl", "_hb").agg(F.count(F.lit(1)).alias("_bn"))
    run = counts.withColumn("_upto", F.sum("_bn").over(Window.partitionBy("_lbl").orderBy("_hb"))).withColumn(
        "_want", F.ceil(F.lit(frac) * F.sum("_bn").over(Window.partitionBy("_lbl"))))
    here = run.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_bn") < F.col("_want"))).select(
        F.col("_lbl").alias("_cl"), F.col("_hb").alias("_cb"), (F.col("_want") - F.col("_upto") + F.col("_bn")).alias("_nth"))
    own = slim.join(F.broadcast(here), slim["_lbl"].eqNullSafe(here["_cl"]) & (slim["_hb"] == here["_cb"]))
    ends = own.withColumn("_i", F.row_number().over(Window.partitionBy("_lbl").orderBy("_at"))).where(
        F.col("_i") == F.col("_nth")).select(F.col("_lbl").alias("_cl"), F.col("_at").alias(out))
    checkpoint_dir(df.sparkSession)
    ends = ends.checkpoint(eager=True)  # found once, however often the split is read
    # one row per class: by a shuffle, all rows of a class would meet in one task
    return df.join(F.broadcast(ends), lbl.eqNullSafe(F.col("_cl")), "left").drop("_cl")


def stratified_split(df: DataFrame, label: str, test_frac: float = 0.2, seed: int = 42,
                     key_cols: list[str] | None = None, out: str = "part",
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """M1: per class the first ``ceil(test_frac * n)`` rows (seeded hash order) are ``test``.

    Rows of a class with equal keys fall on the same side; give keys that tell rows apart for exact sizes.
    ``df`` is scanned four times: hand in a stored table.
    """
    keys = key_cols or [c for c in df.columns if c != label]
    j = _with_ends(df, label, test_frac, seed, keys, "_end")
    return j.withColumn(out, F.when(_spot(keys, seed) <= F.col("_end"), names[1]).otherwise(names[0])).drop("_end")


def nested_split(df: DataFrame, label: str, test_frac: float = 0.2, valid_frac: float = 0.2, seed: int = 42,
                 key_cols: list[str] | None = None, out: str = "part") -> DataFrame:
    """M2: holdout first, then validation out of the remaining training rows."""
    s = stratified_split(df, label, test_frac, seed, key_cols, out)
    test = s.where(F.col(out) == "test")
    rest = stratified_split(s.where(F.col(out) == "train").drop(out), label, valid_frac, seed + 1, key_cols, out,
                            ("train", "valid"))
    return rest.unionByName(test)


def positional_split(df: DataFrame, order: list[Column | str], train_frac: float = 0.8,
                     out: str = "part") -> DataFrame:
    """M3: the first ``floor(train_frac * n)`` rows in ``order`` are ``train``, the rest ``test``.

    Counts per range say in which range the last training row lies; only that range is put in order, all
    other rows are labelled where they are. ``df`` is scanned five times: hand in a stored table.
    """
    x = range_bucket(df, order)
    counts = x.groupBy("_rb").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: rows / BUCKET_ROWS of them
    run = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_rb"))).withColumn(
        "_cut", F.floor(F.lit(train_frac) * F.sum("_n").over(Window.partitionBy())))
    # the first range that holds a test row (behind all ranges where there is none)
    first = run.where(F.col("_upto") > F.col("_cut")).agg(
        F.min_by(F.struct("_rb", (F.col("_cut") - F.col("_upto") + F.col("_n")).alias("nth")), "_rb").alias("r")).first()["r"]
    at, nth = (first["_rb"], first["nth"]) if first else (2 ** 31 - 1, 0)
    rest = x.where(F.col("_rb") != at).withColumn(out, F.when(F.col("_rb") < at, "train").otherwise("test"))
    inside = Window.partitionBy("_rb").orderBy(_order_key(order))
    own = x.where(F.col("_rb") == at).withColumn("_i", F.row_number().over(inside)).withColumn(
        out, F.when(F.col("_i") <= nth, "train").otherwise("test")).drop("_i")
    return rest.unionByName(own).drop("_rb")


def stratified_folds(df: DataFrame, label: str, k: int = 15, seed: int = 42, key_cols: list[str] | None = None,
                     out: str = "fold") -> DataFrame:
    """Fold id in ``[0, k)``, dealt round-robin inside each class in seeded hash order,
    so every fold holds ``n_class // k`` or one more rows of each class."""
    keys = key_cols or [c for c in df.columns if c != label]
    r = class_rank(df, label, keys, seed)
    return r.withColumn(out, ((F.col("_crank") - 1) % k).cast("int")).drop("_crank", "_n")
