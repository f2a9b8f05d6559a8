"""Pairs inside buckets without emitting them, and connected components.

A *bucket* is a key under which rows become candidates. Rows are dealt by bucket and
sorted, so a task sees each bucket as a run. Buckets larger than ``block_rows`` are cut
into groups by a hash of the row and every pair of groups is its own run: the work of a
hot bucket spreads over many tasks and no run is larger than two groups. Inside a run
pairs exist only as index arrays of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, shuffle_partitions

#: the table of large buckets is broadcast up to this many rows (16 bytes each), joined by shuffle beyond
BROADCAST_ROWS = 100_000


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. sizes[0]-1, 0, 1, .. sizes[1]-1, .."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def run_pairs(run: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, with equal ``run`` (sorted run numbers), about ``most`` at a time."""
    n = len(run)
    if n < 2:
        return
    end = np.searchsorted(run, run, side="right")
    later = end - np.arange(n) - 1
    upto = np.cumsum(later)
    at = 0
    while at < n:
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + most, side="right")))
        c = later[at:stop]
        if c.sum():
            i = np.repeat(np.arange(at, stop), c)
            yield i, i + 1 + ramp(c)
        at = stop


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row it is connected with by the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        open_ = lo < hi
        if not open_.any():
            break
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        i, j = i[open_], j[open_]
    return root


def deal_buckets(rows: DataFrame, sizes: DataFrame, block_rows: int, id_col: str = "id") -> DataFrame:
    """``rows`` (with a long ``bucket``) dealt and sorted so that equal (``bucket, lo, hi``) are neighbours;
    ``grp`` is the row's group. ``sizes`` has the ``bucket, n`` of all rows."""
    spark = rows.sparkSession
    big = cut_lineage(sizes.where(F.col("n") > block_rows).select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("g")))
    n_big = big.count()
    if n_big == 0:
        x = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("grp", F.lit(0))
    else:
        x = rows.join(F.broadcast(big) if n_big <= BROADCAST_ROWS else big, "bucket", "left")
        x = x.withColumn("g", F.coalesce("g", F.lit(1))).withColumn("grp", F.pmod(F.xxhash64(F.lit("grp"), id_col), F.col("g")).cast("int"))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        x = x.withColumn("lo", F.least("grp", "other")).withColumn("hi", F.greatest("grp", "other")).drop("g", "other")
    n = shuffle_partitions(spark)
    return x.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def whole_runs(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Frames of whole runs, each of ``least`` rows or more where there are as many."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < least:
            continue
        x = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = x.iloc[-1]
        tail = ((x["bucket"] == last["bucket"]) & (x["lo"] == last["lo"]) & (x["hi"] == last["hi"])).to_numpy()
        cut = len(x) - int(tail.sum())
        if cut:
            yield x.iloc[:cut]
        held, rows = [x.iloc[cut:]], len(x) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def run_numbers(x: pd.DataFrame) -> np.ndarray:
    b, lo, hi = (x[c].to_numpy() for c in ("bucket", "lo", "hi"))
    new = np.ones(len(x), bool)
    new[1:] = (b[1:] != b[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return np.cumsum(new)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of the nodes of ``edges`` (``u, v``).

    Alternating large-star and small-star rounds; every round is checkpointed. A node with
    very many edges is only ever a key of a minimum (combined before the shuffle) and of a
    join that can be split at run time.
    """
    e = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).where("x > y").distinct()
    e = cut_lineage(e)
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        near = large.join(least, "x")
        small = near.where(F.col("y") > F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(
            least.select("x", F.col("m").alias("y")))
        e = cut_lineage(small.where("x > y").distinct())
    roots = e.groupBy("x").agg(F.min("y").alias("component")).select(F.col("x").alias("node"), "component")
    return roots.unionByName(e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct().join(
        roots.select("node"), "node", "left_anti"))
