"""Embedding near-duplicates by randomised-rotation binary codes.

Every unit vector is rotated by a fixed random orthogonal matrix; the signs are its code
and the inner product of code and vector its stored correction factor. For a pair, the
code of one side and the four-bit quantised rotation of the other give an unbiased
estimate of the cosine (population counts only) with a known spread; a pair is computed
exactly, in double precision, unless even the estimate plus ``sigmas`` times that spread
stays below the threshold.

Candidates: pairs that agree on the signs of ``k`` random directions in one of ``tables``
tables. ``k`` grows with log2 of the number of vectors, so buckets stay small, and the
number of tables follows from ``miss``, the largest chance that a pair exactly at the
threshold meets in none. All pairs of a bucket are looked at, however large it is (see
``pairs``), each in the first table where the two meet. Pairs are never emitted: a task
returns per vector the number of links found and one edge to its local root.

Equal vectors are one row with a weight from the start. Vectors of different lengths are
never compared.

Cases: vectors that are null, empty, all zero, or hold a null or non-finite component,
and vectors without an id, link with nothing and are their own component; repeated rows are vectors of their own that
link with each other (rows that share an id but not the vector share its links); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import table
from ledgerspark.llm.pairs import connected_components, deal_buckets, local_roots, run_numbers, run_pairs, whole_runs

_SEED = 20_24


def _rotation(size: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([_SEED, size, number]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def plan_tables(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits per table, tables)."""
    bits = min(60, max(6, math.ceil(math.log2(max(rows, 2))) - 4))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree ** bits)))


def _record(dims: int) -> np.dtype:
    w = -(-dims // 64)
    return np.dtype([("v", "<f8", (dims,)), ("code", "<u8", (w,)), ("planes", "<u8", (4, w)), ("factor", "<f8"),
                     ("low", "<f8"), ("step", "<f8")])


def _codes(u: np.ndarray) -> np.ndarray:
    """Records of unit vectors: the vector, its code and correction factor, its quantised rotation."""
    n, dims = u.shape
    w = -(-dims // 64)
    size = 64 * w
    o = np.zeros((n, size))
    o[:, :dims] = u
    o = o @ _rotation(size, 0).T
    out = np.zeros(n, _record(dims))
    out["v"] = u
    out["code"] = np.packbits(o > 0, axis=1, bitorder="little").view("<u8")
    out["factor"] = np.abs(o).sum(1) / math.sqrt(size)
    out["low"] = o.min(1)
    out["step"] = np.maximum((o.max(1) - out["low"]) / 15, 1e-12)
    q = np.rint((o - out["low"][:, None]) / out["step"][:, None]).astype(np.uint8)
    for b in range(4):
        out["planes"][:, b] = np.packbits((q >> b) & 1, axis=1, bitorder="little").view("<u8")
    return out


def _keys(u: np.ndarray, bits: int, tables: int) -> np.ndarray:
    n, dims = u.shape
    need = bits * tables
    signs = np.concatenate([u @ _rotation(dims, 1 + i).T > 0 for i in range(-(-need // dims))], axis=1)[:, :need]
    return signs.reshape(n, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine of the record pairs and the spread of the estimate."""
    size = 64 * a["code"].shape[1]
    ones = np.bitwise_count(a["code"]).sum(1, dtype=np.int64)
    both = sum((1 << i) * np.bitwise_count(a["code"] & b["planes"][:, i]).sum(1, dtype=np.int64) for i in range(4))
    all_ = sum((1 << i) * np.bitwise_count(b["planes"][:, i]).sum(1, dtype=np.int64) for i in range(4))
    inner = (2 * (b["low"] * ones + b["step"] * both) - (size * b["low"] + b["step"] * all_)) / math.sqrt(size)
    f = a["factor"]
    spread = np.sqrt(np.maximum(1 - f * f, 0) / (size - 1) + b["step"] ** 2 / 12) / f
    return inner / f, spread


def _links(x: pd.DataFrame, threshold: float, sigmas: float, most: int) -> pd.DataFrame:
    """Per row of whole runs that has a link: ``id, n, root``."""
    out = []
    for width, part in x.groupby(x["record"].map(len)):
        dims = next(d for d in range(1, width // 8 + 1) if _record(d).itemsize == width)
        rec = np.frombuffer(b"".join(part["record"]), _record(dims))
        keys = np.frombuffer(b"".join(part["keys"]), "<i8").reshape(len(part), -1)
        ids, weight = part["id"].to_numpy(), part["w"].to_numpy()
        at, group = part["t"].to_numpy(), part["grp"].to_numpy()
        cross = (part["lo"] != part["hi"]).to_numpy()
        count, li, lj = np.zeros(len(part), np.int64), [], []
        root = np.arange(len(part))
        for i, j in run_pairs(run_numbers(part), most):
            fit = ~cross[i] | (group[i] != group[j])
            i, j = i[fit], j[fit]
            near, spread = estimate(rec[i], rec[j])
            fit = near + sigmas * spread >= threshold
            i, j = i[fit], j[fit]
            met = ((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < at[i][:, None])).any(1)
            i, j = i[~met], j[~met]
            fit = np.einsum("ij,ij->i", rec["v"][i], rec["v"][j]) >= threshold
            i, j = i[fit], j[fit]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            near_roots = local_roots(len(part), np.concatenate([root, i]), np.concatenate([np.arange(len(part)), j]))
            root = near_roots
        hit = count > 0
        out.append(pd.DataFrame({"id": ids[hit], "n": count[hit], "root": ids[root[hit]]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "n": [], "root": []})


def link_embeddings(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                    miss: float = 1e-3, sigmas: float = 4.0, block_rows: int = 1024) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("e", lambda c: c != 0)
    good = F.coalesce(finite, F.lit(False)) & F.col("id").isNotNull()
    reps = v.where(good).groupBy("e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    bits, tables = plan_tables(vectors.count(), threshold, miss)

    def unit(rows: pd.Series) -> np.ndarray:
        a = np.stack(rows.to_list()).astype(float)
        a /= np.abs(a).max(1, keepdims=True)
        return a / np.sqrt((a * a).sum(1, keepdims=True))

    def bucket_of(dims: int, keys: np.ndarray) -> np.ndarray:
        t = np.arange(keys.shape[1], dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (t + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
                 + np.uint64(dims)) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))).astype(np.int64)

    def only_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, part in pdf.groupby(pdf["e"].map(len)):
                yield pd.DataFrame({"bucket": bucket_of(dims, _keys(unit(part["e"]), bits, tables)).ravel()})

    def spread_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, all_rows in pdf.groupby(pdf["e"].map(len)):
                for at in range(0, len(all_rows), 1000):
                    part = all_rows.iloc[at:at + 1000]
                    u = unit(part["e"])
                    keys = _keys(u, bits, tables)
                    rec = _codes(u)
                    n = len(part)
                    yield pd.DataFrame({
                        "bucket": bucket_of(dims, keys).ravel(), "t": np.tile(np.arange(tables, dtype=np.int32), n),
                        "id": np.repeat(part["id"].to_numpy(), tables), "w": np.repeat(part["w"].to_numpy(), tables),
                        "record": np.repeat(np.array([r.tobytes() for r in rec], object), tables),
                        "keys": np.repeat(np.array([k.astype("<i8").tobytes() for k in keys], object), tables)})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_runs(batches, 4 * block_rows):
            yield _links(x, threshold, sigmas, 1 << 18)

    sizes = reps.select("e").mapInPandas(only_buckets, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rows = reps.select("id", "w", "e").mapInPandas(spread_out, "bucket long, t int, id long, w long, record binary, keys binary")
    # a vector alone in its bucket has no partner there
    found = deal_buckets(rows, sizes, block_rows).mapInPandas(judge, "id long, n long, root long")
    from ledgerspark.llm.common import cut_lineage
    found = cut_lineage(found)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    own = v.where(good).join(reps.select("e", F.col("id").alias("rep"), "w"), "e").select("id", "rep", "w")
    own = own.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    linked = own.select("id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id"))
    alone = v.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


# --------------------------------------------------------------------------- query

def op6_embedding_near_dedup(spark, sf_dir):
    return link_embeddings(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id,
       vec_id <= coalesce(c.y, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""
