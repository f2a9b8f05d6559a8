"""Jaccard join of documents on word n-grams with Bayesian pruning.

A document's set is its word n-grams (lower-cased, split at white space). MinHash values
estimate the similarity of two sets; documents meet as candidates where all values of a
band agree. A candidate pair compares its MinHash values a block at a time and is dropped
once the posterior probability (uniform prior) that its similarity reaches the threshold
falls below ``tolerance``; what is left is verified on the sets themselves.

1. One pass over the texts: MinHash values and a digest of the set. Documents with equal
   sets become one row with a weight.
2. Keys of bands are counted first; only keys that two or more documents share get the
   values attached. Buckets are judged in runs of bounded size (see ``pairs``); a task
   returns one edge per surviving document, not the pairs.
3. The components of these edges bound who can still be linked. Their members' sets are
   dealt by component, blocks of a large component against blocks; every pair goes
   through the same pruning and, if it survives, the exact comparison. A task returns the
   number of links per document and one edge to its local root.

With 25 bands of 5 values a pair exactly at similarity 0.8 is missed with probability
5e-5, and the chance falls fast above.

Cases: a text with fewer than n words is one n-gram of all its words; null, empty and
blank texts link with nothing and are their own class; repeated rows, and rows that share an
id but not the text, are documents of their own (inside, a row has a number of its own; the
class id is the smallest id, and of the rows that have it in a class one is kept); a row
without an id links with nothing and is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, release_memory, small_batches, table
from ledgerspark.llm.pairs import (BROADCAST_ROWS, connected_components, deal_buckets, local_roots, run_numbers, run_pairs,
                                   whole_runs)

BANDS, ROWS, VALUES, BLOCK = 25, 5, 128, 16
_CACHE_WORDS = 150_000
_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def _new(self, word: str) -> int:
        if len(self.known) >= _CACHE_WORDS:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        get, new = self.known.get, self._new
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            s = h[:len(h) - n + 1] * _PLACE[0]
            for k in range(1, n):
                s = s + h[k:len(h) - n + 1 + k] * _PLACE[k]
        return np.unique(_mix(s + np.uint64(n)))


def minhash(s: np.ndarray) -> np.ndarray:
    """Sixteen bits each of the minima under VALUES hash functions."""
    low = np.full(VALUES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            np.minimum(low, (_MUL[:, None] * s[None, at:at + 4096] + _ADD[:, None]).min(1), out=low)
    return (_mix(low) >> np.uint64(48)).astype("<u2")


def needed_matches(threshold: float, tolerance: float) -> list[int]:
    """Per number of compared blocks, the fewest equal values for which
    P(similarity >= threshold | matches) is still ``tolerance`` or more."""
    def posterior(m: int, n: int) -> float:  # 1 - I_threshold(m + 1, n - m + 1)
        return sum(math.comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    out = []
    for n in range(BLOCK, VALUES + 1, BLOCK):
        out.append(next(m for m in range(n + 1) if posterior(m, n) >= tolerance))
    return out


def prune(a: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that survive the incremental comparison of their MinHash values."""
    same = np.zeros(len(i), np.int64)
    for b, least in enumerate(needed):
        at = slice(b * BLOCK, (b + 1) * BLOCK)
        same = same + (a[i, at] == a[j, at]).sum(1)
        keep = same >= least
        if not keep.all():
            i, j, same = i[keep], j[keep], same[keep]
    return i, j


def _decode(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), VALUES)


def _fitting(x: pd.DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cross, group = (x["lo"] != x["hi"]).to_numpy(), x["grp"].to_numpy()
    for i, j in run_pairs(run_numbers(x), most):
        fit = ~cross[i] | (group[i] != group[j])
        yield i[fit], j[fit]


def _survivors(x: pd.DataFrame, needed: list[int]) -> pd.DataFrame:
    """An edge to its local root for every row of whole runs that survives with another."""
    a, band = _decode(x["sig"]), x["band"].to_numpy()
    ids, root = x["id"].to_numpy(), np.arange(len(x))
    keys = a[:, :BANDS * ROWS].reshape(len(a), BANDS, ROWS)
    for i, j in _fitting(x, 1 << 17):
        met = np.zeros(len(i), bool)
        for b in range(BANDS):  # judged already in the first band where the two agree
            met |= (b < band[i]) & (keys[i, b] == keys[j, b]).all(1)
        i, j = prune(a, i[~met], j[~met], needed)
        root = local_roots(len(x), np.concatenate([root, i]), np.concatenate([np.arange(len(x)), j]))
    own = root != np.arange(len(x))
    return pd.DataFrame({"u": ids[own], "v": ids[root[own]]})


def _verified(x: pd.DataFrame, threshold: float, needed: list[int]) -> pd.DataFrame:
    """Per row of whole runs with a link: ``id, n, root``; similarities are exact."""
    a = _decode(x["sig"])
    ids, weight = x["id"].to_numpy(), x["w"].to_numpy()
    sizes = (x["grams"].map(len) // 8).to_numpy()
    start = np.concatenate([[0], np.cumsum(sizes)])
    _, local = np.unique(np.frombuffer(b"".join(x["grams"]), "<u8"), return_inverse=True)
    flag = np.zeros(int(local.max(initial=0)) + 1, bool)
    count, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for i, j in _fitting(x, 1 << 17):
        fit = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        i, j = prune(a, i[fit], j[fit], needed)
        linked = np.zeros(len(i), bool)
        for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
            row, others = i[own[0]], j[own]
            mine = local[start[row]:start[row + 1]]
            flag[mine] = True
            n = sizes[others]
            where = np.repeat(start[others], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            both = np.add.reduceat(flag[local[where]].astype(np.int64), np.cumsum(n) - n)
            flag[mine] = False
            linked[own] = both >= threshold * (sizes[row] + n - both)
        i, j = i[linked], j[linked]
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        root = local_roots(len(x), np.concatenate([root, i]), np.concatenate([np.arange(len(x)), j]))
    hit = count > 0
    return pd.DataFrame({"id": ids[hit], "n": count[hit], "root": ids[root[hit]]})


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-4, id_col: str = "doc_id",
                    text_col: str = "text", block_rows: int = 512, with_hash: bool = False) -> DataFrame:
    """One row per document: ``id, class_id`` (smallest id reachable by links), ``n_links`` (documents with
    similarity >= ``threshold``), ``kept`` (the class's representative). ``with_hash`` adds ``text_hash``, Spark's xxhash64
    of the text."""
    needed = needed_matches(threshold, tolerance)
    everyone = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    d = everyone.where("id IS NOT NULL")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        shingle = Shingler(n)
        for pdf in batches:
            sig, digest = [], []
            for t in pdf["text"]:
                s = shingle(t)
                sig.append(minhash(s).tobytes() if len(s) else None)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pd.DataFrame({"doc": pdf["id"], "h": pdf["h"], "digest": digest, "sig": sig})

    # ``id`` is from here on a row's own number
    with small_batches(docs.sparkSession):
        sketches = cut_lineage(d.mapInPandas(sketch, "doc long, h long, digest binary, sig binary").withColumn("id", F.monotonically_increasing_id()))
    full = sketches.where("sig IS NOT NULL")
    copies = full.groupBy("digest").agg(F.min(F.struct("doc", "id")).alias("first"), F.count(F.lit(1)).alias("w")).select(
        "digest", F.col("first.id").alias("rep"), "w")
    reps = cut_lineage(copies.join(full.select("digest", F.col("id").alias("rep"), "doc", "h", "sig"), ["digest", "rep"])
                       .select(F.col("rep").alias("id"), "doc", "h", "w", "sig"))

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a = _decode(pdf["sig"])[:, :BANDS * ROWS].reshape(len(pdf), BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = (a * _PLACE[:ROWS]).sum(2, dtype=np.uint64) + _ADD[:BANDS]
            yield pd.DataFrame({"bucket": _mix(h).astype(np.int64).ravel(), "id": np.repeat(pdf["id"].to_numpy(), BANDS),
                                "band": np.tile(np.arange(BANDS, dtype=np.int32), len(pdf))})

    keys = reps.select("id", "sig").mapInPandas(bands, "bucket long, id long, band int")
    sizes = cut_lineage(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = keys.join(sizes.select("bucket"), "bucket").join(reps.select("id", "sig"), "id")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_runs(batches, 4 * block_rows):
            yield _survivors(x, needed)

    near = deal_buckets(shared, sizes, block_rows).mapInPandas(judge, "u long, v long").distinct()
    members = cut_lineage(connected_components(near).join(reps.withColumnRenamed("id", "node"), "node")
                          .select(F.col("node").alias("id"), F.col("component").alias("bucket"), "doc", "h", "w", "sig"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "grams": [shingle(t).tobytes() for t in pdf["text"]]})

    own = members.select("id", "doc", "h")  # equal texts of one document are one member
    few = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    sets = d.withColumnRenamed("id", "doc").join(few, ["doc", "h"]).mapInPandas(grams, "id long, grams binary").dropDuplicates(["id"])
    rows = members.drop("doc", "h").join(sets, "id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_runs(batches, block_rows):
            yield _verified(x, threshold, needed)

    found = cut_lineage(deal_buckets(rows, members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), block_rows)
                        .mapInPandas(verify, "id long, n long, root long"))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    classes = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    own = sketches.select("doc", "h", "id", "digest").join(copies, "digest", "left").select(
        "doc", "h", "id", F.coalesce("rep", "id").alias("rep"), F.coalesce("w", F.lit(1)).alias("w"))
    linked = cut_lineage(own.join(links, "rep", "left").join(classes, "rep", "left").select(
        "doc", "h", "id", F.coalesce("component", "rep").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links")))
    # a row with links is in a class with others, whose first one is looked up; the rest are classes of their own
    heads = linked.where("n_links > 0").groupBy("class").agg(F.min(F.struct("doc", "id")).alias("head"))
    out = linked.join(heads, "class", "left").select(
        F.col("doc").alias("id"), F.coalesce("head.doc", "doc").alias("class_id"), "n_links",
        (F.col("id") == F.coalesce("head.id", "id")).alias("kept"), F.col("h").alias("text_hash"))
    nameless = everyone.where("id IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                                   F.lit(True).alias("kept"), F.col("h").alias("text_hash"))
    out = out.unionByName(nameless).withColumnRenamed("id", id_col)
    return out if with_hash else out.drop("text_hash")


# --------------------------------------------------------------------------- query

def op9_ngram_jaccard(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(c.y, doc_id)) AS class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links,
       doc_id <= coalesce(c.y, doc_id) AS kept
FROM documents LEFT JOIN c ON c.x = doc_id LEFT JOIN k ON k.x = doc_id"""
