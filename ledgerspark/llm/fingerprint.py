"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text; where its low bits are all ones for
block size ``b = 2^k`` a piece ends, so boundaries follow content and an edit changes
only the pieces it touches. The fingerprint is ``b:signature:signature at 2b`` with one
base-64 character per piece. Two fingerprints are compared at a block size both have,
by edit distance, once they share a run of four characters.

Both hashes come from one running sum of ``byte * R^i`` (mod 2^64): a window or a piece
is a difference of two sums times a power of ``1/R``. Texts are hashed in blocks of a
megabyte, so a very long text needs no more memory than its own string.

``edit`` needs the next document in descending id order. Rows are dealt to id ranges by
fixed cut points (from a bounded, hash-chosen sample of ids) and sorted inside them; the
first document of each range (one per range) is also sent to the range before it, so no
window spans the table and the texts are shuffled once.

Cases: a null text is empty and has the fingerprint ``1::``; equal texts have equal
fingerprints and likeness 1; an empty text is like an empty one only; equal ids follow
each other in the order of their texts; a single row is its own next; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import shuffle_partitions, table

WINDOW, PIECES, RUN = 7, 64, 4
_BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_MASK = (1 << 64) - 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_B64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
_BYTE ^= _BYTE >> np.uint64(29)
SAMPLE_PER_RANGE = 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        take = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have:have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_POW: dict[str, np.ndarray] = {"up": _powers(_R, 1 << 12), "down": _powers(_R_INV, 1 << 12)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = min(max(n, 2 * len(_POW["up"])), _BLOCK + WINDOW + 1)
        _POW["up"], _POW["down"] = _powers(_R, max(size, n)), _powers(_R_INV, max(size, n))
    return _POW["up"], _POW["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _ends(data: bytes, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all piece ends at block size ``2^low``: position, rolling hash, running sum up to there
    (already shifted to the text's start)."""
    pos, roll, sums = [], [], []
    carry, mask = 0, np.uint64((1 << low) - 1)
    for at in range(0, len(data), _BLOCK):
        lead = min(at, WINDOW - 1)
        raw = np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - at) + lead, at - lead)
        up, down = _tables(len(raw) + 1)
        with np.errstate(over="ignore"):
            run = np.cumsum(_BYTE[raw] * up[:len(raw)])
            win = run.copy()
            win[WINDOW:] -= run[:-WINDOW]
            win *= down[:len(raw)]
            win = _mixed(win)
            if lead:
                win, run = win[lead:], run[lead:] - run[lead - 1]
            hit = np.flatnonzero((win & mask) == mask)
            scale = np.uint64(pow(_R, at - lead, 1 << 64))
            pos.append(hit + at)
            roll.append(win[hit])
            sums.append(np.uint64(carry) + run[hit] * scale)
            carry = (carry + int(run[-1]) * int(scale)) & _MASK
    tail = np.array([carry], np.uint64)
    return np.concatenate(pos), np.concatenate(roll), np.concatenate([*sums, tail])


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "1::"
    low = max(0, (len(data) // PIECES).bit_length() - 2)
    pos, roll, sums = _ends(data, low)
    k = low
    while True:  # the smallest block size with at most PIECES pieces
        mask = np.uint64((1 << k) - 1)
        keep = (roll & mask) == mask
        if keep.sum() < PIECES:
            break
        k += 1
    return f"{1 << k}:{_signature(len(data), pos, sums, keep)}:" + _signature(
        len(data), pos, sums, (roll & np.uint64((2 << k) - 1)) == np.uint64((2 << k) - 1))


def _signature(n: int, pos: np.ndarray, sums: np.ndarray, keep: np.ndarray) -> str:
    end = pos[keep] + 1
    upto = sums[:-1][keep]
    if not len(end) or end[-1] < n:  # the rest after the last boundary
        upto, end = np.append(upto, sums[-1]), np.append(end, n)
    start = np.concatenate([[0], end[:-1]])
    with np.errstate(over="ignore"):
        piece = upto.copy()
        piece[1:] -= upto[:-1]
        piece *= np.array([pow(_R_INV, int(s), 1 << 64) for s in start], np.uint64)
    return _B64[(_mixed(piece) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprint columns: the best comparison at a block size both carry."""
    def part(c, i):
        return F.element_at(F.split(c, ":"), i)

    def grams(s):
        return F.when(F.length(s) <= RUN, F.array(s)).otherwise(F.transform(
            F.sequence(F.lit(1), F.length(s) - (RUN - 1)), lambda i: F.substring(s, i, F.lit(RUN))))

    def close(x, y):
        shared = (F.length(x) > 0) & (F.length(y) > 0) & F.arrays_overlap(grams(x), grams(y))
        return F.when(shared, 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))).otherwise(F.lit(0.0))

    size_a, size_b = part(a, 1).cast("long"), part(b, 1).cast("long")
    return (F.when(a == b, F.lit(1.0))
            .when(size_a == size_b, F.greatest(close(part(a, 2), part(b, 2)), close(part(a, 3), part(b, 3))))
            .when(size_a == 2 * size_b, close(part(a, 2), part(b, 3)))
            .when(size_b == 2 * size_a, close(part(a, 3), part(b, 2)))
            .otherwise(F.lit(0.0))).cast("double")


# --------------------------------------------------------------------------- edits by the next document

def _with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows in ranges of descending id, sorted; ``own`` is false for the copy of the following range's first row."""
    n = shuffle_partitions(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = docs.count()
    rate = min(1.0, SAMPLE_PER_RANGE * n / max(total, 1))
    ids = sorted(r[0] for r in d.select("id").where(F.col("id").isNotNull() & (F.pmod(
        F.xxhash64(F.lit("ranges"), "id"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)).distinct().collect())
    cuts = sorted({ids[len(ids) * i // n] for i in range(1, n)}) if ids else []
    size = len(cuts) + 1
    # first row of each range: at most one id per range reaches the driver; range 0 holds the largest ids
    rest = d.select("id", _place(cuts, {})("id").getItem(0)["range"].alias("range"))
    firsts = {r["range"]: r["id"] for r in rest.groupBy("range").agg(F.max("id").alias("id")).collect()}
    used = sorted(firsts)
    # each range's first id also goes to the range before it, the very first one to the last
    ahead: dict = {}
    for i, r in enumerate(used):
        ahead.setdefault(firsts[r], []).append(used[i - 1])
    dealt = d.withColumn("go", F.explode(_place(cuts, ahead)("id")))
    return dealt.select("id", "text", "go.range", "go.own"), size


def _place(cuts: list, ahead: dict):
    @F.pandas_udf("array<struct<range:int,own:boolean>>")
    def place(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            i = None if pd.isna(i) else i
            where = len(cuts) if i is None else len(cuts) - bisect_right(cuts, i)
            out.append([{"range": where, "own": True}] + [{"range": r, "own": False} for r in ahead.get(i, ())])
        return pd.Series(out, dtype=object)

    return place


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint`` where ``edited``
    has the last ``floor(n/2)`` code points replaced by the first as many (or all) of the next document."""
    dealt, n = _with_next(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None      # (range, id, text, fingerprint, own) still waiting for its next document
        for pdf in batches:
            out = []
            for rid, text, where, own in zip(pdf["id"], pdf["text"], pdf["range"], pdf["own"]):
                if held is not None and held[0] == where and not held[4]:
                    continue  # behind the looked-ahead row nothing of this range follows
                mine = fingerprint(text)
                if held is not None and held[0] == where:
                    out.append(_row(held, text, mine))
                held = (where, rid, text, mine, bool(own))
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                                             "next_fingerprint"])

    out = dealt.repartitionById(n, F.col("range")).sortWithinPartitions(
        F.col("range"), F.col("own").desc(), F.col("id").desc_nulls_last(), F.col("text")).mapInPandas(
        run, f"id {id_type}, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
             "next_fingerprint string")
    return out.withColumnRenamed("id", id_col)


def _row(held, text, mine):
    own = held[2]
    half = len(own) // 2
    edited = own[:len(own) - half] + text[:half]
    return held[1], len(own), edited, held[3], fingerprint(edited), mine


# --------------------------------------------------------------------------- query

def op4_fingerprint(spark, sf_dir):
    p = fingerprint_pairs(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
