"""Removal of repeated byte strings by sorting sampled suffixes.

A byte goes when a string of ``length`` (50) bytes that covers it also starts in a document
with a smaller id. Sorting all suffixes externally by recursive induction writes tens of
bytes for every byte of text; the README gives the figures. What is kept of that method
is its core: only a content-chosen sample of suffixes is sorted, with their common context,
and the answer for all other positions is induced from the sample.

Sample: in every window of ``length`` bytes the position of the least hash of its 16-byte
strings (about one position in 18). Two equal windows choose the same position, so every
repeated window meets its copy at a sampled position. The *context* of a sampled position
(34 bytes before it, 50 from it on) holds all windows that contain it.

1. Sampled suffixes go as (hash of 16 bytes, hash of the context, document, position)
   through one external sort. Where an earlier document has the same context, all windows
   of the position are repeated: settled. Other contexts that share their 16 bytes with
   another document stay open.
2. The open positions' contexts are cut from their documents, sorted by the 16 bytes, and
   each of their (at most 35) windows looks for an equal one in an earlier document. The
   windows of one position overlap, so the answer is one byte range.
3. Ranges are gathered per document and cut out.

Scale: a task first settles what its own batch repeats and sends one context once, so a
passage that a third of all documents hold sends a row per batch, not per document. Strings
of 16 bytes with very many different contexts are found beforehand (``hot_strings``) and
never meet as one group: step 1 deals their rows by context, step 2 deals each of their
windows by its own hash, again after a task has settled what its batch repeats. Every
step is cut off by a checkpoint, after which the shuffle files of the step are removed.
Hashes have 64 bits.

Cases: null and empty texts have 0 bytes and nothing to remove; a null id counts as the
smallest; documents with the same id
are never earlier than each other, whatever their texts; a repeat inside one document
stays; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, release_memory, shuffle_partitions, table

SEED = 16
_SEGMENT = 1 << 18
_MARGIN = 200
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(1234).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        take = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have:have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_UP, _DOWN = _powers(_R, _SEGMENT + 2 * _MARGIN + 1), _powers(_R_INV, _SEGMENT + 2 * _MARGIN + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        a = pick(a[:-have], a[have:])
        have *= 2
    return pick(a[:len(a) - (width - have)], a[width - have:]) if have < width else a


def _sample_segment(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, w = len(raw), length - SEED + 1
    with np.errstate(over="ignore"):
        b = _BYTE[raw]
        run = np.concatenate([[np.uint64(0)], np.cumsum(b * _UP[:n])])
        h, size = b, 1
        while size < SEED:
            h = h[:-size] * np.uint64(pow(_R, size, 1 << 64)) + h[size:]
            size *= 2
    h = _mix(h)
    least = _slide(h, w, np.minimum)                       # of the window that starts here
    pad = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), w, np.maximum)   # over the windows that hold a position
    at = np.flatnonzero(most == h)
    lo, hi = np.maximum(at - (length - SEED), 0), np.minimum(at + length, n)
    with np.errstate(over="ignore"):
        context = (run[hi] - run[lo]) * _DOWN[lo] + _mix((at - lo).astype(np.uint64) * np.uint64(1000) + (hi - at).astype(np.uint64) + np.uint64(7))
    return at, h[at], _mix(context)


def sample(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, hash of their 16 bytes, hash of their context; none where no window fits."""
    n = len(data)
    if n < length:
        e = np.empty(0, np.uint64)
        return np.empty(0, np.int64), e, e
    out = []
    for at in range(0, n, _SEGMENT):
        lo, hi = max(0, at - _MARGIN), min(n, at + _SEGMENT + _MARGIN)
        if hi - lo < length:  # a short tail: its windows begin in the segment before
            lo = max(0, hi - length - _MARGIN)
        pos, seed, context = _sample_segment(np.frombuffer(data, np.uint8, hi - lo, lo), length)
        pos = pos + lo
        own = (pos >= at) & (pos < at + _SEGMENT)
        out.append((pos[own], seed[own], context[own]))
    return tuple(np.concatenate(c) for c in zip(*out))


_SAMPLED = "seed long, context long, doc long, rid long, pos int, settled boolean"


def _first_of_groups(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest ``doc`` of each row's group of equal ``key``, and the rows' order by (key, doc)."""
    order = np.lexsort((doc, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.empty(len(k), doc.dtype)
    first[order] = doc[order][new][np.cumsum(new) - 1]
    return first, order


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _sampled_rows(batches: Iterator[pd.DataFrame], length: int, hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """The ``seed`` of a hot string's row is its context: what it is dealt by."""
    release_memory()
    for pdf in batches:
        parts, sizes = [], []
        for text in pdf["text"]:
            parts.append(sample(text.encode("utf-8", "surrogatepass"), length) if text else ((), (), ()))
            sizes.append(len(parts[-1][0]))
        if not sum(sizes):
            continue
        pos, seed, context = (np.concatenate([p[i] for p in parts if len(p[0])]) for i in range(3))
        doc, rid = np.repeat(pdf["doc"].to_numpy(), sizes), np.repeat(pdf["rid"].to_numpy(), sizes)
        first, _ = _first_of_groups(context, doc)
        seed = np.where(_among(seed.astype(np.int64), hot), context, seed)
        yield pd.DataFrame({"seed": seed.astype(np.int64), "context": context.astype(np.int64), "doc": doc, "rid": rid,
                            "pos": pos.astype(np.int32), "settled": doc > first})
    release_memory()


def _runs(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Frames that hold whole runs of ``seed``."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < least:
            continue
        x = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        seeds = x["seed"].to_numpy()
        cut = int(np.argmax(seeds == seeds[-1]))
        if cut:
            yield x.iloc[:cut]
        held, rows = [x.iloc[cut:]], len(x) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 1: settled positions, and open ones of hot strings or of runs with several contexts and documents."""
    for x in _runs(batches, 100_000):
        seed, context, doc = (x[c].to_numpy() for c in ("seed", "context", "doc"))
        here = x["settled"].to_numpy()
        first, _ = _first_of_groups(context, doc)
        settled = here | (doc > first)
        new = np.ones(len(x), bool)
        new[1:] = seed[1:] != seed[:-1]
        run = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        many = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) & (
            np.minimum.reduceat(context, at) != np.maximum.reduceat(context, at))
        open_ = ~settled & (many[run] | (seed == context))
        keep = settled | open_
        if keep.any():
            y = x.loc[keep, ["doc", "rid", "pos"]].reset_index(drop=True)
            y["open"] = open_[keep]
            yield y


#: ``left`` of rows from ``pos`` to ``right``: one window still to be compared, or bytes known to be repeated
_WINDOW, _KNOWN = -1, -2


def _window_rows(x: pd.DataFrame, m: np.ndarray, length: int) -> pd.DataFrame:
    """The windows around hot strings, each as a row dealt by its hash. What a window of the same frame
    repeats is known already and dealt by its place; so an equal window is sent once a frame."""
    before = length - SEED
    doc, rid, pos, left, right = (x[c].to_numpy() for c in ("doc", "rid", "pos", "left", "right"))
    with np.errstate(over="ignore"):
        run = np.zeros((len(x), m.shape[1] + 1), np.uint64)
        np.cumsum(_BYTE[m] * _UP[:m.shape[1]], axis=1, out=run[:, 1:])
    parts = []
    for o in range(before, -1, -1):  # windows that begin o bytes before the position
        fit = np.flatnonzero((left >= o) & (right >= length - o))
        a = before - o
        with np.errstate(over="ignore"):
            key = _mix((run[fit, a + length] - run[fit, a]) * _DOWN[a]).astype(np.int64)
        parts.append((key, doc[fit], rid[fit], pos[fit].astype(np.int64) - o))
    key, doc, rid, start = (np.concatenate(c) for c in zip(*parts))
    first, _ = _first_of_groups(key, doc)
    known = doc > first
    out = pd.DataFrame({"seed": key, "doc": doc, "rid": rid, "pos": start, "left": _WINDOW, "right": start + length})[~known]
    out = out.drop_duplicates()  # neighbouring positions share windows
    doc, rid, start = doc[known], rid[known], start[known]
    if len(doc):  # overlapping known windows are one range
        order = np.lexsort((start, rid, doc))
        doc, rid, start = doc[order], rid[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + length)
        at = np.flatnonzero(new)
        end = start[np.append(at[1:], len(doc)) - 1] + length
        with np.errstate(over="ignore"):
            place = _mix(doc[at].astype(np.uint64) * np.uint64(_R) + start[at].astype(np.uint64)).astype(np.int64)
        out = pd.concat([out, pd.DataFrame({"seed": place, "doc": doc[at], "rid": rid[at], "pos": start[at], "left": _KNOWN,
                                            "right": end})], ignore_index=True)
    out["bytes"] = None
    return out.astype({"pos": np.int32, "left": np.int32, "right": np.int32})


def _contexts(batches: Iterator[pd.DataFrame], length: int, hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """Step 2: the context bytes of each open position, zero-padded, with the bytes there are on each side;
    in place of a hot string's context, its windows."""
    before = length - SEED

    def frame(out: list) -> pd.DataFrame:
        x = pd.DataFrame(out, columns=["doc", "rid", "pos", "left", "right", "bytes"])
        m = np.frombuffer(b"".join(x["bytes"]), np.uint8).reshape(len(x), -1)
        x.insert(0, "seed", _string_hash(m[:, before:before + SEED]).astype(np.int64))
        own = _among(x["seed"].to_numpy(), hot)
        if own.any():
            x = pd.concat([x[~own], _window_rows(x[own], m[own], length)], ignore_index=True)
        return x

    for pdf in batches:
        out: list = []
        for doc, rid, text, open_ in zip(pdf["doc"], pdf["rid"], pdf["text"], pdf["pos"]):
            data = text.encode("utf-8", "surrogatepass")
            padded = b"\0" * before + data + b"\0" * length
            for p in open_.tolist():
                out.append((doc, rid, p, min(before, p), min(length, len(data) - p), padded[p:p + before + length]))
            if len(out) >= 20_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)


def _string_hash(m: np.ndarray) -> np.ndarray:
    """The hash of 16 bytes that ``sample`` gives."""
    with np.errstate(over="ignore"):
        return _mix((_BYTE[m] * _UP[:m.shape[1]][::-1]).sum(1, dtype=np.uint64))


def _match(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Step 2: the byte range that equal windows of earlier documents cover around each open position, or
    the windows themselves."""
    before = length - SEED
    for x in _runs(batches, 20_000):
        single = x["left"].to_numpy() < 0
        if single.any():
            w, x = x[single], x[~single]
            first, _ = _first_of_groups(w["seed"].to_numpy(), w["doc"].to_numpy())
            w = w[(w["left"].to_numpy() == _KNOWN) | (w["doc"].to_numpy() > first)]
            if len(w):
                yield w[["doc", "rid", "pos", "right"]].set_axis(["doc", "rid", "start", "end"], axis=1)
            if not len(x):
                continue
        doc, pos = x["doc"].to_numpy(), x["pos"].to_numpy().astype(np.int64)
        left, right = x["left"].to_numpy(), x["right"].to_numpy()
        m = np.frombuffer(b"".join(x["bytes"]), np.uint8).reshape(len(x), -1)
        with np.errstate(over="ignore"):
            run = np.zeros((len(x), m.shape[1] + 1), np.uint64)
            np.cumsum(_BYTE[m] * _UP[:m.shape[1]], axis=1, out=run[:, 1:])
        start, end = np.full(len(x), -1, np.int64), np.full(len(x), -1, np.int64)
        for o in range(before, -1, -1):  # windows that begin o bytes before the position
            fit = np.flatnonzero((left >= o) & (right >= length - o))
            if len(fit) < 2:
                continue
            a = before - o
            with np.errstate(over="ignore"):
                key = _mix((run[fit, a + length] - run[fit, a]) * _DOWN[a])
            first, _ = _first_of_groups(key, doc[fit])
            hit = fit[doc[fit] > first]
            start[hit] = np.where(start[hit] < 0, pos[hit] - o, start[hit])
            end[hit] = pos[hit] - o + length
        got = start >= 0
        if got.any():
            yield pd.DataFrame({"doc": doc[got], "rid": x["rid"].to_numpy()[got], "start": start[got].astype(np.int32),
                                "end": end[got].astype(np.int32)})


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return list(zip(s[at].tolist(), np.maximum.reduceat(e, at).tolist()))


def hot_strings(d: DataFrame, length: int = 50, hot_rows: int = 20_000, share: int = 16) -> np.ndarray:
    """Hashes (sorted) of the sampled strings that would bring about ``hot_rows`` rows or more together, counted
    on one in ``share`` documents. Only how rows are dealt depends on it, no result. At most the sampled
    positions / ``hot_rows`` of them."""
    none = np.empty(0, np.int64)
    part = d.where(F.pmod(F.xxhash64(F.lit("hot"), "doc", "text"), F.lit(share)) == 0)
    rows = part.mapInPandas(lambda b: _sampled_rows(b, length, none), _SAMPLED).where("NOT settled")
    many = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share >= hot_rows)
    return np.array(sorted(r["seed"] for r in many.select("seed").collect()), np.int64)


def _open_contexts(d: DataFrame, marks: DataFrame, length: int, hot) -> DataFrame:
    """What step 2 compares, before it is dealt by ``seed``; ``hot`` is the broadcast list of hot strings."""
    texts = d.join(marks.where(F.size("pos") > 0).select("doc", "rid", "pos"), ["doc", "rid"])
    return texts.select("doc", "rid", "text", "pos").mapInPandas(
        lambda b: _contexts(b, length, hot.value), "seed long, doc long, rid long, pos int, left int, right int, bytes binary")


def _marks(d: DataFrame, length: int, hot) -> DataFrame:
    """Step 1: ``settled`` and open (``pos``) positions per document."""
    n = shuffle_partitions(d.sparkSession)
    rows = d.mapInPandas(lambda b: _sampled_rows(b, length, hot.value), _SAMPLED)
    # what a task has settled itself needs no meeting: dealt by document
    to = F.when(F.col("settled"), F.xxhash64("doc", "pos")).otherwise(F.col("seed"))
    dealt = rows.withColumn("seed", to).repartition(n, "seed").sortWithinPartitions("seed")
    marks = dealt.mapInPandas(_judge, "doc long, rid long, pos int, open boolean")
    return cut_lineage(marks.groupBy("doc", "rid").agg(
        F.collect_list(F.when(~F.col("open"), F.col("pos"))).alias("settled"),
        F.collect_list(F.when(F.col("open"), F.col("pos"))).alias("pos")))


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   hot_rows: int = 20_000, hot_share: int = 16) -> DataFrame:
    """``doc, rid, starts, ends``: byte ranges (they may overlap) of documents that have any; ``rid`` tells
    apart rows with the same id (0 where ids are unique)."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = keyed(docs, id_col, text_col)
    hot = spark.sparkContext.broadcast(hot_strings(d, length, hot_rows, hot_share))

    def opened(marks: DataFrame):
        dealt = _open_contexts(d, marks, length, hot).repartition(n, "seed").sortWithinPartitions("seed")
        return cut_lineage(dealt.mapInPandas(lambda b: _match(b, length), "doc long, rid long, start int, end int")
                           .groupBy("doc", "rid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))

    marks = _marks(d, length, hot)
    spans = opened(marks)
    before = length - SEED
    settled = marks.where(F.size("settled") > 0).select(
        "doc", "rid", F.transform("settled", lambda p: F.greatest(p - before, F.lit(0))).alias("starts"),
        F.transform("settled", lambda p: p + length).alias("ends"))
    return settled.unionByName(spans).groupBy("doc", "rid").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    d = d.select(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "text")
    return d.withColumn("rid", F.xxhash64("doc", "text") if _twice(d, "doc") else F.lit(0).cast("long"))


def _twice(d: DataFrame, id_col: str) -> bool:
    return bool(d.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id, n_bytes, spans`` (array of removed byte ranges) and ``kept`` (the remaining bytes)."""
    spans = repeated_spans(docs, length, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, starts, ends in zip(pdf["doc"], pdf["text"], pdf["starts"], pdf["ends"]):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                own = [] if starts is None else [(s, min(e, len(data))) for s, e in merge_spans(np.asarray(starts), np.asarray(ends))]
                edges = [0, *(x for s in own for x in s), len(data)]
                out.append((doc, len(data), [{"start": s, "end": e} for s, e in own],
                            b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "spans", "kept"])

    d = keyed(docs, id_col, text_col)
    out = d.join(spans, ["doc", "rid"], "left").select("doc", "text", "starts", "ends").mapInPandas(
        cut, "doc long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn(id_col, F.when(F.col("doc") != -(1 << 63), F.col("doc"))).select(id_col, "n_bytes", "spans", "kept")


def cut_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text_col``, all columns kept. A character of which a part
    is repeated goes whole; null stays null."""
    spans = repeated_spans(docs, length, id_col, text_col)
    d = docs.withColumn("_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    d = d.withColumn("_rid", F.xxhash64("_doc", text_col) if _twice(d, "_doc") else F.lit(0).cast("long"))
    j = d.join(spans.select(F.col("doc").alias("_doc"), F.col("rid").alias("_rid"), F.col("starts").alias("_starts"),
                            F.col("ends").alias("_ends")), ["_doc", "_rid"], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, s, e in zip(texts, starts, ends):
            if text and s is not None:
                data = text.encode("utf-8", "surrogatepass")
                edges = [0, *(x for span in merge_spans(np.asarray(s), np.asarray(e)) for x in span), len(data)]
                text = "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
            out.append(text)
        return pd.Series(out, dtype=object)

    return j.withColumn(text_col, cut(F.col(text_col), "_starts", "_ends")).select(*docs.columns)


# --------------------------------------------------------------------------- query

def op10_suffix_dedup(spark, sf_dir):
    r = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))
