"""Sequence packing by non-negative least squares over a length histogram.

Documents are tokenised (with an end id), cut at every ``window`` tokens, and the pieces
counted by length in units of ``unit`` tokens. All ways to fill the window with at most
``depth`` pieces are the columns of a matrix; non-negative least squares finds how often
to repeat each so that the histogram is used up. Counts are rounded down, never beyond
what the histogram holds, and the left-over pieces are packed greedily (largest first,
then the largest that still fits), again as repeated combinations. The plan has the size
of the histogram, whatever the number of documents.

Every piece then finds its place by arithmetic: its rank among the pieces of its size
names the combination, the repetition and the slot. Ranks come from counts per (size,
hash bucket) and prefix sums, so a size that a third of all pieces have is numbered by
many tasks. Token ids never move between tasks; a shuffle carries a few numbers a piece.

Cases: a null or empty text has the end id only; repeated rows are packed each on their
own (equal pieces share ranks in any order); an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, release_memory, small_batches, table
from ledgerspark.llm.id_cache import IdCache, byte_symbols

WINDOW, UNIT, DEPTH = 2048, 8, 3
_RANK_ROWS = 50_000       # pieces that one task numbers at a time
_CACHE_CHUNKS = 120_000   # chunks of text, and pieces of chunks, whose ids a worker remembers
_BATCH_BYTES = 4 << 20
_WHOLE = re.compile("[^\x00-\u024f]|<\\||[\x1c-\x1f\x85]")
_MARK, _END = "\x1f", "</w>"  # a word's end: in pieces, in the file
#: the kind of file that chunks are tokenised for: its pattern for the pieces of a chunk, and the settings around it
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _latin(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)


#: the same for lower-cased Latin chunks, one to a line
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|\n|[^\\s{_latin('L')}{_latin('N')}]+").findall


class _Tokenizer:
    """Ids of whole texts. The pre-tokeniser never joins text across white space, and what it cuts a chunk
    (text between ASCII spaces) into is merged piece by piece; so ids are remembered by chunk and by piece,
    a bounded number of each, and new pieces are merged by a fast library from the file's own vocabulary.
    Chunks with other than Latin letters, unusual control characters or what could be a special token go to
    the file's own tokenizer whole; so does all text where the file is not of the kind this is written for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.known = self._merges(json.load(f))
        self.chunks = IdCache(self._new_chunks, _CACHE_CHUNKS)
        self.pieces = IdCache(self._new_pieces, _CACHE_CHUNKS)
        self.pieces.hold("\n")  # parts the chunks

    @cached_property
    def lib(self):
        """The file's own tokenizer, loaded where it is needed."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def trim(self) -> None:
        self.chunks.trim()
        self.pieces.trim()

    def _merges(self, spec: dict) -> bool:
        """The file's merges in the fast library, a word's end being a byte of its own that joins the letter before it
        ahead of all merges; False where the file is of another kind."""
        model = spec["model"]
        if not (model["type"] == "BPE" and model.get("end_of_word_suffix") == _END and spec["normalizer"] == _NORMALIZER
                and spec["pre_tokenizer"] == _PRE_TOKENIZER and not any(model.get(k) for k in (
                    "dropout", "continuing_subword_prefix", "ignore_merges", "unk_token"))
                and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])):
            return False
        import tiktoken
        symbols, vocab = byte_symbols(), model["vocab"]

        def raw(token: str) -> bytes:
            return bytes(symbols[c] for c in token.removesuffix(_END)) + _MARK.encode() * token.endswith(_END)

        merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1) for m in model["merges"]]
        letters = [t for t in vocab if len(t.removesuffix(_END)) == 1]
        order = [t for t in letters if t.endswith(_END)] + merged + [t for t in letters if not t.endswith(_END)]
        ranks = {raw(t): i for i, t in enumerate(order)}
        if len(ranks) != len(order):
            return False
        self.own_id = np.array([vocab[t] for t in order], np.int32)
        self.ends = np.array([t.endswith(_END) for t in order], bool)
        ranks[_MARK.encode()] = len(order)  # never left alone
        self.fast = tiktoken.Encoding("own", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks=ranks, special_tokens={})
        return True

    def _new_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, size = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(pieces), 4000):
            got = np.array(self.fast.encode_ordinary(_MARK.join(pieces[at:at + 4000]) + _MARK), np.int64)
            flat.append(self.own_id[got])
            size.append(np.diff(np.flatnonzero(self.ends[got]) + 1, prepend=0))
        return np.concatenate(flat), np.concatenate(size)

    def _whole(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for at in range(0, len(strings), 10_000)
               for e in self.lib.encode_batch_fast(strings[at:at + 10_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes

    def _new_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join(new)  # no chunk holds one
        alone = [i for i, c in enumerate(new) if _WHOLE.search(c)] if _WHOLE.search(text) else []
        if alone:
            rest = list(new)
            for i in alone:
                rest[i] = ""
            text = "\n".join(rest)
        numbers = self.pieces.numbers(_PIECES(text.lower()))
        flat, size = self.pieces.take(numbers)
        upto = np.cumsum(size)
        sizes = np.diff(np.append(upto[numbers == self.pieces.number["\n"]], len(flat)), prepend=0)
        if not alone:
            return flat, sizes
        own, own_sizes = self._whole([new[i] for i in alone])
        sizes[alone] = own_sizes
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        inside = np.ones(len(out), bool)
        for i, part in zip(alone, np.split(own, np.cumsum(own_sizes)[:-1])):
            out[begin[i]:begin[i] + len(part)] = part
            inside[begin[i]:begin[i] + len(part)] = False
        out[inside] = flat
        return out, sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each starts (with the end appended)."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.known:
            ids, size = self._whole(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(size)])
        self.trim()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        numbers = self.chunks.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(index, minlength=len(coded.dictionary)))
        ids, size = self.chunks.take(numbers[index])
        offsets = lists.offsets.to_numpy()
        return ids, np.concatenate([[0], np.cumsum(size)])[offsets - offsets[0]]


_LOADED: dict[str, _Tokenizer] = {}


def tokenize_pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, start, length, ids, doc_tokens`` per piece of at most ``window`` tokens; ``ids`` holds
    little-endian unsigned 32-bit ids, the document's end id included."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of other work's tasks
        if path not in _LOADED:
            _LOADED[path] = _Tokenizer(path)
        tok = _LOADED[path]
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
            group = np.cumsum(size.astype(np.int64)) // _BATCH_BYTES  # longer texts end a group of their own
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for at, stop in zip(cuts, cuts[1:]):
                if at == stop:
                    continue
                ids, ends = tok.ids(b.column(1).slice(at, stop - at))
                raw = ids.astype("<u4").tobytes()
                row, start, length, own, total = [], [], [], [], []
                for k, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    n = z - a + 1
                    text_ids = raw[4 * a:4 * z] + tail
                    for s in range(0, n, window):
                        row.append(at + k)
                        start.append(s)
                        length.append(min(window, n - s))
                        own.append(text_ids[4 * s:4 * (s + window)])
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(own, pa.binary()), pa.array(total, pa.int64())],
                    names=["id", "start", "length", "ids", "doc_tokens"])
                release_memory()  # one group's arrays are several times its text
        tok.trim()  # a worker may stay idle for long
        release_memory()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, start long, length long, ids binary, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


# --------------------------------------------------------------------------- the plan

def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to write ``units`` as a sum of at most ``depth`` positive parts, largest part first."""
    out = []

    def grow(left: int, most: int, parts: tuple[int, ...]) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            room = depth - len(parts)
            for p in range(min(left, most), -(-left // room) - 1, -1):
                grow(left - p, p, (*parts, p))

    grow(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    limit = 1e-9 * max(1.0, np.abs(b).max(initial=0.0)) * a.shape[0]
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        k = int(gradient.argmax())
        if gradient[k] <= limit:
            break
        passive[k] = True
        while True:
            own = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            low = s <= 0
            step = (x[own][low] / np.maximum(x[own][low] - s[low], 1e-300)).min()
            x[own] += step * (s - x[own])
            gone = own[(x[own] <= 1e-12)]
            passive[gone] = False
            x[gone] = 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in units, repetitions) that use every piece once; ``histogram[k]`` counts pieces of k units
    and its last index is the window."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out = []
    combos = combinations(units, depth)
    a = np.zeros((units + 1, len(combos)))
    for c, parts in enumerate(combos):
        for p in parts:
            a[p, c] += 1
    x = nnls(a, left.astype(float))
    for c in np.argsort(-x, kind="stable"):
        want = int(x[c])
        if want < 1:
            break
        parts, times = np.unique(combos[c], return_counts=True)
        n = min(want, int((left[parts] // times).min()))
        if n:
            left[parts] -= n * times
            out.append((combos[c], n))
    while left.any():  # greedy: the largest piece, then the largest that still fits
        parts, room, rest = [], units, left.copy()
        while room and len(fits := np.flatnonzero(rest[:room + 1])):
            k = int(fits[-1])
            parts.append(k)
            rest[k] -= 1
            room -= k
        own, times = np.unique(parts, return_counts=True)
        n = int((left[own] // times).min())
        left[own] -= n * times
        out.append((tuple(parts), n))
    return out


def _places(layout: list[tuple[tuple[int, ...], int]], units: int) -> list[tuple[np.ndarray, ...]]:
    """Per size: rank at which each use begins, its first sequence, pieces per sequence, first slot."""
    uses: list[list[tuple[int, int, int, int]]] = [[] for _ in range(units + 1)]
    at, sequence = [0] * (units + 1), 0
    for parts, n in layout:
        order = sorted(parts, reverse=True)
        for k in dict.fromkeys(order):
            m = order.count(k)
            uses[k].append((at[k], sequence, m, order.index(k)))
            at[k] += n * m
        sequence += n
    return [tuple(np.array(c, np.int64) for c in zip(*u)) if u else () for u in uses]


def pack(pieces: DataFrame, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "start"),
         window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """``pieces`` (at most ``window`` long; scanned more than once, so hand in a stored table) with
    ``sequence_id`` and ``offset``, gapless from 0 in each sequence."""
    units = window // unit
    p = pieces.withColumn("_k", F.ceil(F.col(length_col) / unit).cast("int"))
    counts = p.groupBy("_k").count().collect()  # at most window / unit rows
    histogram = np.zeros(units + 1, np.int64)
    for r in counts:
        histogram[r["_k"]] = r["count"]
    return place(pieces, plan(histogram, depth), F.ceil(F.col(length_col) / unit).cast("int"), units, int(histogram.max()),
                 length_col, key_cols)


def place(pieces: DataFrame, layout: list[tuple[tuple[int, ...], int]], size, units: int, most: int, length_col: str = "length",
          key_cols: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` with the ``sequence_id`` and ``offset`` that ``layout`` has for the column ``size`` (1 .. ``units``);
    ``most`` pieces have the same size at most."""
    places = _places(layout, units)
    p = pieces.withColumn("_k", size)
    buckets = max(1, most // _RANK_ROWS)
    p = p.withColumn("_h", F.xxhash64(*key_cols)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = p.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_k", "_b").orderBy("_h", *key_cols)
    p = p.withColumn("_i", F.row_number().over(inside) - 1).join(first, ["_k", "_b"]).withColumn("_r", F.col("_from") + F.col("_i"))

    @F.pandas_udf("struct<sequence_id:long,slot:long>")
    def at(k: pd.Series, r: pd.Series) -> pd.DataFrame:
        k, r = k.to_numpy(), r.to_numpy()
        sequence, slot = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for size in np.unique(k).tolist():
            own = k == size
            begin, base, times, where = places[size]
            use = np.searchsorted(begin, r[own], side="right") - 1
            q = r[own] - begin[use]
            sequence[own], slot[own] = base[use] + q // times[use], where[use] + q % times[use]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    p = p.withColumn("_p", at("_k", "_r"))
    w = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return p.select(*pieces.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.slot").alias("_slot")).withColumn(
        "offset", F.coalesce(F.sum(length_col).over(w), F.lit(0)).cast("long")).drop("_slot")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their place: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    The pieces without their ids are stored once; ``tokenize_pieces`` gives the ids again by (id, start)."""
    t = tokenize_pieces(docs, path, end_id, id_col=id_col, text_col=text_col)
    with small_batches(docs.sparkSession):
        stored = cut_lineage(t.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(stored, key_cols=(id_col, "start"))


# --------------------------------------------------------------------------- query

def op7_packing(spark, sf_dir):
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
