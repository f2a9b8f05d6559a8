"""Best-fit packing by a configuration linear program.

Documents are tokenised (with an end id); only those longer than ``window`` are cut, into
full windows with the shorter rest first. The pieces are counted by length, in tokens. A
configuration is a multiset of lengths that fits into a window, and the linear program asks
for the fewest configurations that use up the histogram. It is solved by multiplicative
weights: a length's price falls exponentially with the share of its pieces that is covered;
a knapsack dynamic program over the window prices the configurations, one pass giving the
best one through every length; those near the best get more mass. Prices over the best
configuration's worth bound the number of sequences from below. The solution is rounded to
whole repetitions, from the longest pieces down and never beyond what the histogram holds,
and what is left goes best-fit: longest piece first, into the fullest sequence that has room.

Scale: the program has the size of the window, whatever the number of documents, and runs
on the driver on ``window`` counts. Token ids are made in one pass and leave a task as pieces;
what moves is a few numbers a piece, and a piece finds its place by arithmetic from its rank
among the pieces of its length (``packing.place``).

Ids: text is cut at single spaces between non-spaces, where the byte-level pre-tokeniser
always parts text; ids are remembered by chunk, in a bounded number, and new chunks are
merged by a fast library from the file's own vocabulary. A file that is not plain byte-level
BPE, and chunks with a special token, go to the file's own tokenizer.

Cases: a null or empty text has the end id only; repeated rows are packed each on their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, table
from ledgerspark.llm.id_cache import IdCache, byte_symbols
from ledgerspark.llm.packing import place

WINDOW, END_ID = 2048, 0
ROUNDS = 100
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)
_CACHE_CHUNKS = 300_000
_BATCH_BYTES = 4 << 20
#: what byte-level pre-tokenisers split text by
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters with the Unicode property White_Space, and the end of a text
_SPACES = frozenset(["", *map(chr, [*range(9, 14), 32, 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000])])


class Tokenizer:
    """Ids of whole texts by a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec)
        self.cache = IdCache(self._encode, _CACHE_CHUNKS)

    @cached_property
    def library(self):
        """The file's own tokenizer, loaded where it is needed."""
        from tokenizers import Tokenizer as Library
        return Library.from_file(self.path)

    def _fast(self, spec: dict):
        """The same merges in the fast library, where the file is plain byte-level BPE."""
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                 and not pre.get("add_prefix_space") and not any(model.get(k) for k in (
                     "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in spec["added_tokens"]))
        if not plain:
            return None
        import tiktoken
        symbols, vocab = byte_symbols(), model["vocab"]
        merged = [vocab["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):  # there a lower id merges first
            return None
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.leads = np.zeros(max(vocab.values()) + 1, bool)
        self.leads[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units between safe cuts. Those with one space, in front, go end to end: the ids that begin with a space part them."""
        flat, size = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(units), 2000):
            own = units[at:at + 2000]
            text = "".join(own)
            if self.odd.isdisjoint(own) and not any(s in text for s in self.special):
                ids = np.array(self.fast.encode_ordinary(text), np.int32)
                begin = np.flatnonzero(self.leads[ids])
                if len(begin) != len(own):
                    raise AssertionError("the first id of a chunk begins with its space")
                flat.append(ids)
                size.append(np.diff(begin, append=len(ids)))
            else:
                got = [self.library.encode(u, add_special_tokens=False).ids if any(s in u for s in self.special)
                       else self.fast.encode_ordinary(u) for u in own]
                flat.append(np.array(list(chain.from_iterable(got)), np.int32))
                size.append(np.array([len(g) for g in got], np.int64))
        return np.concatenate(flat), np.concatenate(size)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each starts (with the end appended)."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        if self.fast is None:
            got = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array(list(chain.from_iterable(got)), np.int32), np.cumsum([0] + [len(g) for g in got])
        self.cache.trim()
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        offset = lists.offsets.to_numpy()
        offset = offset - offset[0]
        opens = np.array([w[:1] not in _SPACES for w in words], bool)
        closes = np.array([w[-1:] not in _SPACES for w in words], bool)
        # a chunk is a unit of its own where both cuts beside it lie between non-spaces
        cut = np.ones(len(index) + 1, bool)
        cut[1:-1] = closes[index[:-1]] & opens[index[1:]]
        cut[offset] = True
        start = np.flatnonzero(cut[:-1])
        stop = np.append(start[1:], len(index))
        unit = index[start]
        first = np.zeros(len(index) + 1, bool)
        first[offset[:-1]] = True
        odd = np.flatnonzero(first[start] | (stop - start > 1) | ~closes[index[stop - 1]])
        extra: dict[str, int] = {}
        for i in odd.tolist():
            a, z = int(start[i]), int(stop[i])
            text = " ".join([words[k] for k in index[a:z].tolist()])
            unit[i] = len(words) + extra.setdefault(text if first[a] else " " + text, len(extra))
        times = np.bincount(unit, minlength=len(words) + len(extra))
        own = np.flatnonzero(times)
        self.odd = set(extra)
        strings = [" " + words[k] for k in own[own < len(words)].tolist()] + list(extra)
        number = np.zeros(len(times), np.int64)
        distinct = {s: None for s in strings}
        if len(distinct) < len(strings):  # a text's beginning may look like a later chunk
            at = {s: i for i, s in enumerate(distinct)}
            place_of = np.array([at[s] for s in strings], np.int64)
            number[own] = self.cache.numbers(list(distinct), np.bincount(place_of, times[own]).astype(np.int64))[place_of]
        else:
            number[own] = self.cache.numbers(strings, times[own])
        ids, size = self.cache.take(number[unit])
        at = np.concatenate([[0], np.cumsum(size)])
        return ids, at[np.searchsorted(start, offset)]


_LOADED: dict[str, Tokenizer] = {}


def tokenize_pieces(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids``: a document with its end id, cut only beyond ``window``, the shorter piece first;
    ``ids`` holds little-endian unsigned 32-bit ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Tokenizer(path)
        tok, tail = _LOADED[path], np.array([end_id], "<u4").tobytes()
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
            group = np.cumsum(size.astype(np.int64)) // _BATCH_BYTES  # longer texts end a group of their own
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for at, stop in zip(cuts, cuts[1:]):
                if at == stop:
                    continue
                ids, ends = tok.ids(b.column(1).slice(at, stop - at))
                raw = ids.astype("<u4").tobytes()
                row, piece, start, length, own = [], [], [], [], []
                for k, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    n, text_ids, begin = z - a + 1, raw[4 * a:4 * z] + tail, 0
                    for p in range(-(-n // window)):
                        size = (n - 1) % window + 1 if p == 0 else window
                        row.append(at + k)
                        piece.append(p)
                        start.append(begin)
                        length.append(size)
                        own.append(text_ids[4 * begin:4 * (begin + size)])
                        begin += size
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(own, pa.binary())], names=["id", "piece", "start", "length", "ids"])
        tok.cache.trim()  # a worker may stay idle for long

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


# --------------------------------------------------------------------------- the program

def knapsack(sizes: np.ndarray, worth: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every room 0 .. ``window``: the most worth that pieces fit, the last piece to take (-1: none), and the room that
    is left before it, without tokens that stay empty."""
    best, last, used = np.zeros(window + 1), np.full(window + 1, -1), np.zeros(window + 1, np.int64)
    fits = np.searchsorted(sizes, np.arange(window + 1), side="right").tolist()
    for room in range(1, window + 1):
        best[room], last[room], used[room] = best[room - 1], last[room - 1], used[room - 1]
        if k := fits[room]:
            value = worth[:k] + best[room - sizes[:k]]
            i = int(value.argmax())
            if value[i] > best[room]:
                best[room], last[room], used[room] = value[i], i, room
    return best, last, used


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, window: int, rounds: int = ROUNDS, rate: float = 4.0,
                     slack: float = 0.02, step: float = 0.1) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Configurations ((place in ``sizes``, pieces) in order) with their repetitions, which together cover the counts in
    proportion, and a lower bound on the number of sequences. A piece's price is its size (the first weight of a length is its tokens) times
    exp(-rate x share covered). Ends when all lengths are covered, or after ``rounds``."""
    mass: Counter = Counter()
    covered, bound = np.zeros(len(sizes)), 0.0
    count, size = counts.tolist(), sizes.tolist()
    for _ in range(rounds):
        price = sizes * np.exp(-rate * (covered - covered.min()))
        best, last, used = knapsack(sizes, price, window)
        bound = max(bound, float(price @ counts) / best[window])
        last, before = last.tolist(), (used - np.where(last >= 0, sizes[last], 0)).tolist()
        near = price + best[window - sizes] >= (1 - slack) * best[window]
        gained = [0.0] * len(size)  # prices hold for one step a round
        for i in np.argsort(covered, kind="stable").tolist():
            if gained[i] or not near[i]:
                continue
            times, room = {i: 1}, window - size[i]
            while (k := last[room]) >= 0 and times.get(k, 0) < count[k]:  # never more pieces than there are
                times[k] = times.get(k, 0) + 1
                room = before[room]
            add = min((step - gained[k]) * count[k] / n for k, n in times.items())
            if add <= 0:
                continue
            for k, n in times.items():
                gained[k] += add * n / count[k]
            mass[tuple(sorted(times.items()))] += add
        covered += gained
        if covered.min() >= 1:
            break
    return mass, bound


def plan(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """(lengths, repetitions) that use every piece once, and the lower bound; ``histogram[n]`` counts pieces of n tokens."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    full, left[window] = int(left[window]), 0
    sizes = np.flatnonzero(left)
    mass, bound = configuration_lp(sizes, left[sizes].astype(float), window, rounds) if len(sizes) else ({}, 0.0)
    tries = []
    for share in SHARES:  # what is rounded away leaves room to choose: the best share of the solution is kept
        rest = left.copy()
        tries.append(best_fit(rest, rounded(mass, sizes, rest, share)))
    layout = min(tries, key=lambda t: sum(n for _, n in t))
    return layout + ([((window,), full)] if full else []), max(bound + full, float(histogram @ np.arange(window + 1)) / window)


def rounded(mass: dict[tuple[tuple[int, int], ...], float], sizes: np.ndarray, left: np.ndarray, share: float) -> list[
        tuple[tuple[int, ...], int]]:
    """Whole repetitions of the configurations, as many as their mass is worth of a ``share`` of each length's pieces, those
    with the longest pieces first, and never more than there are pieces. Takes the pieces from ``left``."""
    use = np.zeros(len(sizes))
    for config, x in mass.items():
        for k, n in config:
            use[k] += n * x
    part = (share * left[sizes] / np.maximum(use, 1e-300)).tolist()
    rest, size, out, due = left[sizes].tolist(), sizes.tolist(), [], 0.0
    for config, x in sorted(mass.items(), key=lambda c: c[0][::-1], reverse=True):
        due += x * min(part[k] for k, _ in config)
        times = min(int(due), *(rest[k] // n for k, n in config))
        due -= int(due)
        if times:
            for k, n in config:
                rest[k] -= n * times
            out.append((tuple(size[k] for k, n in reversed(config) for _ in range(n)), times))
    left[sizes] = rest
    return out


def best_fit(left: np.ndarray, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """``begun`` sequences and new ones with all pieces of ``left``: longest first, each into the fullest sequence that has
    room for it. Equal pieces and equal sequences are handled together, so the work does not grow with their number."""
    window = len(left) - 1
    rooms: list[Counter] = [Counter() for _ in range(window + 1)]
    for parts, times in begun:
        rooms[window - sum(parts)][parts] += times
    some = np.array([bool(r) for r in rooms])
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n and len(at := np.flatnonzero(some[size:])):
            room = size + int(at[0])
            parts, times = rooms[room].popitem()
            used = min(n, times)
            if times > used:
                rooms[room][parts] = times - used
            some[room] = bool(rooms[room])
            rooms[room - size][(*parts, size)] += used
            some[room - size] = True
            n -= used
        each = window // size
        for k, times in ((each, n // each), (n % each, 1)):
            if k and times:
                rooms[window - k * size][(size,) * k] += times
                some[window - k * size] = True
    return [x for r in rooms for x in r.items()]


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their place: ``id, piece, start, length, ids_crc32, sequence_id, offset``. The pieces are
    stored without their ids; ``tokenize_pieces`` gives those again by (id, piece)."""
    t = tokenize_pieces(docs, path, end_id, window, id_col, text_col)
    pieces = cut_lineage(t.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``window`` rows
        histogram[r["length"]] = r["count"]
    layout, _ = plan(histogram)
    return place(pieces, layout, F.col("length").cast("int"), window, int(histogram.max()), key_cols=(id_col, "piece"))


# --------------------------------------------------------------------------- query

def op13_best_fit_packing(spark, sf_dir):
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
