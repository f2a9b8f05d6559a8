"""Byte-level BPE: corpus-level merge replay.

Each task takes the texts of a batch as its corpus: the distinct pre-tokens become one
array of byte tokens, and an inverted index maps every mergeable pair's rank to the
positions where it stands. Ranks are popped in order; one merge is applied to all of its
positions at once (array operations), and only the pairs with the touched neighbours are
looked up and indexed anew. Inside a word this is the order in which the tiktoken library
merges (lowest rank first, leftmost first), because words do not influence each other.
Ids are then gathered for every occurrence. Encoding and decoding need no shuffle.

The vocabulary is a parameter (a rank file); pairs are derived from it by trying every
split of every token. It is loaded once per Python worker (about 50,000 tokens, 10 MB).

Memory: texts are taken about ``BATCH_CHARS`` characters at a time. Until their merges are
replayed, a task holds their distinct pre-tokens and one number per pre-token; ids are
then gathered and handed on ``EMIT_WORDS`` pre-tokens at a time.

Cases: a null or empty text has no ids; repeated rows repeat their ids; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import table

BATCH_CHARS = 16 << 20
EMIT_WORDS = 400_000
#: what the Unicode property White_Space holds (Python's own \\s differs from it)
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Ranks, bytes and mergeable pairs of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.whole = ranks

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1)


_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(
        r"\s", f"[{_SPACE}]"))


def replay_merges(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after another, and where each word starts (with the end appended)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    tok = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    nxt = np.arange(1, n + 1, dtype=np.int32)      # position of the next token of the word, or -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    full = sizes > 0
    nxt[first[1:][full] - 1] = -1
    prv[first[:-1][full]] = -1
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        rank = vocab.ranks_of(tok[positions], tok[nxt[positions]])
        positions, rank = positions[rank >= 0], rank[rank >= 0]
        if not len(positions):
            return
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        start = [0, *cut.tolist()]
        for r, part in zip(rank[start].tolist(), np.split(positions, cut)):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(part)

    add(np.flatnonzero(nxt >= 0).astype(np.int32))
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[alive[at]]
        at = at[nxt[at] >= 0]
        if not len(at):
            continue
        right = nxt[at]
        ok = vocab.ranks_of(tok[at], tok[right]) == r  # else a neighbour has merged meanwhile
        at, right = at[ok], right[ok]
        if not len(at):
            continue
        # of several places in one word the leftmost goes first, the others wait for the next pop
        w = word[at]
        lead = np.ones(len(at), bool)
        lead[1:] = w[1:] != w[:-1]
        if not lead.all():
            index[r].append(at[~lead])
            heapq.heappush(heap, r)
            at, right = at[lead], right[lead]
        tok[at] = r
        after = nxt[right]
        nxt[at] = after
        prv[after[after >= 0]] = at[after >= 0]
        alive[right] = False
        before = prv[at]
        touched = np.concatenate([before[before >= 0], at[after >= 0]])
        if len(touched):
            add(touched)
    counts = np.bincount(word[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)
    return tok[alive], np.concatenate([[0], np.cumsum(counts)])


def _codes(texts: list[str], split, code: dict[str, int]) -> list[np.ndarray]:
    """Numbers of each text's pre-tokens; ``code`` numbers new ones on its own."""
    return [np.array([code[w] for w in split.findall(t)], np.int32) for t in texts]


def _word_ids(code: dict[str, int], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all distinct pre-tokens one after another, and where each starts (with the end appended)."""
    words = [w.encode("utf-8", "surrogatepass") for w in code]
    known = np.fromiter((vocab.whole.get(w, -1) for w in words), np.int64, len(words))
    rest = np.flatnonzero(known < 0)
    ids, start = replay_merges([words[i] for i in rest.tolist()], vocab)
    size = np.ones(len(words), np.int64)
    size[rest] = np.diff(start)
    begin = np.concatenate([[0], np.cumsum(size)])
    pool = np.empty(int(begin[-1]), np.int32)
    pool[begin[:-1][known >= 0]] = known[known >= 0]
    pool[np.repeat(begin[rest], size[rest]) + _ramp(size[rest])] = ids
    return pool, begin


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. sizes[0]-1, 0, 1, .. sizes[1]-1, .."""
    total = int(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(starts, sizes)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """``id, ids`` (array of int), each match of ``pattern`` merged on its own; no special tokens.
    ``with_decoded`` adds the bytes that the ids stand for, as ``decode`` does, in the same pass."""
    id_type = docs.schema[id_col].dataType.simpleString()
    split = splitter(pattern)

    def emit(keys: pa.Array, codes: list[np.ndarray], pool: np.ndarray, begin: np.ndarray, vocab: Vocabulary):
        at = 0
        while at < len(codes):  # gathered a bounded number of tokens at a time
            end, n = at, 0
            while end < len(codes) and (end == at or n + len(codes[end]) <= EMIT_WORDS):
                n += len(codes[end])
                end += 1
            flat = np.concatenate(codes[at:end]).astype(np.int64)
            size = begin[flat + 1] - begin[flat]
            ids = pool[np.repeat(begin[flat], size) + _ramp(size)]
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0] + [len(c) for c in codes[at:end]])]
            columns = [keys.slice(at, end - at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
            if with_decoded:
                columns.append(pa.array([_bytes(ids[a:b], vocab) for a, b in zip(ends[:-1], ends[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][:len(columns)])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(path)
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        code, chars = defaultdict(), 0
        code.default_factory = code.__len__
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.column(1).slice(at, 500)
                texts = [t or "" for t in part.to_pylist()]
                held.append((b.column(0).slice(at, len(texts)), _codes(texts, split, code)))
                chars += sum(map(len, texts))
                at += len(texts)
                if chars >= BATCH_CHARS:
                    pool, begin = _word_ids(code, vocab)
                    for keys, codes in held:
                        yield from emit(keys, codes, pool, begin, vocab)
                    held, chars = [], 0
                    code.clear()
        pool, begin = _word_ids(code, vocab)
        for keys, codes in held:
            yield from emit(keys, codes, pool, begin, vocab)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, ids array<int>" + ", decoded binary" * with_decoded)
    return out.withColumnRenamed("id", id_col)


def _bytes(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids decode to null."""
    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        vocab = _vocabulary(path)
        return ids.map(lambda x: None if x is None else _bytes(x, vocab))

    return encoded.withColumn(out_col, run(F.col(ids_col)))


# --------------------------------------------------------------------------- query

def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN,
               with_decoded=True)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
