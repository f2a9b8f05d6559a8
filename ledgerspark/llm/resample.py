"""Target-distribution importance resampling on hashed word runs.

Documents are drawn so that they look like a target table: a feature is a run of 1 to
``n_max`` consecutive words, hashed to a bucket by CRC-32, and a document's weight sums its
features' log-ratios of the target's smoothed bucket share to the corpus's. Gumbel noise
from a hash of the id makes the highest scores a draw without replacement.

Prefix-CRC substrings: the words of a document, joined by one space, are scanned once and
the running CRC after every byte is kept. The CRC of any run follows from two prefixes:
``crc(run) = running[end] ^ Z(running[start], end - start)``, where Z, appending zero bytes,
is linear over GF(2) and is applied by table, a byte of the CRC at a time. So a run of any
number of words costs the same, and no run is ever built as a string.

Scale: two passes over the texts (bucket counts; weights). A task holds about
``SLICE_BYTES`` of text at a time, of a longer text about that many bytes of its words with
the ``n_max - 1`` words before them. Counts are added up inside a task: ``buckets`` rows leave
each, and ``buckets`` rows reach the driver. Ranks come from ``ranking.global_row_number``.

Cases: a null or empty text has no features, weight 0 and the score of its noise; repeated
rows are drawn each on their own (ties by the id, missing ids last, then by place); a null
id has the noise of the text "2024:"; an empty table gives no rows; an empty target leaves
every target count at 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, table
from ledgerspark.operators.ranking import global_row_number

BUCKETS, N_MAX, SHARE, MIN_WORDS, SEED = 10_000, 1, 10, 20, "2024"
SLICE_BYTES = 2 << 20
_LANES = 2048
_NEAR = 64  # shifts by fewer bytes have a table of their own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _byte_table()


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear operator on 32 bits, given by its values for each byte at each place."""
    return (operator[0, crc & 255] ^ operator[1, (crc >> 8) & 255] ^ operator[2, (crc >> 16) & 255] ^ operator[3, crc >> 24])


def _operators() -> tuple[np.ndarray, list[np.ndarray]]:
    """Appending 0 .. 63 zero bytes, and appending 64, 128, 256 .. of them."""
    one = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    near = [one]
    while len(near) <= _NEAR:
        near.append(_STEP[near[-1] & 255] ^ (near[-1] >> 8))
    far = [near.pop()]
    while len(far) < 34:
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), far


_NEAR_SHIFTS, _FAR_SHIFTS = _operators()
_FLAT = _NEAR_SHIFTS.reshape(-1)


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC after ``n`` zero bytes, by GF(2) operators."""
    at = (n % _NEAR) * 1024
    out = _FLAT[at + (crc & 255)] ^ _FLAT[at + 256 + ((crc >> 8) & 255)] ^ _FLAT[at + 512 + ((crc >> 16) & 255)] ^ _FLAT[
        at + 768 + (crc >> 24)]
    rest = n // _NEAR
    for bit in range(int(rest.max(initial=0)).bit_length()):
        own = np.flatnonzero(rest >> bit & 1)
        out[own] = _apply(_FAR_SHIFTS[bit], out[own])
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """CRC-32 of the first 0, 1, .. len(data) bytes. Lanes of equal length are scanned side by side, each from
    the CRC at which the lane before it ends."""
    lanes = int(np.clip(len(data) // 64, 1, _LANES))
    size = -(-len(data) // lanes)
    padded = np.zeros((lanes, size), np.uint8)
    padded.reshape(-1)[:len(data)] = data
    begin, crc = np.zeros(lanes, np.uint32), 0
    for k in range(lanes - 1):
        crc = zlib.crc32(padded[k], crc)
        begin[k + 1] = crc
    state, columns = ~begin, np.ascontiguousarray(padded.T)
    out = np.empty((size, lanes), np.uint32)
    for i in range(size):
        state = _STEP[(state ^ columns[i]) & 255] ^ (state >> 8)
        out[i] = state
    return np.concatenate([np.zeros(1, np.uint32), ~out.T.reshape(-1)[:len(data)]])


def _slices(texts: list[bytes | None], n_max: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(lower-cased bytes, where each text begins, row of each, leading words that are context only). A text
    longer than a slice comes in parts of whole words."""
    held, rows, size = [], [], 0

    def packed(parts, rows, context=0):
        begin = np.cumsum([0] + [len(p) for p in parts])[:-1]
        return _LOWER[np.frombuffer(b"".join(parts), np.uint8)], begin, np.array(rows), context

    for row, text in enumerate(texts):
        if text and len(text) > SLICE_BYTES:
            words = (m.group() for m in _WORDS.finditer(text.lower()))
            before: list[bytes] = []
            while part := list(islice(words, SLICE_BYTES // 8)):
                yield packed([b" ".join(before + part)], [row], len(before))
                before = (before + part)[len(before) + len(part) - (n_max - 1):]
        elif text:
            held.append(text)
            rows.append(row)
            size += len(text)
            if size > SLICE_BYTES:
                yield packed(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield packed(held, rows)


def features(texts: list[bytes | None], n_max: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, CRC-32, words) of all runs of ``words`` = 1 .. ``n_max`` consecutive words, rows in order."""
    for data, begin, rows, context in _slices(texts, n_max):
        inside = _IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[begin] = inside[begin]  # a word does not go on into the next text
        word_at = np.flatnonzero(first)
        if not len(word_at):
            continue
        # the words of all texts, each followed by one space
        number = np.cumsum(first)[inside] - 1
        joined = np.full(len(number) + len(word_at), 32, np.uint8)
        joined[np.arange(len(number)) + number] = data[inside]
        size = np.bincount(number, minlength=len(word_at))
        start = np.cumsum(size + 1) - size - 1
        end = start + size
        crc = running_crcs(joined)
        text = np.searchsorted(begin, word_at, side="right") - 1
        for n in range(1, n_max + 1):
            a, z = np.arange(len(word_at) - n + 1), np.arange(n - 1, len(word_at))
            if n > 1:
                whole = (text[a] == text[z]) & (z >= context)
                a, z = a[whole], z[whole]
            elif context:
                a, z = a[context:], z[context:]
            yield rows[text[a]], crc[end[z]] ^ shift(crc[start[a]], end[z] - start[a]), n


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, n_max: int = N_MAX) -> np.ndarray:
    """Features in each bucket over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for _, crc, _ in features(b.column(0).slice(at, 1000).to_pylist(), n_max):
                    seen += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(seen[own], pa.int64())], names=["bucket", "n"])

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of every bucket, shares smoothed by one."""
    t, s, k = target.astype(float), source.astype(float), float(len(target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n_max: int = N_MAX) -> DataFrame:
    """``id, n_words, n_features, weight`` of every row."""
    given = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = given.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                own = b.slice(at, 1000)
                words, found, weight = (np.zeros(own.num_rows, np.int64) for _ in range(3))
                for row, crc, n in features(own.column(1).to_pylist(), n_max):
                    if not len(row):
                        continue
                    begin = np.flatnonzero(np.diff(row, prepend=-1))
                    count = np.diff(begin, append=len(row))
                    found[row[begin]] += count
                    weight[row[begin]] += np.add.reduceat(gain[crc % np.uint32(len(gain))], begin)
                    if n == 1:
                        words[row[begin]] += count
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(x, pa.int64()) for x in (words, found, weight))],
                                                 names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {id_type}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE,
             min_words: int = MIN_WORDS, buckets: int = BUCKETS, n_max: int = N_MAX, seed: str = SEED) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every document; the highest ``share`` percent of those with
    ``min_words`` words have a rank, the others null."""
    gain = gains(bucket_counts(target, text_col, buckets, n_max), bucket_counts(docs, text_col, buckets, n_max))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weigh(docs, gain, id_col, text_col, n_max).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = cut_lineage(scored.withColumn("_place", F.monotonically_increasing_id()))
    drawn = scored.where(F.col("n_words") >= min_words).count() * share // 100
    ranked = global_row_number(scored, [F.col("n_words") < min_words, -F.col("score"), F.col(id_col).isNull(), id_col, "_place"], out="_r")
    return ranked.select(id_col, "n_words", "n_features", "weight", "score",
                         F.when(F.col("_r") <= drawn, F.col("_r")).cast("long").alias("rank"))


# --------------------------------------------------------------------------- query

def op11_importance_resample(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
dw AS (SELECT rowid_ AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
d AS (SELECT r, unnest(ws) AS w FROM dw),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM tw)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1),
                  lambda i: (instr('0123456789ABCDEF', substr(hex(encode(w)), 2 * i - 1, 1)) - 1) * 16
                            + instr('0123456789ABCDEF', substr(hex(encode(w)), 2 * i, 1)) - 1)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
           FROM vocab, crc_table),
s AS (SELECT bucket, count(*) AS n FROM d JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM tw JOIN hashed USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS st, (SELECT coalesce(sum(n), 0) FROM t) AS tt),
gain AS (SELECT b AS bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) AS DOUBLE) * (st + 10000)
                 / (CAST((coalesce(s.n, 0) + 1) AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS g
         FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, tot),
wt AS (SELECT r, count(*) AS n, sum(g) AS weight FROM d JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
sc AS (SELECT dw.r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
                   / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM dw LEFT JOIN wt USING (r)),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN rank <= 10 * n // 100 THEN rank END AS BIGINT) AS rank FROM sc LEFT JOIN rk USING (r)"""
