"""Ranked lexical search: every item of a query table against all documents.

Accumulator-limited term-at-a-time: a task turns the documents of a slice into postings of
the items' terms and takes each item's terms rarest first. A document gets an accumulator
when a term finds it, as long as a document without one could still come among the item's
``k`` best: once the best that all remaining terms can add stays below the k-th highest
partial score (or the k-th score of earlier slices of the task), no more accumulators are
made and the remaining terms only update the documents that have one, exactly. Partial
scores never exceed final ones, so nothing among the best is lost; a bound equal to the
k-th score still makes accumulators, for a tie may win by its id.

Scale: two passes over the texts and no shuffle of postings. The first counts documents,
terms and the documents of each item term inside every task, so the commonest term is one
row per task; the second scores. ``k`` rows per item leave a task, and one window by item
keeps the best. Slices hold about ``SLICE_BYTES`` of text. Items are taken in blocks of about
``BLOCK_ITEMS`` rows or ``BLOCK_BYTES`` of text, each broadcast and run over all documents, so
what is broadcast does not grow with the items.

Cases: null and empty texts have no terms: such documents are not counted and such items
have no rows; repeated item rows are answered each; repeated documents rank each on their
own; documents without an id come after those with one at equal scores; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import table

K = 10
BLOCK_ITEMS, BLOCK_BYTES = 2000, 8 << 20
SLICE_BYTES = 8 << 20
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LONG = 1 << 20  # longer texts are counted term by term, without a list of all
_DOCS, _LENGTH = -1, -2


def term_counts(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text, A-Z lower-cased."""
    if not text:
        return Counter()
    if len(text) > _LONG:
        return Counter(m.group() for m in _TERM.finditer(text.lower()))
    return Counter(_TERM.findall(text.lower()))


@dataclass
class Block:
    """Items with their terms (numbers in ``vocabulary``) and how often each is asked for."""
    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]


def _block(rows: list) -> Block:
    vocabulary: dict[bytes, int] = {}
    ids, terms, times = [], [], []
    for key, text in rows:
        if own := term_counts(bytes(text) if text else None):
            ids.append(key)
            terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own], np.int64))
            times.append(np.array(list(own.values()), np.int64))
    return Block(ids, terms, times, vocabulary)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """All items, a bounded number of rows and bytes at a time."""
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    numbered = own.withColumn("b", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    for b in range(blocks):
        yield _block([(r["id"], r["text"]) for r in numbered.where(F.col("b") == b).collect()])


def corpus_counts(docs: DataFrame, block: Block, text_col: str) -> tuple[int, int, np.ndarray]:
    """N, L and each item term's number of documents, over all documents."""
    given = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = given.value
        n = length = 0
        df: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                for text in b.column(0).slice(at, 500).to_pylist():
                    if own := term_counts(text):
                        n += 1
                        length += own.total()
                        df.update(own.keys() & vocabulary.keys())
        keys = [_DOCS, _LENGTH, *(vocabulary[t] for t in df)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([n, length, *df.values()], pa.int64())], names=["term", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()  # the block's vocabulary and two rows
    found = {r["term"]: r["n"] for r in counted}
    df = np.zeros(len(block.vocabulary), np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(_DOCS, 0), found.get(_LENGTH, 0), df


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Postings:
    """The documents of one slice by term, with what each occurrence adds to a score."""

    def __init__(self, term: list[int], doc: list[int], impact: np.ndarray, n_docs: int, n_terms: int):
        term, doc = np.array(term, np.int64), np.array(doc, np.int64)
        order = np.argsort(term, kind="stable")  # documents stay in order
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.best = np.zeros(n_terms, np.int64)
        np.maximum.at(self.best, term, impact)
        self.score = np.zeros(n_docs, np.int64)

    def rank(self, terms: np.ndarray, times: np.ndarray, k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) that hold all of the item's ``k`` best that score ``reached`` or more; ``terms`` come
        rarest first."""
        own = self.begin[terms + 1] > self.begin[terms]
        terms, times = terms[own], times[own]
        ceiling = times * self.best[terms]
        left = np.append(np.cumsum(ceiling[::-1])[::-1], 0)  # what the terms from j on can add at most
        score, j = self.score, 0
        while j < len(terms) and left[j] >= reached:
            at = slice(self.begin[terms[j]], self.begin[terms[j] + 1])
            score[self.doc[at]] += times[j] * self.impact[at]
            j += 1
            if self.n_docs > k and left[j] < left[0] - left[j]:  # else the k-th cannot be above what is left
                reached = max(reached, int(np.partition(score, self.n_docs - k)[self.n_docs - k]))
        docs = np.flatnonzero(score)
        final = score[docs]
        score[docs] = 0
        for t, n in zip(terms[j:].tolist(), times[j:].tolist()):
            at = slice(self.begin[t], self.begin[t + 1])
            place = np.searchsorted(self.doc[at], docs)
            hit = place < at.stop - at.start
            hit[hit] = self.doc[at][place[hit]] == docs[hit]
            final[hit] += n * self.impact[at][place[hit]]
        return docs, final


def _slice_postings(texts: list[bytes | None], vocabulary: dict, weight: np.ndarray, n_all: int, length_all: int) -> Postings:
    term, doc, tf, m = [], [], [], []
    for i, text in enumerate(texts):
        counts = term_counts(text)
        own = counts.keys() & vocabulary.keys()
        if own:
            term += [vocabulary[t] for t in own]
            tf += [counts[t] for t in own]
            doc += [i] * len(own)
            m += [25 + 75 * counts.total() * n_all // length_all] * len(own)
    tf = np.array(tf, np.int64)
    impact = weight[np.array(term, np.int64)] * (1_000_000_000 * tf // (1000 * tf + 8 * np.array(m, np.int64)))
    return Postings(term, doc, impact, len(texts), len(vocabulary))


def _best(scores: np.ndarray, keys: list, k: int) -> list[int]:
    """Places of the ``k`` best: high score first, then small key, missing keys last."""
    place = np.arange(len(scores))
    if len(scores) > k:
        place = place[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return sorted(place.tolist(), key=lambda i: (-scores[i], keys[i] is None, keys[i] if keys[i] is not None else 0))[:k]


def _search_block(docs: DataFrame, block: Block, id_col: str, text_col: str, item_type: str, k: int) -> DataFrame:
    n, length, df = corpus_counts(docs, block, text_col)
    weight = term_weights(n, df)
    order = [np.lexsort((t, df[t])) for t in block.terms]  # rarest first
    ready = Block(block.ids, [t[o] for t, o in zip(block.terms, order)], [c[o] for c, o in zip(block.times, order)], block.vocabulary)
    given = docs.sparkSession.sparkContext.broadcast((ready, weight))
    schema = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = given.value
        key_type = None
        best: list[tuple[list, np.ndarray]] = [([], np.empty(0, np.int64)) for _ in block.ids]

        def take(keys: list, texts: list) -> None:
            p = _slice_postings(texts, block.vocabulary, weight, n, length)
            for i, (terms, times) in enumerate(zip(block.terms, block.times)):
                had_keys, had = best[i]
                found, score = p.rank(terms, times, k, int(had.min()) if len(had) == k else 1)
                own = found[score > 0]
                if len(own):
                    all_keys, scores = had_keys + [keys[d] for d in own.tolist()], np.concatenate([had, score[score > 0]])
                    top = _best(scores, all_keys, k)
                    best[i] = [all_keys[t] for t in top], scores[top]

        keys, texts, size = [], [], 0
        for b in batches:
            key_type = b.schema.field(0).type
            for at in range(0, b.num_rows, 500):
                own = b.slice(at, 500)
                keys += own.column(0).to_pylist()
                part = own.column(1).to_pylist()
                texts += part
                size += sum(len(t) for t in part if t)
                if size > SLICE_BYTES:
                    take(keys, texts)
                    keys, texts, size = [], [], 0
        if texts:
            take(keys, texts)
        if key_type is not None:
            number = [i for i, (own, _) in enumerate(best) for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([x for own, _ in best for x in own], key_type),
                                              pa.array([s for _, own in best for s in own.tolist()], pa.int64())], names=["item", "doc", "score"])

    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"item int, doc {schema}, score long")
    names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"item int, id {item_type}")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").isNull(), "doc")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item").select("id", "rank", "doc", "score")  # names: a block's items


def search(docs: DataFrame, items: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text",
           k: int = K) -> DataFrame:
    """``item, rank, id, score``: each item's ``k`` best documents with a score above 0."""
    spark, out = docs.sparkSession, None
    item_type = items.schema[item_col].dataType.simpleString()
    for block in item_blocks(items, item_col, text_col):
        if block.ids:
            part = _search_block(docs, block, id_col, text_col, item_type, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"id {item_type}, rank int, doc {docs.schema[id_col].dataType.simpleString()}, score long")
    return out.select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


# --------------------------------------------------------------------------- query

def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS_SQL = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS_SQL} AS ts FROM documents),
q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TOKENS_SQL}) AS t FROM benchmark) GROUP BY ALL),
c AS (SELECT count(*) AS n_all, sum(len(ts)) AS l_all FROM d WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY t, n_all),
x AS (SELECT p.r, p.t, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + CAST((75 * len(d.ts) * c.n_all) // c.l_all AS BIGINT)))) AS s
      FROM p JOIN w USING (t) JOIN d USING (r), c),
s AS (SELECT q.i, q.item_id, x.r, sum(q.times * x.s) AS score FROM q JOIN x USING (t) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 10"""
