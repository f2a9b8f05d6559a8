"""Secret scan: fixed patterns plus character Markov models.

Two first-order character models are trained on labelled samples of the corpus itself:
*random strings* from the values the fixed patterns find, *ordinary identifiers* from the
text outside those matches and outside tokens that mix letters and digits. A token is a run of
``MIN_TOKEN`` or more key characters, or what a base span leaves of one; it is flagged when
its log-likelihood ratio (random against ordinary) per character reaches ``threshold``,
whatever characters it is made of.

Training reads all documents: each task counts character pairs, the counts are summed in
Spark, and only the two 67 x 67 tables reach the driver. The scan is one map over all
rows without a shuffle.

Cases: a null text is empty and has no spans; a row is scanned on its own, so repeated
rows repeat their spans; ties on the start of a span keep the order of the kinds; an
empty table gives no rows and, with no labelled string, the random model is uniform;
extra columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import release_memory, table

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")          # maximal runs, 20 characters or more
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_TOKEN = 16
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_K = len(_ALPHABET) + 1                              # the last class is everything else: a token's edge
_CLASS = np.full(256, _K - 1, np.uint8)
_CLASS[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(_K - 1)

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the fixed patterns; kinds may overlap each other."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def _classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), np.uint8)]


def _pairs(classes: np.ndarray) -> np.ndarray:
    return np.bincount(classes[:-1].astype(np.int32) * _K + classes[1:], minlength=_K * _K)


@dataclass(frozen=True)
class MarkovModel:
    """Per-transition log-likelihood ratios, random over ordinary."""
    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        c = _classes(token).astype(np.int32)
        return float(self.ratio[c[:-1] * _K + c[1:]].mean()) if len(c) > 1 else 0.0


def _log_model(counts: np.ndarray, weight: float, even: float) -> np.ndarray:
    """log P(next | this), smoothed towards the mean of the character frequencies and the uniform law."""
    c = counts.reshape(_K, _K)[:, :-1].astype(float)  # within a token there is no edge to go to
    single = c.sum(0)
    prior = (1 - even) * (single / single.sum() if single.sum() else 1 / (_K - 1)) + even / (_K - 1)
    return np.log((c + weight * prior) / (c.sum(1, keepdims=True) + weight))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def train(docs: DataFrame, text_col: str = "text", threshold: float = 2.2) -> MarkovModel:
    texts = docs.select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        total = np.zeros((2, _K * _K), np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if not text:
                    continue
                own = base_spans(text)
                chars = _classes(text).copy()
                for start, _, end, value in own:
                    total[0] += _pairs(_classes(f" {value} "))
                    chars[start:end] = _K - 1
                for m in _TOKEN.finditer(text):  # what the model will have to judge has no label
                    if _mixed(m[0]):
                        chars[m.start():m.end()] = _K - 1
                total[1] += _pairs(chars)
        which, cell = np.nonzero(total)
        yield pd.DataFrame({"which": which.astype("int32"), "cell": cell.astype("int32"), "n": total[which, cell]})

    rows = texts.mapInPandas(count, "which int, cell int, n long").groupBy("which", "cell").agg(F.sum("n").alias("n"))
    table_ = np.zeros((2, _K * _K))
    for r in rows.collect():  # at most 2 x 67 x 67 sums
        table_[r.which, r.cell] = r.n
    ratio = np.zeros((_K, _K))
    ratio[:, :-1] = _log_model(table_[0], 50.0, 0.5) - _log_model(table_[1], 5.0, 0.1)
    return MarkovModel(ratio.ravel(), threshold)


def _outside(start: int, end: int, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that no span covers."""
    for s, _, e, _ in spans:  # sorted by start
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def find_spans(text: str, model: MarkovModel) -> list[tuple[int, int, int]]:
    """All spans as (start, kind number, end)."""
    own = base_spans(text)
    out = [x[:3] for x in own]
    for m in _TOKEN.finditer(text):
        for a, z in _outside(m.start(), m.end(), own):
            if z - a >= MIN_TOKEN and model.score(text[a:z]) >= model.threshold:
                out.append((a, 3, z))
    return sorted(out)


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` with the kind, start and end (code points, end exclusive) of every finding."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "spans": [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, model)] if t else []
                for t in pdf["text"]]})

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {id_type}, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: MarkovModel, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by ``mask`` (overlapping ones by one); null stays null."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t:
                pieces, at = [], 0
                for s, _, e in find_spans(t, model):
                    if s >= at:
                        pieces += [t[at:s], mask]
                    at = max(at, e)
                t = "".join(pieces) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))


# --------------------------------------------------------------------------- query

def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"),
                        said(F.col("spans")).alias("spans"), n("markov"))
