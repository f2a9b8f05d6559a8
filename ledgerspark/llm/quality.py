"""Quality classifier from weak labels.

Overlapping heuristic labellers vote reject / abstain / keep on two aspects of a document,
``junk`` (symbol noise, shouting, bar lists, repetition, none of these at all, and the
given quality label where there is one) and ``toxic`` (a short list of insults, words
learned from labelled toxic documents, none of either, and the given label). A labeller
that sees nothing abstains, which is no evidence. Expectation-maximisation over the vote
patterns of all documents estimates each labeller's accuracy, and the posterior of every
pattern becomes the label of its documents. Those labels train one linear scorer per
aspect on hashed features: a document's words, scaled by their number, and its votes.
A document is kept when neither scorer puts rejection at ``0.5`` or more.

Scale: one pass reads the texts and stores votes and hashed words; the rest works on those.
Votes are counted by pattern (at most 3^labellers rows reach the driver). The given labels,
all of them, are joined by id to a few numbers a row: its votes, packed, and, as a scorer is
linear, the two sums of its words' weights; texts and words never move. Bounds, all parameters: the learned words come from about ``label_rows``
labelled rows, ``train_docs`` documents (chosen by a hash of the id, up to half of them
and more where there is room from the labelled ones) train the scorers, ``lexicon_words``
words are learned. Everything else covers all rows; a task keeps one Arrow batch.

Cases: a document without words (null, empty, blank) is rejected with scores 1 and 0;
repeated rows get equal results; without labels the label votes abstain everywhere; an
empty table gives no rows; extra columns are ignored unless carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut_lineage, small_batches, stored, table

ASPECTS = {"junk": ("symbols", "shouting", "bars", "repeats", "plain", "label"),
           "toxic": ("insults", "learned", "civil", "label")}
REJECT, ABSTAIN, KEEP = 0, 1, 2
#: fixed list of the insult labeller
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown "
                    "imbecile dumb filthy bastard".split())
DIMS = 1 << 18
_CACHE_WORDS = 100_000
_EDGE = ".,;:!?\"'()[]{}*&$%#|"
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True



def _junk_votes(text: str, words: list[str]) -> list[int]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    runs = int((_PUNCT[raw[2:]] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])).sum()) if len(raw) > 2 else 0
    seen = np.bincount(raw, minlength=256)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    n = len(words)
    trigrams = n - 2
    again = 1 - len(set(zip(words, words[1:], words[2:]))) / trigrams if trigrams > 5 else 0.0
    shares = ((runs / n, 0.02, 0.2), (upper / (upper + lower) if upper + lower >= 20 else 0.0, 0.2, 0.5),
              (int(seen[124]) / n, 0.02, 0.2), (again, 0.2, 0.4))
    return [REJECT if x > high else ABSTAIN for x, _, high in shares] + [
        KEEP if all(x <= low for x, low, _ in shares) else ABSTAIN]


class _Reader:
    """Votes and hashed features of one text; remembers the words it has met (a bounded number)."""

    def __init__(self, learned: frozenset):
        self.learned = learned
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, w: str) -> tuple[int, int]:
        k = w.lower().strip(_EDGE)
        got = zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMS, (k in INSULTS) + 2 * (k in self.learned)
        if len(self.known) >= _CACHE_WORDS:
            self.known.clear()
        self.known[w] = got
        return got

    def votes(self, text: str) -> tuple[tuple[int, ...], list] | None:
        """The label votes abstain here."""
        words = text.split() if text else []
        if not words:
            return None
        known = self.known
        pairs = [known.get(w) or self._word(w) for w in set(words)]
        hit = 0
        for _, f in pairs:
            hit |= f
        v = (*_junk_votes(text, words), ABSTAIN, REJECT if hit & 1 else ABSTAIN, REJECT if hit & 2 else ABSTAIN,
             ABSTAIN if hit else KEEP, ABSTAIN)
        return v, pairs


def _vote_feature(i: int, vote: int) -> int:
    return zlib.crc32(f"vote {i} {vote}".encode()) % DIMS


_VOTES = sum(map(len, ASPECTS.values()))
#: places of the given labels' votes
_QUALITY, _TOXIC = len(ASPECTS["junk"]) - 1, _VOTES - 1
_VOTE_FEATURES = np.array([[_vote_feature(i, v) for v in range(3)] for i in range(_VOTES)])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500,
                             tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """P(reject) of each vote pattern, and the labellers' accuracies. ``patterns`` is (patterns, labellers);
    the last labeller (the given label) starts as the most accurate one. Votes are independent given the
    class, both classes are equally likely before any vote, and an abstention says nothing."""
    sign = np.select([patterns == REJECT, patterns == KEEP], [1.0, -1.0], 0.0)
    cast = np.abs(sign) * counts[:, None]
    accuracy = np.append(np.full(patterns.shape[1] - 1, .8), .95)
    p = np.full(len(patterns), .5)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-sign @ np.log(accuracy / (1 - accuracy))))
        done = np.abs(new - p).max(initial=0.0) < tolerance
        p = new
        if done:
            break
        right = np.where(sign > 0, p[:, None], 1 - p[:, None]) * cast
        accuracy = np.clip((right.sum(0) + .8) / (cast.sum(0) + 1), .05, .999)
    return p, accuracy


def train_linear(votes: np.ndarray, words: list[np.ndarray], target: np.ndarray, epochs: int = 150,
                 rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression towards soft targets by adaptive full gradients; the last weight is the bias."""
    weights, grown = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-8)
    if not len(words):
        return weights
    vote = _VOTE_FEATURES[np.arange(_VOTES), votes]
    blocks = []
    for at in range(0, len(words), 1000):  # bounds the temporaries of a gradient
        part = words[at:at + 1000]
        sizes = np.array([len(w) for w in part])
        blocks.append((slice(at, at + len(part)), np.concatenate(part), np.cumsum(sizes) - sizes,
                       np.repeat(np.arange(len(part), dtype=np.int32), sizes), 1 / np.sqrt(sizes)))
    for _ in range(epochs):
        g = decay * weights
        g[-1] = 0.0
        for rows, index, first, owner, value in blocks:
            z = np.add.reduceat(weights[index], first) * value + weights[vote[rows]].sum(1) + weights[-1]
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[rows]) / len(words)
            g += np.bincount(index, (miss * value)[owner], DIMS + 1)
            np.add.at(g, vote[rows], miss[:, None])
            g[-1] += miss.sum()
        grown += g * g
        weights -= rate * g / np.sqrt(grown)
    return weights


def _share(n_rows: int, wanted: int) -> int:
    return int(min(1.0, wanted / max(n_rows, 1)) * (1 << 30)) + 1


def _given_labels(labels: DataFrame | None, id_col: str, label_rows: int) -> tuple[dict, int]:
    """id -> (quality, toxic) of about ``label_rows`` labelled ids, and the hash bound that chose them: the
    sample that words are learned from."""
    if labels is None:
        return {}, 0
    cut = _share(labels.count(), label_rows)
    got = labels.where(F.pmod(F.xxhash64(F.lit("labels"), F.col(id_col)), F.lit(1 << 30)) < cut).groupBy(id_col).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return {r[0]: (r["q"], r["t"]) for r in got.collect()}, cut


def _learn_words(docs: DataFrame, given: dict, cut: int, lexicon_words: int) -> frozenset:
    """Words of many toxic documents that documents labelled clean hardly use. Copies count once."""
    own = docs.where(F.pmod(F.xxhash64(F.lit("labels"), "id"), F.lit(1 << 30)) < cut)
    toxic_ids, clean_ids = ({k for k, (_, t) in given.items() if t == v} for v in (1, 0))
    if len(toxic_ids) < 5 or not clean_ids:
        return frozenset()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[k in toxic_ids or k in clean_ids for k in pdf["id"]]]

    labelled = own.select("id", F.md5("text").alias("h")).mapInPandas(mark, own.select("id", F.md5("text").alias("h")).schema)
    once = {r["i"] for r in labelled.groupBy("h").agg(F.min("id").alias("i")).select("i").collect()}  # <= the labels in use
    toxic, clean = toxic_ids & once, clean_ids & once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"]):
                if text and (key in toxic or key in clean):
                    (bad if key in toxic else good).update({w.lower().strip(_EDGE) for w in set(text.split())})
        both = list(bad)  # words of no toxic document cannot be learned
        yield pd.DataFrame({"word": pd.Series(both, dtype=object), "bad": pd.Series([bad[w] for w in both], dtype="int64"),
                            "good": pd.Series([good[w] for w in both], dtype="int64")})

    seen = own.select("id", "text").mapInPandas(count, "word string, bad long, good long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate_bad, rate_good = F.col("bad") / max(len(toxic), 1), (F.col("good") + 0.5) / max(len(clean), 1)
    top = seen.where((F.col("bad") >= 5) & (rate_bad >= 0.02) & (rate_bad / rate_good >= 100)).orderBy(
        F.desc("bad"), "word").limit(lexicon_words)
    return frozenset(r["word"] for r in top.collect())


def _packed(votes):
    """The labellers' votes in base three; the label votes abstain and are added where they are known."""
    return F.aggregate(votes, F.lit(0), lambda at, v: at * 3 + v)


def _with_labels(slim: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``slim`` rows (``_id``, packed ``_votes``, numbers) with the votes of the given labels, ``_quality`` and ``_toxic``."""
    if labels is None:
        return slim.withColumn("_quality", F.lit(ABSTAIN)).withColumn("_toxic", F.lit(ABSTAIN))

    def vote(value, bad: int):
        return F.when(F.col(value).isNull(), ABSTAIN).when(F.col(value) == bad, REJECT).otherwise(KEEP)

    return slim.join(labels, F.col("_id") == F.col("_given"), "left").select(
        *slim.columns, vote("_q", 0).alias("_quality"), vote("_t", 1).alias("_toxic"))


@dataclass
class Evidence:
    """``seen``: the carried columns of every document with its ``_id``, ``_row`` (a hash of id and text), packed ``_votes`` and
    hashed ``_words`` (null without words), stored; ``labels``: ``_given, _q, _t`` per labelled id."""
    seen: DataFrame
    labels: DataFrame | None
    carry: tuple[str, ...]

    def voted(self, *numbers: str) -> DataFrame:
        """``_id, _row, _votes``, the given labels' votes and ``numbers`` of the documents with words."""
        slim = self.seen.where("_votes IS NOT NULL").select("_id", "_row", "_votes", *numbers)
        return _with_labels(slim, self.labels)


def evidence(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             carry: tuple[str, ...] = ("doc_id",), label_rows: int = 20_000, lexicon_words: int = 200) -> Evidence:
    """Votes and hashed words of every document, stored in the shared folder: texts are read once, whatever is then fitted
    and scored."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    given, cut = _given_labels(labels, id_col, label_rows)
    learned = _learn_words(d, given, cut, lexicon_words)

    @F.pandas_udf("struct<votes:array<int>,words:binary>")
    def look(texts: pd.Series) -> pd.DataFrame:
        reader, votes, words = _Reader(learned), [], []
        for text in texts:
            got = reader.votes(text)
            votes.append(list(got[0]) if got else None)
            words.append(np.unique(np.fromiter((i for i, _ in got[1]), np.int32, len(got[1]))).tobytes() if got else None)
        return pd.DataFrame({"votes": pd.Series(votes, dtype=object), "words": pd.Series(words, dtype=object)})

    seen = docs.withColumn("_e", look(F.col(text_col))).select(
        *carry, F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), _packed(F.col("_e.votes")).alias("_votes"),
        F.col("_e.words").alias("_words"))
    own = None if labels is None else labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_given")).agg(
        F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
    with small_batches(docs.sparkSession):
        return Evidence(stored(seen), own, carry)


def _unpacked(votes: np.ndarray, quality: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """(rows, labellers) votes with those of the given labels."""
    out = votes[:, None] // 3 ** np.arange(_VOTES - 1, -1, -1) % 3
    out[:, _QUALITY], out[:, _TOXIC] = quality, toxic
    return out


def _training_rows(voted: DataFrame, n_labelled: int, n_other: int, train_docs: int) -> DataFrame:
    """About ``train_docs`` rows: labelled ones fill half, or what the others leave. The labelled ones are
    chosen by the hash that chooses the rows words are learned from, the others by a hash of id and text."""
    own = min(n_labelled, max(train_docs // 2, train_docs - n_other))
    labelled = (F.col("_quality") != ABSTAIN) | (F.col("_toxic") != ABSTAIN)

    def drawn(salt: str, by: str, n_rows: int, wanted: int):
        return F.pmod(F.xxhash64(F.lit(salt), F.col(by)), F.lit(1 << 30)) < (_share(n_rows, wanted) if n_rows else 0)

    return voted.where(F.when(labelled, drawn("labels", "_id", n_labelled, own)).otherwise(drawn("train", "_row", n_other, train_docs - own)))


def fit(ev: Evidence, train_docs: int = 20_000) -> dict[str, np.ndarray]:
    """Weights per aspect. All documents' votes go into the labellers' accuracies; about ``train_docs``
    documents train the scorers (see ``_training_rows``; equal rows are one)."""
    voted = ev.voted()
    counted = voted.groupBy("_votes", "_quality", "_toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()  # <= 3^labellers rows
    pattern = _unpacked(*(counted[c].to_numpy(int) for c in ("_votes", "_quality", "_toxic")))
    n = counted["n"].to_numpy(float)
    n_labelled = int(n[(pattern[:, _QUALITY] != ABSTAIN) | (pattern[:, _TOXIC] != ABSTAIN)].sum())
    picked = _training_rows(voted, n_labelled, int(n.sum()) - n_labelled, train_docs).groupBy("_row").agg(
        F.first("_votes").alias("v"), F.first("_quality").alias("q"), F.first("_toxic").alias("t"))
    picked = cut_lineage(picked)
    # about train_docs rows of four numbers, whatever the table
    words = ev.seen.select("_row", "_words").join(F.broadcast(picked.select("_row")), "_row").dropDuplicates(["_row"])
    sample = picked.join(words, "_row").orderBy("_row").select("v", "q", "t", "_words").collect()
    votes = _unpacked(*(np.array([r[c] for r in sample], int) for c in "vqt"))
    index = [np.frombuffer(r["_words"], np.int32) for r in sample]
    del sample
    weights, at = {}, 0
    for aspect, labellers in ASPECTS.items():
        sub = slice(at, at + len(labellers))
        at += len(labellers)
        own, place = np.unique(pattern[:, sub], axis=0, return_inverse=True)
        p, _ = expectation_maximisation(own, np.bincount(place.ravel(), n, len(own)))
        posterior = {tuple(v): x for v, x in zip(own.tolist(), p.tolist())}
        weights[aspect] = train_linear(votes, index, np.array([posterior[tuple(v)] for v in votes[:, sub].tolist()]))
    return weights


def score(ev: Evidence, weights: dict[str, np.ndarray]) -> DataFrame:
    """The carried columns of every document with ``junk`` and ``toxic`` (probabilities of rejection) and ``keep``."""
    b = ev.seen.sparkSession.sparkContext.broadcast(weights)  # 2 x 2^18 numbers

    @F.pandas_udf("struct<junk:double,toxic:double>")
    def sums(votes: pd.Series, words: pd.Series) -> pd.DataFrame:
        """What the words and the labellers that look at the text add; the given labels' votes are left out."""
        has = votes.notna().to_numpy()
        out = {aspect: np.zeros(len(votes)) for aspect in b.value}
        if has.any():
            packed = votes[has].to_numpy(int)
            cast = packed[:, None] // 3 ** np.arange(_VOTES - 1, -1, -1) % 3
            looking = [i for i in range(_VOTES) if i not in (_QUALITY, _TOXIC)]
            vote = _VOTE_FEATURES[looking, cast[:, looking]]
            index = [np.frombuffer(w, np.int32) for w in words[has]]
            sizes = np.array([len(i) for i in index])
            flat, first = np.concatenate(index), np.cumsum(sizes) - sizes
            for aspect, w in b.value.items():
                out[aspect][has] = np.add.reduceat(w[flat], first) / np.sqrt(sizes) + w[vote].sum(1) + w[-1]
        return pd.DataFrame(out)

    summed = ev.seen.withColumn("_s", sums("_votes", "_words")).select(
        *ev.carry, "_id", F.col("_votes").isNotNull().alias("_has"), "_s.junk", "_s.toxic")
    labelled = _with_labels(summed, ev.labels)

    def chance(aspect: str):
        w, z = weights[aspect], F.col(aspect)
        for column, labeller in (("_quality", _QUALITY), ("_toxic", _TOXIC)):
            at = [float(w[i]) for i in _VOTE_FEATURES[labeller]]
            z = z + F.when(F.col(column) == REJECT, at[REJECT]).when(F.col(column) == KEEP, at[KEEP]).otherwise(at[ABSTAIN])
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))

    out = labelled.select(*ev.carry, F.when(F.col("_has"), chance("junk")).otherwise(1.0).alias("junk"),
                          F.when(F.col("_has"), chance("toxic")).otherwise(0.0).alias("toxic"))
    return out.withColumn("keep", (F.col("junk") < 0.5) & (F.col("toxic") < 0.5))


# --------------------------------------------------------------------------- query

def op5_quality_classifier(spark, sf_dir):
    seen = evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(seen, fit(seen))
