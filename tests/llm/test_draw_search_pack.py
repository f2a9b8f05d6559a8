"""Importance resampling, lexical search and best-fit packing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspark.llm import best_fit, packing, resample, search
from ledgerspark.llm.id_cache import IdCache

LONG = "Thnt erin ÑORAEL 7x, " * 9000
TEXTS = [None, "", " \n\t", "one", "One two THREE four five six", LONG, "é🙂 Ünï" * 30, "a b c " * 12, "a b c " * 12,
         "two three a b the end of it all and more words to have and to hold for ever one two three four"]
CLASHES = ["id", "w", "text_", "n", "b", "item", "doc", "score", "rank", "bucket", "weight", "length", "piece", "_r", "_k", "_place"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    rows += [(7, "a b c " * 12), (7, "another text under the same id " * 4), *[(100 + i, f"word{i % 7} a two five " * (i % 9)) for i in range(60)]]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"1 AS {c}" for c in CLASHES]).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "One two two the end"), (2, None), (3, "Ñorael ERIN word3 word4 a"), (None, "five a a a"), (1, "nothing here"),
                                  (1, "One two two the end")], "item_id long, text string").selectExpr("*", "1 AS id", "2 AS b")


def _low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(t))


def test_running_crcs_and_shifts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 1000, 200_001):
        x = rng.integers(0, 256, n).astype(np.uint8)
        c = resample.running_crcs(x)
        at = np.unique(rng.integers(0, n + 1, 50))
        assert [zlib.crc32(x[:i].tobytes()) for i in at] == c[at].tolist()
        a, z = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        assert [zlib.crc32(x[i:j].tobytes()) for i, j in zip(a, z)] == (c[z] ^ resample.shift(c[a], z - a)).tolist()


@pytest.mark.parametrize("n_max", [1, 3])
def test_features_are_word_runs(monkeypatch, n_max):
    texts = [t.encode() if t is not None else None for t in TEXTS]
    for size in (1 << 20, 300):  # a small slice cuts long texts into parts
        monkeypatch.setattr(resample, "SLICE_BYTES", size)
        got = Counter()
        for rows, crc, n in resample.features(texts, n_max):
            got.update(zip(rows.tolist(), crc.tolist()))
        want = Counter((i, zlib.crc32(" ".join(w[k:k + n]).encode())) for i, t in enumerate(TEXTS) for w in [_words(t)]
                       for n in range(1, n_max + 1) for k in range(len(w) - n + 1))
        assert got == want


@pytest.mark.parametrize("n_max,buckets", [(1, 10_000), (2, 64)])
def test_resample(spark, docs, items, n_max, buckets):
    got = resample.resample(docs, items, n_max=n_max, buckets=buckets, share=40, min_words=4).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)

    def feats(t):
        w = _words(t)
        return [zlib.crc32(" ".join(w[k:k + n]).encode()) % buckets for n in range(1, n_max + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(feats(x))
    for r in items.collect():
        t.update(feats(r.text))
    big_s, big_t = s.total(), t.total()
    want = []
    for key, x in rows:
        f = feats(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append((key, len(_words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((w for w in want if w[1] >= 4), key=lambda w: (-w[4], w[0] is None, w[0] or 0))
    drawn = [(w[0], w[4], i + 1) for i, w in enumerate(able[:len(able) * 40 // 100])]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_features, r.weight, r.score)) for r in got)
    assert drawn == sorted(((r.doc_id, r.score, r.rank) for r in got if r["rank"] is not None), key=lambda r: r[2])


def test_search(spark, docs, items, monkeypatch):
    rows = [(r.doc_id, Counter(_words(r.text))) for r in docs.select("doc_id", "text").collect()]
    counted = [c for _, c in rows if c]
    n_all, length = len(counted), sum(c.total() for c in counted)
    df = Counter(t for c in counted for t in c)
    want = Counter()
    for r in items.collect():
        scored = []
        for key, c in rows:
            if c:
                m = 25 + 75 * c.total() * n_all // length
                s = sum(n * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, n in Counter(_words(r.text)).items() if c[t])
                if s > 0:
                    scored.append((s, key))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        want.update((r.item_id, i + 1, key, s) for i, (s, key) in enumerate(scored[:10]))
    for slice_bytes, block in ((8 << 20, 2000), (400, 2)):
        monkeypatch.setattr(search, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(search, "BLOCK_ITEMS", block)
        assert Counter(map(tuple, search.search(docs, items).collect())) == want


def test_search_stops_making_accumulators():
    """Terms after the stop add to documents that have an accumulator, exactly, and to no others."""
    n = 3000
    term = [0] * 20 + [1] * n
    doc = list(range(0, 2000, 100)) + list(range(n))
    p = search.Postings(term, doc, np.array([1000] * 20 + [1] * n), n, 2)
    found, score = p.rank(np.array([0, 1]), np.array([1, 1]), 10, 1)
    assert len(found) == 20 and set(score.tolist()) == {1001} and not p.score.any()


@pytest.mark.parametrize("make", [lambda: best_fit.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")),
                                  lambda: packing._Tokenizer(public_tokenizers.path("word_bpe_49k.json"))])
def test_ids_equal_the_library(make, monkeypatch):
    monkeypatch.setattr(best_fit, "_CACHE_CHUNKS", 40)
    monkeypatch.setattr(packing, "_CACHE_CHUNKS", 40)
    tok = make()
    lib = tok.library if hasattr(tok, "library") else tok.lib
    hostile = ["", "  ", " a", "a ", "a  b", "\n a\n\nb \t c", "x<|endoftext|> y", "<|endoftext|>", "a <|endoftext|>  b", None, "don't 's  '  s'",
               "　a　 b", "1 22  333 ² ½", "é ñ ", "İstanbul ǅ ß ΑΣ ας", "á b\x1fc\x1c d\x85e", "\x00 \x1f a\x1f", "日本 語 Привет", *TEXTS]
    for part in (hostile, hostile[::-1], [f"w{i} x{i % 13}" for i in range(300)], hostile):  # trims the cache between
        ids, ends = tok.ids(pa.array(part, pa.string()))
        for text, a, z in zip(part, ends[:-1], ends[1:]):
            assert ids[a:z].tolist() == lib.encode(text or "", add_special_tokens=False).ids, text


def test_id_cache_keeps_the_most_used():
    cache = IdCache(lambda new: (np.array([len(s) for s in new]), np.ones(len(new), np.int64)), 4)
    cache.numbers(["a", "bb", "ccc", "dddd", "eeeee"], np.array([1, 9, 1, 8, 1]))
    cache.trim()
    assert list(cache.number) == ["bb", "dddd"]
    assert cache.take(cache.numbers(["dddd", "f", "bb"]))[0].tolist() == [4, 1, 2]


def _check_layout(rows, want):
    """Pieces as ``want`` has them, gapless and within the window; the number of sequences."""
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    return len(by)


def _pieces(rows, lib):
    for key, text in rows:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
            yield key, p, a, z - a, zlib.crc32(ids[a:z].tobytes())


def test_best_fit_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for df in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want = list(_pieces([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], lib))
        used = _check_layout(best_fit.pack_documents(df, path).collect(), want)
        assert used <= 1.02 * sum(w[3] for w in want) / 2048 + 1
    assert best_fit.pack_documents(docs.limit(0), path).count() == 0


def test_plan_uses_every_piece_near_the_bound():
    rng = np.random.default_rng(3)
    for sizes, scale in ((rng.integers(1, 2049, 4000), 1), (rng.integers(1, 2049, 300), 50), (rng.choice([700, 701, 1025], 500), 1000), (np.full(40, 1100), 1)):
        histogram = np.bincount(sizes, minlength=2049) * scale
        layout, bound = best_fit.plan(histogram)
        used = np.zeros(2049, int)
        for parts, n in layout:
            assert sum(parts) <= 2048
            np.add.at(used, list(parts), n)
        assert (used == histogram).all()
        sequences = sum(n for _, n in layout)
        assert bound - 1e-6 <= sequences <= 1.08 * bound + 2
        assert sequences <= 1.01 * sum(n for _, n in best_fit.best_fit(histogram)) + 1


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    sizes, worth = np.array([3, 4, 7, 9]), rng.random(4)
    best, last, used = best_fit.knapsack(sizes, worth, 30)
    brute = [0.0] * 31
    for room in range(31):
        brute[room] = max([0.0, *(worth[i] + brute[room - s] for i, s in enumerate(sizes) if s <= room)])
    assert np.allclose(best, brute)


def test_empty_tables(spark, docs, items):
    assert resample.resample(docs.limit(0), items).count() == 0
    assert resample.resample(docs, items.limit(0)).count() == docs.count()
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
