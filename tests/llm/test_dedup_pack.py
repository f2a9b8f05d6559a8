"""Near-duplicates, repeats and packing against brute force on small hostile inputs."""

import gc
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspark.llm import embed_dedup, ngram_join, packing, pairs, suffix_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")


def _components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    rows = [b.tolist() for b in base]
    rows += [(base[i % 3] + rng.standard_normal(32) * 0.1).tolist() for i in range(60)]
    rows += [base[0].tolist()] * 12 + [(base[1] * 7).tolist()]
    rows += [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], [float("inf")] + [1.0] * 31]
    ids = [7 * i + 3 for i in range(len(rows))]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<double>").selectExpr("*", "1 AS bucket", "2 AS n")
    good = {i: np.array(v) for i, v in zip(ids, rows) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    comp = _components(ids, links)
    got = {r.vec_id: r for r in embed_dedup.link_embeddings(df, block_rows=block, miss=1e-9).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in links), comp[i], comp[i] == i)
    assert embed_dedup.link_embeddings(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    u = rng.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = u + rng.standard_normal((3000, 64)) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = embed_dedup._codes(u), embed_dedup._codes(v)
    near, spread = embed_dedup.estimate(a, b)
    exact = (u * v).sum(1)
    assert abs((near - exact).mean()) < 0.02
    assert (np.abs(near - exact) <= 4 * spread).mean() > 0.999


def _grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("block", [8, 512])
def test_jaccard_classes_equal_brute_force(spark, block):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one two", "One two", "one two three"]
    for _ in range(12):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(40, 160))]
        texts.append(" ".join(w))
        for _ in range(9):
            x = list(w)
            for _ in range(rnd.randrange(0, 5)):
                x[rnd.randrange(len(x))] = rnd.choice(vocab)
            texts.append(" ".join(x) + (" " if rnd.random() < .3 else ""))
    texts += [texts[6]] * 30
    ids = [3 * i + 1 for i in range(len(texts))]
    rnd.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 AS w", "'x' AS sig")
    g = {i: _grams(t) for i, t in zip(ids, texts)}
    links = [(a, b) for a in ids for b in ids if a != b and g[a] and g[b] and len(g[a] & g[b]) >= 0.8 * len(g[a] | g[b])]
    comp = _components(ids, links)
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(df, block_rows=block).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert (got[i].class_id, got[i].n_links, got[i].kept) == (comp[i], sum(a == i for a, _ in links), comp[i] == i)
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def _removed(docs, length=50):
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in docs:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p:p + length]] < i:
                gone[p:p + length] = True
        out.setdefault(i, []).append((len(data), bytes(np.frombuffer(data, np.uint8)[~gone]), int(gone.sum())))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 20, 60)] + ["a" * 70, "xy" * 60, "line of nothing. " * 12]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, passages[3]]
    for _ in range(70):
        t = " ".join(word() for _ in range(rnd.randrange(5, 60)))
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randrange(0, 20)
            at = rnd.randrange(len(t))
            t = t[:at] + p[cut:] + t[at:]
        texts.append(t)
    texts += [texts[20]] * 5
    docs = [(rnd.randrange(10_000), t) for t in texts] + [(5, texts[30]), (5, texts[31])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS starts")
    want = {i: sorted(v) for i, v in _removed(docs).items()}
    got = {}
    for r in suffix_dedup.remove_repeats(df.repartition(7)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, bytes(r.kept), sum(s.end - s.start for s in r.spans)))
    assert {i: sorted(v) for i, v in got.items()} == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    rest = [(i, t) for i, t in docs if i != 5]
    plain = _removed(rest)
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(df.where("doc_id <> 5")).collect()}
    whole = {i: t for i, t in rest if len(plain[i]) == 1 and t and t.isascii()}
    assert len(whole) > 3 and all(cut[i] == plain[i][0][1].decode() for i in whole)


def test_sampling_does_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 103, 30_000, dtype=np.uint8)) + b"z" * 500 + bytes(rng.integers(97, 99, 3000, dtype=np.uint8))
    whole = suffix_dedup.sample(data, 50)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    parts = suffix_dedup.sample(data, 50)
    assert all((a == b).all() for a, b in zip(whole, parts))
    at = np.zeros(len(data), bool)
    at[whole[0]] = True
    assert all(at[p:p + 35].any() for p in range(len(data) - 49))


def test_packing(spark):
    lib = Tokenizer.from_file(PATH)
    rnd = random.Random(17)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = real + [None, "", " ", "x\x1cy  z\x85", "İstanbul ß CAFÉ é ﬁ", "a<|endoftext|>b I'm", "hello " * 5000, "日本語"]
    texts += [" ".join(rnd.choice(["hello", "world", "of"]) for _ in range(rnd.randrange(1, 900))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS slot")
    got = packing.pack_documents(df, PATH).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert total / (2048 * len(by_seq)) > 0.9
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for units in (16, 64):
        h = rng.integers(0, 200, units + 1)
        h[0] = 0
        used = np.zeros(units + 1, int)
        for parts, n in packing.plan(h):
            assert sum(parts) <= units and n > 0
            for p in parts:
                used[p] += n
        assert (used == h).all()
    a = rng.random((6, 9))
    x = packing.nnls(a, a @ np.array([0, 1, 0, 2, 0, 0, 3, 0, 0.0]))
    assert (x >= 0).all() and np.abs(a @ x - a @ np.array([0, 1, 0, 2, 0, 0, 3, 0, 0.0])).max() < 1e-6


def test_components_and_pairs(spark):
    rnd = random.Random(23)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [
        (rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in pairs.connected_components(df).collect()}
    want = _components({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert pairs.connected_components(df.limit(0)).count() == 0
    run = np.array([0, 0, 0, 1, 2, 2, 3, 3, 3, 3])
    for most in (1, 3, 100):
        found = [(a, b) for i, j in pairs.run_pairs(run, most) for a, b in zip(i.tolist(), j.tolist())]
        assert sorted(found) == [(a, b) for a in range(10) for b in range(a + 1, 10) if run[a] == run[b]]


def test_hot_strings_are_dealt_by_window(spark):
    rng, phrase = random.Random(11), "this work is licensed under the usual terms, see the notice"
    prose = lambda: "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(70))
    shared = [prose() for _ in range(3)]
    rows = [(i, (rng.choice(shared) if i % 5 == 0 else prose()) + phrase + prose()) for i in range(400)]
    rows += [(400 + i, prose() + phrase[:30] + prose()) for i in range(100)] + [(3, prose() + phrase), (None, phrase + prose())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    d = suffix_dedup.keyed(df, "doc_id", "text")
    hot = spark.sparkContext.broadcast(suffix_dedup.hot_strings(d, 50, 60, 1))
    assert len(hot.value)
    marks = suffix_dedup._marks(d, 50, hot)
    groups = suffix_dedup._open_contexts(d, marks, 50, hot).groupBy("seed").count()
    assert groups.agg({"count": "max"}).first()[0] < 60
    first = {}
    for i, text in rows:
        for p in range(len(text) - 49):
            w = text[p:p + 50]
            first[w] = min(first.get(w, 1 << 60), -1 if i is None else i)
    want = {}
    for i, text in rows:
        gone = set()
        for p in range(len(text) - 49):
            if first[text[p:p + 50]] < (-1 if i is None else i):
                gone.update(range(p, p + 50))
        want[(i, text)] = gone
    for hot_rows in (60, 1):
        got = suffix_dedup.repeated_spans(df, hot_rows=hot_rows, hot_share=1).collect()
        cut = {}
        for r in got:
            cut.setdefault((None if r.doc == -(1 << 63) else r.doc, r.rid), set()).update(
                b for s, e in zip(r.starts, r.ends) for b in range(s, min(e, 1 << 20)))
        keys = {(r.doc_id, r.rid): r.text for r in d.selectExpr("if(doc = -9223372036854775808, null, doc) doc_id", "rid", "text").collect()}
        assert {k: {b for b in v if b < len(keys[k])} for k, v in cut.items()} == {
            k: want[(k[0], t)] for k, t in keys.items() if want[(k[0], t)]}


def test_trimmed_cache_frees_its_strings():
    """A worker's token cache must not keep forgotten strings until some garbage collection."""
    from ledgerspark.llm.id_cache import IdCache
    cache = IdCache(lambda new: (np.arange(len(new)), np.ones(len(new), np.int64)), limit=4)
    gc.disable()
    try:
        cache.numbers([f"word {i}" for i in range(10)])
        forgotten = weakref.ref(cache.number)
        cache.trim()
        assert len(cache.number) == 2 and forgotten() is None
        assert cache.take(cache.numbers(["other", "word 3"]))[1].tolist() == [1, 1]
    finally:
        gc.enable()
