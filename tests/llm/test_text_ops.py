"""Byte-level BPE, secrets and fingerprints against brute force on small hostile texts."""

import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken

from ledgerspark.llm import bpe, fingerprint, secrets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
HOSTILE = [None, "", " ", "   ", "a  b\n \n c\t\td  ", "don't I'LL 'S we've", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
           "x\x1cy\x1f z\x85q 　w", "über größe café naïve", "日本語テキスト и русский", "🙂🙃 emoji" * 3,
           "<|endoftext|> hi", "1234567890 ²½Ⅷ", "thorndhe " * 400, "ab" * 3000, "\n\n\n", "a" * 5000 + " b"]


def _ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_equals_tiktoken(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    rnd = random.Random(3)
    texts = HOSTILE + ["".join(rnd.choice("abcdefgh eé'. \n0") for _ in range(rnd.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids")
    e = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    for r in e.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t), repr(t[:60])
        assert bytes(r.decoded) == t.encode()
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, with_decoded=True).collect()
    assert {r.doc_id: bytes(r.decoded) for r in both} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def _plain_spans(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return ([("assign", m.start(), m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
            + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
            + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_base_spans_and_model(spark):
    rnd = random.Random(5)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choice(b62) for _ in range(32)) for _ in range(40)]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    prose = "the thing and another_identifier_of_thirty of understandingly with reasonableness " * 5
    texts = [f"{prose} token = '{h}' {prose}" for h in hexes] + [f"{prose} API_KEY: {k} x" for k in keys[:20]]
    held = keys[20:]
    texts += [f"{prose} {k} {prose}" for k in held] + [None, "", "secret=token:abcdef12", "TOKEN=abc",
              "paſſword=abcdef", "é AKIA" + "A" * 16 + "bAKIA" + "1" * 15, "password:" + "ab12" * 10, prose * 3] + real
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS spans")
    model = secrets.train(df)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(df, model).collect()}
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    for i, t in enumerate(texts):
        want = sorted(_plain_spans(t or ""), key=lambda s: (s[1], order[s[0]]))
        assert [s for s in got[i] if s[0] != "markov"] == want, t
    first = len(hexes) + 20
    found = sum(any(s[0] == "markov" for s in got[first + i]) for i in range(len(held)))
    assert found >= 18  # held-out random keys without any keyword
    rest = range(first + len(held), len(texts))
    assert not any(s[0] == "markov" for i in rest for s in got[i])
    red = {r.doc_id: r.text for r in secrets.redact(df, model).collect()}
    assert red[len(hexes) + 20 + len(held)] is None and red[0] == f"{prose} [SECRET]' {prose}"
    assert secrets.scan(df.limit(0), secrets.train(df.limit(0))).count() == 0


def test_fingerprints_follow_content(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 9))) for _ in range(800)]
    long = [" ".join(rnd.choice(words) for _ in range(n)) for n in (40, 200, 700, 3000, 50, 900)]
    texts = long + ["", None, "é", long[3], long[3] + " and one more", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS edited", "2 AS range")
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1 if i else len(texts) - 1] or ""
        half = len(t) // 2
        assert got[i].edited == t[:len(t) - half] + nxt[:half]
        assert got[i].fingerprint == fingerprint.fingerprint(t) and got[i].n_chars == len(t)
        assert got[i].next_fingerprint == fingerprint.fingerprint(nxt)
    pairs = spark.createDataFrame([(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) for a, b in [
        (long[3], long[3]), (long[3], long[3][:9000] + "zzz" + long[3][9000:]), (long[3], long[5]), ("", "")]], "a string, b string")
    s = [r[0] for r in pairs.select(fingerprint.likeness(pairs.a, pairs.b)).collect()]
    assert s[0] == 1 and s[1] > 0.8 and s[2] < 0.3 and s[3] == 1
    assert fingerprint.fingerprint_pairs(df.limit(0)).count() == 0
    one = fingerprint.fingerprint_pairs(df.where("doc_id = 1")).collect()
    assert one[0].next_fingerprint == one[0].fingerprint
    dup = df.where("doc_id = 1").unionByName(df.where("doc_id = 1")).unionByName(df.where("doc_id = 0"))
    assert fingerprint.fingerprint_pairs(dup).count() == 3


def test_fingerprint_does_not_depend_on_blocks(monkeypatch):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(40_000))
    whole = fingerprint.fingerprint(text)
    monkeypatch.setattr(fingerprint, "_BLOCK", 1000)
    assert fingerprint.fingerprint(text) == whole
    assert hashlib.md5(whole.encode()).hexdigest()


def test_markov_models_count_every_document(spark):
    rng = random.Random(3)
    words = "plain ordinary identifier_name some-path/of/it value Wörter ключ x1 y22".split()
    texts = ["\n" + " ".join(rng.choices(words, k=4)) + (f" token={rng.getrandbits(64):x}zQ" if i % 50 == 0 else "") + "\n"
             for i in range(30_000)]
    apart = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined = spark.createDataFrame([(i, "".join(texts[i * 100:(i + 1) * 100])) for i in range(300)], "doc_id long, text string")
    assert (secrets.train(apart).ratio == secrets.train(joined).ratio).all()
