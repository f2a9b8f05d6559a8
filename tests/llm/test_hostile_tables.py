"""Every operator and stage on nulls in any column, repeated rows, clashing extra columns and empty tables;
the SQL of the operators that have one."""

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from ledgerspark.llm import (bpe, chat, embed_dedup, fingerprint, ngram_join, packing, quality, secrets, suffix_dedup,
                             url_filter)
from ledgerspark.llm.queries import QUERIES

LONG = "thnt erin oreal " * 8000
TEXTS = [None, "", " \n\t", "one", "one two three four five six", LONG, LONG + "x", "token = 0123456789abcdef01", "\u00e9\U0001f642" * 40,
         "same words here for all of the copies to have and to hold for ever", "same words here for all of the copies to have and to hold for ever"]
NAMES = ["id", "w", "sig", "bucket", "doc", "rid", "k", "n", "keep", "votes", "start", "length", "slot", "ids", "range", "own", "go"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None if i % 2 else "src0", None if i % 5 else 1) for i, t in enumerate(TEXTS)]
    rows += rows[-3:] + [(2, "another text with the same id as one before it has"), (None, TEXTS[-1])]
    rows = [r if len(r) == 5 else (*r, None, None, None) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _with_clashes(df):
    return df.selectExpr("*", *[f"1 AS {n}" for n in NAMES if n not in df.columns])


def _texts(df):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    yield secrets.scan(df, secrets.train(df))
    yield secrets.redact(df, secrets.train(df))
    yield bpe.encode(df, path, public_tokenizers.PATTERN, with_decoded=True)
    yield fingerprint.fingerprint_pairs(df)
    seen = quality.evidence(df)
    yield quality.score(seen, quality.fit(seen))
    yield ngram_join.jaccard_classes(df)
    yield suffix_dedup.remove_repeats(df)
    yield suffix_dedup.cut_repeats(df)


def test_text_operators_keep_every_row(spark, docs):
    df = _with_clashes(docs)
    for out in _texts(df):
        rows = out.collect()
        assert len(rows) == df.count(), out.columns
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
        assert ids == sorted((r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect()), out.columns
    packed = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.where("start = 0").count() == df.count()


def test_text_operators_on_an_empty_table(spark, docs):
    for out in _texts(_with_clashes(docs.limit(0))):
        assert out.count() == 0


def test_pipeline_stages_on_hostile_and_empty_tables(spark, docs):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        n = out.count()
        assert n == docs.count() if name in ("repeats", "secrets") else 0 < n < docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert {9, 10} & left == {9} and None in left


def test_other_operators_on_null_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, None), (None, None), (1, "http://a.com/")], "page_id long, url string").selectExpr("*", "1 AS h", "2 AS k")
    rules = spark.createDataFrame([("a.com", "/", "block"), (None, None, "allow")], "host string, path string, verdict string")
    got = sorted((r.page_id is None, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == [(False, "allow"), (False, "block"), (True, "allow"), (True, "block")]
    vec = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS e", "2 AS rep")
    got = embed_dedup.link_embeddings(vec).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (4, 1, True), (5, 1, False)]
    conv = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(conv).count() == 1


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    fn, sql = QUERIES[name]
    got = fn(spark, sf)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, res.fetchall()))
