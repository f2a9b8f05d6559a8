"""name -> (query, DuckDB SQL or None) of the training-data operators."""

from __future__ import annotations

from ledgerspark.llm import (best_fit, bpe, chat, embed_dedup, fingerprint, ngram_join, packing, quality, resample, search,
                             secrets, suffix_dedup, url_filter)

from ledgerspark.llm.common import ship_package


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_OWN = {
    "op1_url_filter": (url_filter.op1_url_filter, url_filter.OP1_SQL),
    "op2_secret_scan": (secrets.op2_secret_scan, None),
    "op3_byte_bpe": (bpe.op3_byte_bpe, None),
    "op4_fingerprint": (fingerprint.op4_fingerprint, None),
    "op5_quality_classifier": (quality.op5_quality_classifier, None),
    "op6_embedding_near_dedup": (embed_dedup.op6_embedding_near_dedup, embed_dedup.OP6_SQL),
    "op7_packing": (packing.op7_packing, None),
    "op8_chat_format": (chat.op8_chat_format, chat.OP8_SQL),
    "op9_ngram_jaccard": (ngram_join.op9_ngram_jaccard, ngram_join.OP9_SQL),
    "op10_suffix_dedup": (suffix_dedup.op10_suffix_dedup, None),
    "op11_importance_resample": (resample.op11_importance_resample, resample.OP11_SQL),
    "op12_lexical_search": (search.op12_lexical_search, search.OP12_SQL),
    "op13_best_fit_packing": (best_fit.op13_best_fit_packing, None),
    "pipeline": (pipeline, None),
}

QUERIES = {name: (_shipped(query), sql) for name, (query, sql) in _OWN.items()}
