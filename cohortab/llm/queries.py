"""The registered queries of the subpackage and their SQL, by name."""

from __future__ import annotations

import os


from cohortab.llm import (
    centroids,
    chat_tools,
    embedding_dedup,
    language_id,
    oracle,
    packing,
    quality_model,
    quality_rules,
    sentencepiece_dropout,
    sharding,
    simhash,
    spelling,
    suffix_dedup,
    url_model,
)


def _read(spark, d, table):
    return spark.read.parquet(os.path.join(d, f"{table}.parquet"))


def op1_chat_tool_calls(spark, d):
    calls, results = chat_tools.calls_of_turns(_read(spark, d, "conversations"))
    return chat_tools.link_tool_calls(calls, results, chat_tools.TOOLS)


def op2_sentencepiece_dropout(spark, d):
    return sentencepiece_dropout.round_trip(_read(spark, d, "documents"))


def op3_rendezvous_sharding(spark, d):
    return sharding.shard_documents(_read(spark, d, "documents"))


def op4_best_fit_packing(spark, d):
    return packing.best_fit_packing(_read(spark, d, "documents"))


def op5_embedding_dedup(spark, d):
    return embedding_dedup.embedding_groups(_read(spark, d, "embeddings"))


def op6_suffix_dedup(spark, d):
    return suffix_dedup.remove_repeats(_read(spark, d, "documents"))


def op7_quality_classifier(spark, d):
    return quality_model.quality_scores(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op8_simhash(spark, d):
    return simhash.simhash_groups(_read(spark, d, "documents"))


def op9_quality_rules(spark, d):
    q = quality_rules.quality_rules(_read(spark, d, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "words_left", "kept")


def op10_url_filter(spark, d):
    return url_model.url_filter(_read(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_language_id(spark, d):
    return language_id.identify(_read(spark, d, "documents"))


def op12_spelling_variants(spark, d):
    return spelling.spelling_variants(_read(spark, d, "documents"))


def op13_centroid_clusters(spark, d):
    return centroids.centroid_clusters(_read(spark, d, "embeddings"))


def queries():
    every = (op1_chat_tool_calls, op2_sentencepiece_dropout, op3_rendezvous_sharding, op4_best_fit_packing,
             op5_embedding_dedup, op6_suffix_dedup, op7_quality_classifier, op8_simhash, op9_quality_rules,
             op10_url_filter, op11_language_id, op12_spelling_variants, op13_centroid_clusters)
    return {f.__name__: f for f in every}


def oracle_sql():
    return {"op5_embedding_dedup": oracle.embedding_groups_sql(), "op9_quality_rules": oracle.quality_rules_sql(),
            "op10_url_filter": oracle.url_filter_sql(), "op11_language_id": oracle.language_id_sql(),
            "op12_spelling_variants": oracle.spelling_variants_sql(), "op13_centroid_clusters": oracle.centroid_clusters_sql()}
