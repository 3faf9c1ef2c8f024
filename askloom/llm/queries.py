"""One query for each operator of this subpackage, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.llm import (
    bpe, common, jaccard_join, licenses, lz_fingerprint, mixing, phrases, pivot_kmeans, quality, rules, spans, token_files, toxicity_grammar, vector_neardup)

QUERIES: dict = {}
TWINS: dict = {}


def query(fn):
    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        common.prepare(spark)
        return fn(spark, sf.rstrip("/"))
    QUERIES[fn.__name__] = run
    return run


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op3_mix_sources(spark, sf):
    return mixing.mix_documents(table(spark, sf, "documents"))


TWINS["op3_mix_sources"] = mixing.ORACLE


@query
def op6_quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    learned = rules.fit_rules(docs, table(spark, sf, "labels"))
    return rules.apply_rules(docs, learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op1_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.fit_quality(docs, table(spark, sf, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id", (common.crc_of_id() % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_token_files(spark, sf):
    import public_tokenizers

    return token_files.token_file_digests(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_bpe_round_trip(spark, sf):
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query
def op5_toxicity_grammar(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity_grammar.fit_grammar(docs, table(spark, sf, "labels"))
    return toxicity_grammar.score_toxicity(docs, model).select(
        "doc_id", (common.crc_of_id() % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_license_scan(spark, sf):
    return licenses.license_columns(licenses.scan_licenses(table(spark, sf, "documents")))


@query
def op8_vector_near_duplicates(spark, sf):
    return vector_neardup.near_duplicate_vectors(table(spark, sf, "embeddings"))


@query
def op10_similar_documents(spark, sf):
    return jaccard_join.similar_documents(table(spark, sf, "documents"))


@query
def op9_repeated_spans(spark, sf):
    return spans.repeat_digests(table(spark, sf, "documents"))


@query
def op13_pivot_clusters(spark, sf):
    return pivot_kmeans.centroid_clusters(table(spark, sf, "embeddings"))


TWINS["op13_pivot_clusters"] = pivot_kmeans.oracle()


@query
def op12_lz_fingerprints(spark, sf):
    return lz_fingerprint.edited_fingerprints(table(spark, sf, "documents"))


@query
def op11_phrase_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


TWINS["op11_phrase_collocations"] = phrases.ORACLE
