"""Queries of the operators for training data, with production parameters over whole tables."""

from __future__ import annotations

from weftgraph.llm import collinear, decontaminate, licenses, ngram_jaccard, packing, permutation_index, pii, suffix_family, toxicity


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard.similar_documents(_read(spark, sf_dir, "documents"))


def op1_collinear_passages(spark, sf_dir):
    return collinear.shared_passages(_read(spark, sf_dir, "documents"))


def op9_suffix_array_family(spark, sf_dir):
    return suffix_family.long_repeats(_read(spark, sf_dir, "documents"))


def op5_template_decontamination(spark, sf_dir):
    return decontaminate.contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_subword_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_personal_data(spark, sf_dir):
    return pii.personal_spans(_read(spark, sf_dir, "documents"))


def op2_permutation_neighbours(spark, sf_dir):
    return permutation_index.neighbours(_read(spark, sf_dir, "embeddings"))


def op4_license_digests(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op8_token_matrices(spark, sf_dir):
    return packing.token_matrices(_read(spark, sf_dir, "documents"))


def op10_certified_packing(spark, sf_dir):
    return packing.certified_packing(_read(spark, sf_dir, "documents"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
