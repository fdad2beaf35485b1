"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.collocations import COLLOCATION_SQL, collocations
from larkspur.llm.common import read_documents, read_table
from larkspur.llm.decontamination import DECONTAMINATION_SQL, decontamination_report
from larkspur.llm.jaccard import jaccard_components
from larkspur.llm.language import language_scores
from larkspur.llm.mixing import MIX_SQL, mix_report
from larkspur.llm.packing import pack_report
from larkspur.llm.passages import removal_report
from larkspur.llm.secrets import scan_report
from larkspur.llm.token_counts import token_counts
from larkspur.llm.toxicity import toxicity_scores
from larkspur.llm.vectors import nearest, vector_links
from larkspur.llm.whitening import whitening_report


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))


def op5_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read_documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_documents(spark, sf_dir))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(read_documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(read_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_curve_packing, op2_systematic_mix, op3_token_counts, op4_multi_index_neighbours, op5_hyperplane_dedup,
                                   op6_toxicity, op7_language, op8_ngram_jaccard, op9_phrase_automata, op10_secret_scan, op11_decontamination, op12_collocations,
                                   op13_whitening)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_systematic_mix": MIX_SQL, "op11_decontamination": DECONTAMINATION_SQL, "op12_collocations": COLLOCATION_SQL}
