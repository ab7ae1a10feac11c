"""One thin query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_tree, conversation_repair, decontaminate, fingerprint, jaccard, line_runs, periodic_runs, pii_bootstrap, quality_qda, suffix_levels, token_counts, token_files, toxicity_pu
from .common import load, stash


def op1_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(load(spark, sf_dir, "documents"))


def op3_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(load(spark, sf_dir, "documents"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return bpe_tree.round_trip(load(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_files.read_token_files(*token_files.write_token_files(load(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_counts.document_counts(load(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), eod=50256)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(load(spark, sf_dir, "documents"))


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), keep=lambda df: stash(df, "op9-stats"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(load(spark, sf_dir, "conversations")))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(load(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(load(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_pu": op1_toxicity_pu,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_suffix_levels": op3_suffix_levels,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_token_files": op6_token_files,
    "op8_token_counts": op8_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op9_quality_qda": op9_quality_qda,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_runs": op12_line_runs,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL where SQL can express the operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op12_line_runs": line_runs.ORACLE}
