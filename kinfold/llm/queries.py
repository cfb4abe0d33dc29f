"""The thin queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html_extract, language, line_dedup, mixing, parity_join, revisits, suffix_tree, toxicity
from ._spark import documents, remainder


def op1_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 5) == 1
    scored = suffix_tree.learn_and_score(docs, held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_nonneg_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op5_script_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.train(docs.filter(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(documents(spark, sf_dir))


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = revisits.captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return revisits.resolve(records).select("record_id", "canonical_url", "refers_to", "status", F.col("headers")["content-type"].alias("content_type"), F.col("headers")["date"].alias("date"))


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


def op9_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("removed_words").cast("long").alias("removed_words"), F.col("removed_runs").cast("long").alias("removed_runs"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("rid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_scoring": op1_suffix_tree_scoring,
    "op2_low_discrepancy_mix": op2_low_discrepancy_mix,
    "op3_nonneg_pu_toxicity": op3_nonneg_pu_toxicity,
    "op4_one_permutation_minhash": op4_one_permutation_minhash,
    "op5_script_viterbi_language": op5_script_viterbi_language,
    "op6_parity_sketch_join": op6_parity_sketch_join,
    "op7_revisit_resolution": op7_revisit_resolution,
    "op8_template_extraction": op8_template_extraction,
    "op9_winnowing_line_dedup": op9_winnowing_line_dedup,
    "op10_template_decontamination": op10_template_decontamination,
}
ORACLES: dict[str, str] = {
    "op2_low_discrepancy_mix": mixing.ORACLE,
    "op7_revisit_resolution": revisits.ORACLE,
}
