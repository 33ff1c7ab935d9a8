"""The registered queries of the corpus operators: thin calls over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import column_bwt, cube_mixing, factorisation, itq_neighbours, license_scan, oracles, pair_alignment, phrase_automata, prefix_join, pu_toxicity, quality_rules, token_files, vector_packing, zone_clusters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op4_quality_rules(_table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects in the ledger of all documents, and what only it rejects."""
    return quality_rules.ablation(quality_rules.ledger(_table(spark, sf_dir, "documents")), quality_rules.POLICIES["v2"])


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(_table(spark, sf_dir, "documents"), vector_packing.default_tokenizer())


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.substring_dedup(_table(spark, sf_dir, "documents"))


def op8_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_bwt.suffix_dedup(_table(spark, sf_dir, "documents"))


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_itq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_neighbours.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_alignment.align(_table(spark, sf_dir, "documents"), *pair_alignment.default_tokenizers())


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), token_files.default_tokenizer())


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_itq_neighbours": op2_itq_neighbours,
    "op3_factorisation": op3_factorisation,
    "op4_quality_rules": op4_quality_rules,
    "op5_phrase_automata": op5_phrase_automata,
    "op6_cube_mixing": op6_cube_mixing,
    "op7_pu_toxicity": op7_pu_toxicity,
    "op8_column_bwt": op8_column_bwt,
    "op9_prefix_join": op9_prefix_join,
    "op10_vector_packing": op10_vector_packing,
    "op11_pair_alignment": op11_pair_alignment,
    "op12_zone_clusters": op12_zone_clusters,
    "op13_token_files": op13_token_files,
    "quality_ablation": quality_ablation,
}
ORACLE_SQL = {
    "op2_itq_neighbours": oracles.COSINE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_phrase_automata": oracles.PHRASES,
    "op8_column_bwt": oracles.BYTES,
    "op9_prefix_join": oracles.JACCARD,
    "quality_ablation": quality_rules.ABLATION_ORACLE,
}
