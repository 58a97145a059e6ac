"""One query for each operator of this folder, over its whole table, and SQL where it can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, line_dedup, lm_scoring, mixing, ngram_join, pii, quality_rules, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op3_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), b"the key of the check queries").select("doc_id", "text", "n_values")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("frequent", "host", "th")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dedup_lines": op1_dedup_lines,
    "op2_url_filter": op2_url_filter,
    "op3_contaminated": op3_contaminated,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_components": op6_jaccard_components,
    "op7_remove_repeats": op7_remove_repeats,
    "op8_main_text": op8_main_text,
    "op9_lm_scores": op9_lm_scores,
    "op10_mix_sources": op10_mix_sources,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.oracle(),
    "op5_quality_rules": quality_rules.oracle(),
    "op10_mix_sources": mixing.oracle(),
}
