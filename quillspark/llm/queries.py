"""The registered queries of this subpackage: thin selections over its operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, boilerplate, disclosure, fairmix, fertility, lempel, licenses, packing, phrases, polytope, rtree, suffix
from .oracles import ORACLES
from .scratch import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ``pages``, grouped by the host of the URL, with the lines of the page's text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.select("page_id", boilerplate.host(F.col("url")).alias("host"), boilerplate.html_lines(F.col("html")).alias("text"))
    pages = written(pages, "page-lines")  # else the markup is parsed for the counts and again for the result
    return boilerplate.line_dedup(pages).select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(documents(spark, sf_dir))


def op3_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairmix.fair_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(documents(spark, sf_dir), with_bytes=False)


def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_columns(documents(spark, sf_dir), with_media=False)


def op8_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.sanitise(documents(spark, sf_dir), with_text=False)


def op9_jaccard_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.jaccard_join(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel.substring_dedup(documents(spark, sf_dir), with_text=False)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_line_dedup": op1_site_line_dedup,
    "op2_tokenizer_fertility": op2_tokenizer_fertility,
    "op3_weighted_fair_mix": op3_weighted_fair_mix,
    "op4_license_signatures": op4_license_signatures,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_lexical_packing": op6_lexical_packing,
    "op7_audio_features": op7_audio_features,
    "op8_disclosure_sanitiser": op8_disclosure_sanitiser,
    "op9_jaccard_rtree_join": op9_jaccard_rtree_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_near_vectors": op12_near_vectors,
}

__all__ = ["ORACLES", "QUERIES"]
