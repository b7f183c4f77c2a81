"""A training-data pipeline over ``documents``: rules, line dedup, near duplicates, mixing, packing.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of documents. ``run`` writes each
stage's result as Parquet into the shared folder and rereads it, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import boilerplate, fairmix, fertility, packing, rtree
from quillspark.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the rules reject go."""
    return fertility.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, a source being a site: its boilerplate lines go, documents stay; n_chars follows the text.

    Copies of a text are one page and a line needs five pages, so that copies and near copies in a small source are left to the next stage.
    """
    out = boilerplate.line_dedup(docs, host_col="source", min_pages=5, report=False, copies=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near duplicates stays, that with the smallest id."""
    return rtree.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as often as the mix takes it (0 to 3 times)."""
    return fairmix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of sequences of 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: tokenizers decide in the first and the last stage. tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
