"""From pages of text to citations and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citations as C


def sentences(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_ord, sentence."""
    return docs.select(F.col(doc_col).alias("doc_id"), F.posexplode(C.split_sentences(F.col(text_col))).alias("sent_ord", "sentence"))


def body_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) up to the first heading of a reference list; later pages go."""
    flagged = pages.withColumn("has_head", F.col("text").rlike(C.REFERENCES_HEADING))
    first = F.min(F.when(F.col("has_head"), F.col("page"))).over(W.partitionBy("doc_id"))
    kept = flagged.withColumn("last", first).where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    return kept.select("doc_id", "page", F.lit(0).alias("seg_ord"), C.before_references(F.col("text")).alias("text"))


def mine(parts: DataFrame) -> DataFrame:
    """Citations of text parts (doc_id, page, seg_ord, text): one row for each marker group that gives keys, numbered through the document.

    doc_id, id, page, seg_ord, sent_ord, pos, claim, ref_keys.
    """
    cut = parts.select("doc_id", "page", "seg_ord", F.posexplode(C.split_sentences(C.strip_line_numbers(F.col("text")))).alias("sent_ord", "sentence"))
    found = cut.select("*", F.explode(C.find_markers(F.col("sentence"))).alias("m"))
    rows = found.select("doc_id", "page", "seg_ord", "sent_ord", F.col("m.pos").alias("pos"), C.strip_markers(F.col("sentence")).alias("claim"), F.col("m.keys").alias("ref_keys"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "seg_ord", "sent_ord", "pos"))
    return rows.withColumn("id", F.format_string("c%04d", number))


def mine_pages(pages: DataFrame) -> DataFrame:
    return mine(body_pages(pages))


def with_fallback(layout: DataFrame, plain: DataFrame) -> DataFrame:
    """Citations mined from layout; those of plain text for documents where layout gave none."""
    return layout.unionByName(plain.join(layout.select("doc_id").distinct(), "doc_id", "left_anti"))


def tag_scope(citations: DataFrame, labels: DataFrame) -> DataFrame:
    """citations with a column kind. labels (doc_id, i, kind) come from an injected model; i counts a document's citations from 0."""
    i = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "seg_ord", "sent_ord", "pos")) - 1  # ids are text: c10000 sorts before c9999
    usable = labels.where(F.col("kind") == "non_checkable").select("doc_id", "i", "kind").distinct()
    return citations.withColumn("i", i).join(usable, ["doc_id", "i"], "left").withColumn("kind", F.coalesce("kind", F.lit("empirical"))).drop("i")


def explode_checks(citations: DataFrame) -> DataFrame:
    """One row for each key of each citation; (doc_id, id, key_ord) is the check's key."""
    return citations.select("*", F.posexplode("ref_keys").alias("key_ord", "ref_key")).drop("ref_keys")
