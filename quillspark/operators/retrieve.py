"""Passages: chunks of a source, the nearest ones within it, and where they stand on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.citations import page_of_name
from ..functions.regex import stripped
from ..shared import new_folder
from . import index

#: Characters in a chunk, most overlap; fragment length and number for highlighting.
CHUNK, OVERLAP = 1500, 150
FRAGMENT, FRAGMENTS = 30, 20


def chunks(docs: DataFrame, size: int = CHUNK, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """source_id, chunk_ord, chunk: stretches of ``size`` characters, each starting an overlap before the last one's end."""
    step = size - min(OVERLAP, size // 8)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(step))
    cut = docs.where(F.length(text_col) > 0).select(F.col(doc_col).alias("source_id"), F.col(text_col).alias("t"), F.posexplode(starts).alias("chunk_ord", "start"))
    return cut.select("source_id", "chunk_ord", F.substring("t", F.col("start") + 1, F.lit(size)).alias("chunk"))


def top_in_source(claims: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """claim_id, source_id, chunk_ord, score, rank: the k nearest chunks of the cited source alone, by an index that is built for this call.

    claims: claim_id, source_id, vector. vectors: source_id, chunk_ord, vector. See ``operators.index`` for one that is kept.
    """
    return index.top_in_source(claims, index.build_index(vectors, new_folder(vectors.sparkSession, "passage-index")), k)


def evidence(contexts: DataFrame) -> DataFrame:
    """paper_id, page, snippet, score, rcs_summary of retriever rows (dockey, name, text, score, context and any other columns)."""
    paper = F.coalesce(F.nullif("dockey", F.lit("")), F.element_at(F.split(F.coalesce("name", F.lit("")), " "), 1))
    return contexts.withColumns({"paper_id": paper, "page": page_of_name(F.coalesce("name", F.lit(""))), "snippet": F.col("text"), "score": F.coalesce("score", F.lit(0.0)), "rcs_summary": F.coalesce("context", F.lit(""))}).drop("dockey", "name", "text", "context")


def fragments(snippet: Column) -> Column:
    """Distinct sentence-like parts of a passage that are long enough to be found."""
    parts = F.transform(F.split(snippet, r"(?<=[.;:])\s+|\n+"), stripped)
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= FRAGMENT)), 1, FRAGMENTS)


def highlights(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """passage_id, source_id, page, start, length of the spans to mark.

    passages: passage_id, source_id, snippet, page (or null: all pages). pages: source_id, page, text. The whole snippet where it stands,
    else its fragments on the page, else its fragments on every page.
    """
    p = passages.select("passage_id", "source_id", "snippet", F.col("page").alias("asked"))
    both = p.join(pages, "source_id").withColumn("here", F.col("asked").isNull() | (F.col("asked") == F.col("page")))
    whole = both.where("here").select("passage_id", "source_id", "page", "text", F.lit(0).alias("tier"), F.col("snippet").alias("f"))
    parts = both.select("passage_id", "source_id", "page", "text", F.when(F.col("here"), 1).otherwise(2).alias("tier"), F.explode(fragments(F.col("snippet"))).alias("f"))
    found = whole.unionByName(parts).where(F.col("f") != "").select("passage_id", "source_id", "page", "tier", F.explode(places(F.col("text"), F.col("f"))).alias("start"), F.length("f").alias("length"))
    best = F.min("tier").over(W.partitionBy("passage_id"))
    return found.withColumn("best", best).where("tier = best").select("passage_id", "source_id", "page", "start", "length")


def places(text: Column, needle: Column) -> Column:
    """Starts of all places of a string that isn't empty, from the left and not overlapping: what lies between them are the pieces of a split."""
    literal = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    sizes = F.transform(F.split(text, literal, -1), F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        at = acc["at"] + size
        return F.struct((at + F.length(needle)).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.when(F.contains(text, needle), F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), zero, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<int>"))


def target_page(first_found: Column, asked: Column, pages: Column) -> Column:
    """The page to show: where something was found, else the one asked for, else the first; within the document."""
    return F.least(F.greatest(F.coalesce(first_found, asked, F.lit(1)), F.lit(1)), pages)
