"""From layout blocks to body text, page by page.

Blocks: doc_id, page, ord, text, x0, y0, x1, y1, size, bold, page_height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.regex import stripped
from ..shared import spread

# Shapes of captions, numbered headings, mathematics and page numbers.
CAPTION = r"(?i)^\s*(?:figure|fig|table|tbl|scheme)\s*\d+\s*[.:]"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\.?\s+[A-Z]"
MATHEMATICS = r"[=∑∫√±×÷≈≤≥∝]"
PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[ivxlcdm]+|(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?)$"
# Margin band, longest heading, size of headings over body, least letters of an equation and a capitals heading, column gap.
MARGIN, SHORT, LARGER, LETTERS, CAPITALS, GAP, SLACK = 0.08, 100, 1.15, 0.5, 6, 0.15, 1.0


def norm_repeat(text: Column) -> Column:
    """Lower case, with tokens that are only digits as '#'."""
    return F.regexp_replace(F.lower(stripped(text)), r"(?<!\S)\d+(?!\S)", "#")


def is_page_number(text: Column) -> Column:
    return stripped(text).rlike(PAGE_NUMBER)


def in_margin() -> Column:
    middle = (F.col("y0") + F.col("y1")) / 2
    return (F.col("page_height") > 0) & ((middle < MARGIN * F.col("page_height")) | (middle > (1 - MARGIN) * F.col("page_height")))


def body_size(blocks: DataFrame) -> DataFrame:
    """doc_id, body_size: the size most text is set in; of equal ones the first seen."""
    weight = F.struct(F.sum(F.length(stripped(F.col("text")))).alias("chars"), (-F.min(F.col("page") * (1 << 20) + F.col("ord"))).alias("early"))
    sizes = blocks.where(~C.blank(F.col("text"))).groupBy("doc_id", F.round("size", 1).alias("body_size")).agg(weight.alias("weight"))
    return sizes.groupBy("doc_id").agg(F.max_by("body_size", "weight").alias("body_size"))


def _with_body_size(placed: DataFrame) -> DataFrame:
    """Adds the ``body_size`` of the blocks' document, 0 without text; of equal ones the first in reading order."""
    rows = placed.withColumn("chars", F.length(stripped(F.col("text")))).withColumn("rounded", F.round("size", 1))
    solid, alike, document = F.col("chars") > 0, W.partitionBy("doc_id", "rounded"), W.partitionBy("doc_id")
    weight = F.struct(F.sum(F.when(solid, F.col("chars"))).over(alike).alias("chars"), (-F.min(F.when(solid, F.col("page") * (1 << 20) + F.col("place"))).over(alike)).alias("early"))
    best = F.max(F.when(solid & F.col("doc_id").isNotNull(), F.struct("weight", "rounded"))).over(document)
    return rows.withColumn("weight", weight).withColumn("body_size", F.coalesce(best["rounded"], F.lit(0.0))).drop("chars", "rounded", "weight")


def drop_margins(blocks: DataFrame) -> DataFrame:
    """Without page numbers and running heads: margin blocks shaped like a page number, or with one text on two pages."""
    margin = in_margin() & ~C.blank(F.col("text"))
    # only texts of margins are compared; all other rows of a document have none
    flagged = blocks.withColumn("margin", margin).withColumn("norm", F.when(F.col("margin"), norm_repeat(F.col("text"))))
    alike = W.partitionBy("doc_id", "norm")
    paged = F.when(F.col("norm").isNotNull(), F.col("page"))
    again = F.coalesce(F.min(paged).over(alike) < F.max(paged).over(alike), F.lit(False)) & F.col("doc_id").isNotNull()
    drop = F.col("margin") & (is_page_number(F.col("text")) | F.col("again"))
    return flagged.withColumn("again", again).where(~drop).select(*blocks.columns)


def classify(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """heading, caption, equation or body. What holds a citation marker is body; in doubt it is body too."""
    t = stripped(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    short = (F.length(t) <= SHORT) & ~F.contains(t, F.lit("\n"))
    capitals = (letters > 0) & (F.upper(t) == t) & (t.rlike(r"\S\s+\S") | (letters >= CAPITALS))
    larger = (body > 0) & (size > body * LARGER)
    heading = short & ~t.rlike(r"[.!?]$") & (t.rlike(NUMBERED_HEADING) | F.coalesce(bold, F.lit(False)) | F.coalesce(larger, F.lit(False)) | capitals)
    equation = short & t.rlike(MATHEMATICS) & (letters / F.length(t) < LETTERS)
    return F.when((t == "") | C.has_marker(t), "body").when(t.rlike(CAPTION), "caption").when(heading, "heading").when(equation, "equation").otherwise("body")


def ordered(blocks: DataFrame) -> DataFrame:
    """Adds ``place``, the reading order on the page: two columns only where a gutter leaves no doubt, else from top to bottom."""
    page = W.partitionBy("doc_id", "page")
    by_center = page.orderBy("cx", "ord")
    b = blocks.withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    b = b.withColumn("before", F.lag("cx").over(by_center))
    # of equal gaps the leftmost counts
    gap = F.struct((F.col("cx") - F.col("before")).alias("gap"), (-F.col("cx")).alias("early"), ((F.col("cx") + F.col("before")) / 2).alias("gutter"))
    b = b.withColumn("best", F.max(F.when(F.col("cx") > F.col("before"), gap)).over(page)).withColumn("gutter", F.col("best.gutter"))
    left, right = F.col("cx") < F.col("gutter"), F.col("cx") >= F.col("gutter")
    width = F.max("x1").over(page) - F.min("x0").over(page)
    two = (
        (width > 0)
        & (F.col("best.gap") > GAP * width)
        & (F.sum(left.cast("int")).over(page) >= 2)
        & (F.sum(right.cast("int")).over(page) >= 2)
        & (F.max(F.when(left, F.col("x1"))).over(page) <= F.col("gutter") + SLACK)
        & (F.min(F.when(right, F.col("x0"))).over(page) >= F.col("gutter") - SLACK)
        & (F.max(((F.col("x0") < F.col("gutter")) & (F.col("x1") > F.col("gutter"))).cast("int")).over(page) == 0)
    )
    b = b.withColumn("column", F.when(F.coalesce(two, F.lit(False)) & right, 1).otherwise(0))
    return b.withColumn("place", F.row_number().over(page.orderBy("column", "y0", "x0", "ord"))).select(*blocks.columns, "place")


def segments(placed: DataFrame) -> DataFrame:
    """doc_id, page, seg_ord, text: body blocks in a row, joined; any other block ends a segment and is left out. placed: with place and body_size."""
    kind = classify(F.col("text"), F.col("size"), F.col("bold"), F.col("body_size"))
    page = W.partitionBy("doc_id", "page").orderBy("place")
    b = placed.withColumn("kind", kind).withColumn("island", F.sum((F.col("kind") != "body").cast("int")).over(page))
    b = b.where((F.col("kind") == "body") & ~C.blank(F.col("text")))
    grouped = b.groupBy("doc_id", "page", "island").agg(F.array_sort(F.collect_list(F.struct("place", stripped(F.col("text")).alias("t")))).alias("parts"))
    seg = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("island")) - 1
    return grouped.select("doc_id", "page", seg.alias("seg_ord"), F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def clean_pages(blocks: DataFrame) -> DataFrame:
    """Body segments up to the first block with a heading of a reference list; the body size is measured on what stands before it."""
    placed = ordered(drop_margins(spread(blocks, "doc_id")))
    reading = W.partitionBy("doc_id").orderBy("page", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = placed.withColumn("past", F.max(F.col("text").rlike(C.REFERENCES_HEADING).cast("int")).over(reading)).where("past = 0").drop("past")
    return segments(_with_body_size(kept))
