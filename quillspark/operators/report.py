"""Reports as rows of lines; a sink joins or writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import stripped
from .audit import ACQUISITION_ORDER, rank

SNIPPET_CHARS = 300


def _some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def citation_lines(checks: DataFrame) -> DataFrame:
    """rank, ord, lines: the entry of each check. checks: ord, status, claim, ref_key, source_path, rationale, snippet (of its first passage), note."""
    source = F.coalesce(F.element_at(F.split("source_path", "/"), -1), F.col("ref_key"))
    lines = F.array_compact(F.array(
        F.concat(F.lit("## ["), "status", F.lit("] "), "claim"),
        F.concat(F.lit("- cites **["), "ref_key", F.lit("]** → "), source),
        F.when(_some(F.col("rationale")), F.concat(F.lit("- "), "rationale")),
        F.when(_some(F.col("snippet")), F.concat(F.lit("- source: “"), F.left(stripped(F.col("snippet")), F.lit(SNIPPET_CHARS)), F.lit("”"))),
        F.when(_some(F.col("note")), F.concat(F.lit("- note: "), "note")),
        F.lit(""),
    ))
    return checks.select(rank(F.col("status")).alias("rank"), "ord", F.array_join(lines, "\n").alias("lines"))


def acquisition_lines(results: DataFrame) -> DataFrame:
    """section, rank, ord, line. results: ord, ref_key, title, doi, status, detail, pdf_path."""
    label = F.coalesce(F.nullif("title", F.lit("")), F.nullif("doi", F.lit("")), F.lit("(no metadata)"))
    head = F.concat(F.lit("- ["), "status", F.lit("] **"), "ref_key", F.lit("**"))
    missing = F.col("status").isin("error", "not_found", "paywalled")
    detail = F.when(_some(F.col("detail")), F.concat(F.lit(" — "), "detail")).otherwise("")
    line = F.when(missing, F.concat(head, F.lit(" — "), label, detail)).otherwise(F.concat(head, F.lit(" → "), "pdf_path"))
    return results.select(F.when(missing, "supply").otherwise("fetched").alias("section"), rank(F.col("status"), ACQUISITION_ORDER).alias("rank"), "ord", line.alias("line"))
