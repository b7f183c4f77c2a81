"""Sinks: reports as JSON and Markdown. The headings of the documents are fixed values of their format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import acquisition_lines, citation_lines


def write_json(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines in a folder of part files."""
    reports.write.mode("overwrite").json(path)


def _counts(rows: DataFrame, column: str) -> DataFrame:
    each = rows.groupBy("manuscript", column).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column, "n"))), lambda x: F.concat(x[column], F.lit("="), x["n"].cast("string"))), ", ")
    return each.groupBy("manuscript").agg(listed.alias("counts"))


def _document(head: DataFrame, lines: DataFrame) -> DataFrame:
    body = lines.groupBy("manuscript").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "lines"))), lambda x: x["lines"]), "\n").alias("body"))
    return head.join(body, "manuscript", "left").select("manuscript", F.concat_ws("\n", "head", "body").alias("markdown"))


def citations_markdown(checks: DataFrame) -> DataFrame:
    """manuscript, markdown: one document per manuscript, problems first. checks: manuscript and what ``citation_lines`` takes."""
    head = _counts(checks, "status").select("manuscript", F.concat(F.lit("# Citation check — "), "manuscript", F.lit("\n\nCoverage: "), "counts", F.lit("\n")).alias("head"))
    lines = citation_lines(checks.withColumn("ord", F.struct("manuscript", "ord"))).select(F.col("ord.manuscript").alias("manuscript"), "rank", F.col("ord.ord").alias("ord"), "lines")
    return _document(head, lines)


def acquisition_markdown(results: DataFrame) -> DataFrame:
    """manuscript, markdown: what is to be supplied by hand, then what was fetched. results: manuscript and what ``acquisition_lines`` takes."""
    head = _counts(results, "status").select("manuscript", F.concat(F.lit("# Acquisition — "), "manuscript", F.lit("\n\nSummary: "), "counts", F.lit("\n")).alias("head"))
    rows = acquisition_lines(results.withColumn("ord", F.struct("manuscript", "ord")))
    titles = results.select("manuscript").distinct().select("manuscript", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("## To supply manually (drop into the refs folder)\n").alias("line")), F.struct(F.lit(2).alias("part"), F.lit("\n## Fetched\n").alias("line")))).alias("t"))
    titles = titles.select("manuscript", F.struct(F.col("t.part").alias("part"), F.lit(-1).alias("rank")).alias("rank"), F.lit(None).cast(results.schema["ord"].dataType).alias("ord"), F.col("t.line").alias("lines"))
    part = F.when(F.col("section") == "supply", 1).otherwise(3)
    lines = rows.select(F.col("ord.manuscript").alias("manuscript"), F.struct(part.alias("part"), F.col("rank").alias("rank")).alias("rank"), F.col("ord.ord").alias("ord"), F.col("line").alias("lines"))
    return _document(head, titles.unionByName(lines))


def write_markdown(documents: DataFrame, path: str) -> None:
    """One text file of documents per partition."""
    documents.select(F.col("markdown").alias("value")).write.mode("overwrite").text(path)
