"""Sources: text, PDF folders, layout blocks, stored reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import strip_line_numbers
from ..functions.regex import stripped
from ..operators.acquire import MOST_BYTES, is_pdf
from . import schemas


def text_pages(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", page_break: str = "\f") -> DataFrame:
    """doc_id, page (from 1), text of any text table; pages are parted by form feeds."""
    return df.select(F.col(doc_col).alias("doc_id"), F.posexplode(F.split(text_col, page_break)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """What ``load`` reads, its folders listed by a few tasks for each core. Spark's own measure is a task for each folder, up to 10000, and a task costs more than listing."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return load()
    finally:
        spark.conf.set(LISTING, before)


def _tasks(files: DataFrame) -> int:
    """How many tasks should read a folder: as many as shuffles have, or one for each ``maxPartitionBytes`` where that is more. Spark reckons 4 MB for opening a file, which leaves a task few small ones."""
    spark = files.sparkSession
    size = files._jdf.queryExecution().analyzed().stats().sizeInBytes()
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))


def text_folder(spark: SparkSession, path: str, names: str = "*.txt") -> DataFrame:
    """path, text of all text files under a folder, each whole; an empty file gives no row."""
    files = _listed(spark, lambda: spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names))
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).coalesce(_tasks(files))


PDF_NAMES = "*.[pP][dD][fF]"


def pdf_folder(spark: SparkSession, path: str, with_content: bool = True, names: str = PDF_NAMES) -> DataFrame:
    """path, length and, if asked for, content of all PDFs under a folder, whatever the case of their suffix. Without content no file is opened."""
    files = _listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path))
    return (files if with_content else files.select("path", "modificationTime", "length")).coalesce(_tasks(files))


def bounded_pdfs(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, names: str = PDF_NAMES) -> DataFrame:
    """path, length of the files under a folder that are PDFs of at most ``most_bytes``. The scan takes the limit, so a larger file is never opened."""
    files = pdf_folder(spark, path, names=names).where(F.col("length") <= most_bytes)
    return files.where(is_pdf(F.col("content"), F.col("length"))).select("path", "length")


Decoder = Callable[[bytes], list[dict[str, Any]]]


def pymupdf_decoder(content: bytes) -> list[dict[str, Any]]:
    """Pages of a PDF as dicts: text, height, blocks, title. Needs PyMuPDF, which is not a dependency of this package."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("PDF decoding needs PyMuPDF; pass another decoder or start from extracted text") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        title = ((doc.metadata or {}).get("title") or "").strip()
        return [{"text": p.get_text(), "height": float(p.rect.height), "blocks": p.get_text("dict").get("blocks", []), "title": title} for p in doc]


def pdf_pages(files: DataFrame, decoder: Decoder = pymupdf_decoder) -> DataFrame:
    """path, page, text, title, error. A file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, i + 1, p["text"], p.get("title", ""), None) for i, p in enumerate(decoder(bytes(content)))]
                except Exception as e:  # one bad file must not end the job
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "title", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, title string, error string")


def block_of(raw: Any, page: int, height: float) -> dict[str, Any] | None:
    """A layout block of a decoder's dict, or None if it holds no text or no box. Missing and null parts don't matter."""
    if not isinstance(raw, dict):
        return None
    lines = [line.get("spans") or [] for line in raw.get("lines") or []]
    spans = [span for line in lines for span in line]
    box = raw.get("bbox")
    text = "\n".join("".join(span.get("text") or "" for span in line) for line in lines).strip()
    if not spans or not text or box is None or len(box) < 4:
        return None
    main = max(spans, key=lambda span: len(span.get("text") or ""))
    heavy = bool((main.get("flags") or 0) & 16) or "bold" in str(main.get("font") or "").lower()
    x0, y0, x1, y1 = (float(v) for v in box[:4])
    return {"page": page, "text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": float(main.get("size") or 0.0), "bold": heavy, "page_height": height}


def pdf_blocks(files: DataFrame, decoder: Decoder = pymupdf_decoder) -> DataFrame:
    """Layout blocks of PDFs (BLOCK, doc_id being the path), without margin numbers; files that can't be read give none."""
    names = [c.split()[0] for c in schemas.BLOCK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = decoder(bytes(content))
                except Exception:
                    continue
                found = [b for i, p in enumerate(pages) for raw in p.get("blocks") or [] if (b := block_of(raw, i + 1, p["height"]))]
                out += [{"doc_id": path, "ord": k} | b for k, b in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    blocks = files.select("path", "content").mapInPandas(run, schemas.BLOCK)
    return blocks.withColumn("text", strip_line_numbers(F.col("text"))).where(stripped(F.col("text")) != "")


def file_metadata(pages: DataFrame) -> DataFrame:
    """path, path_ord, doi, title of each file, from the text of its first two pages."""
    from ..functions.identifiers import document_title, first_doi

    head = pages.where("page <= 2").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "").alias("text"), F.max("title").alias("title"))
    return head.select("path", F.col("path").alias("path_ord"), first_doi(F.col("text")).alias("doi"), document_title(F.col("title"), F.col("text")).alias("title"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports: one row per report, in the declared schema. Malformed files fail; missing optional fields are null."""
    return spark.read.schema(schemas.REPORT).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def report_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reports as ``sinks.write_json`` leaves them, one in a line: those that fit the declared schema, and the lines that don't (line, path)."""
    lines = spark.read.text(path).where("value != ''").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    rows = lines.withColumn("r", F.from_json("line", f"{schemas.REPORT}, unread string", {"columnNameOfCorruptRecord": "unread"}))
    return rows.where("r.unread is null").select("r.*").drop("unread"), rows.where("r.unread is not null").select("line", "path")


def checks_of(reports: DataFrame) -> DataFrame:
    """manuscript, check_ord and the check's fields, with the defaults of fields that older files lack."""
    rows = reports.select("manuscript", F.posexplode("checks").alias("check_ord", "c")).select("manuscript", "check_ord", "c.*")
    defaults: dict[str, Column] = {"verdict": F.lit("unchecked"), "rationale": F.lit(""), "confidence": F.lit(0.0), "reviewed": F.lit(False), "note": F.lit("")}
    return rows.withColumns({name: F.coalesce(name, value) for name, value in defaults.items()})
