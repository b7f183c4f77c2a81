"""Spark side of the recipes: tables of sentences, pages, references, files, blocks and checks."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import identifiers as I
from ..operators import mining
from ..shared import new_folder, on_disk, remove, spread, written
from . import recipes as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, s: the documents' own sentences."""
    return mining.sentences(texts(spark, sf_dir)).select("doc_id", F.col("sent_ord").alias("i"), F.col("sentence").alias("s"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, t: the same with markers."""
    return sentences(spark, sf_dir).selectExpr("doc_id", "i", f"{R.MARKED} AS t")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: manuscripts with margin numbers and, in some, a reference list in the middle."""
    by_page = marked(spark, sf_dir).selectExpr("doc_id", f"{R.PAGE} AS page", "i", "t").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("all"))
    joined = by_page.select("doc_id", "page", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("body"))
    return joined.selectExpr("doc_id", "page", f"concat({R.PAGE_TOP}, body, {R.PAGE_END}) AS text")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, g, key_ord, ref_key: every key of every marker."""
    groups = marked(spark, sf_dir).select("doc_id", "i", F.posexplode(C.find_markers(F.col("t"))).alias("g", "m"))
    return groups.select("doc_id", "i", "g", F.posexplode("m.keys").alias("key_ord", "ref_key"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.selectExpr(f"{R.REF_KEY} AS key", "p_partkey AS ref_ord", f"{R.REF_TITLE} AS title", f"{R.REF_DOI} AS doi", f"array({R.REF_AUTHOR}) AS authors", f"{R.REF_YEAR} AS year")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, path_ord (by path), doi, title. Every fifth part has no file."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{R.REF_KEY} AS key", f"{R.REF_DOI} AS rdoi", f"{R.FILE_DOI} AS doi", f"{R.FILE_TITLE} AS title")
    by_slug = F.concat(F.lit("refs/"), I.pdf_name(F.col("rdoi"), F.col("key")))
    path = F.when((F.col("p_partkey") % 4 == 0) & F.col("rdoi").isNotNull(), by_slug).otherwise(F.concat(F.lit("refs/f"), "key", F.lit(".pdf")))
    return parts.select(F.when(F.col("p_partkey") % 5 != 4, path).alias("path"), "doi", "title").where("path is not null").withColumn("path_ord", F.col("path"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return lines.selectExpr(
        "doc_id", f"{R.BLOCK_PAGE} AS page", "ord", f"{R.BLOCK_TEXT} AS text", f"CAST({R.BLOCK_X0} AS DOUBLE) AS x0", f"{R.BLOCK_Y0} AS y0", f"CAST({R.BLOCK_X1} AS DOUBLE) AS x1",
        f"{R.BLOCK_Y0} + 10 AS y1", f"CAST({R.BLOCK_SIZE} AS DOUBLE) AS size", f"{R.BLOCK_BOLD} AS bold", "CAST(800 AS DOUBLE) AS page_height",
    )


def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*R.columns(R.CHECK))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*R.columns(R.OVERRIDE))


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*R.columns(R.ACQ))


def blocks_of_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block: a bibliography for every document: numbered and wrapped, by author with blank lines, or bare lines."""
    lines = texts(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    numbered = F.flatten(F.transform("lines", lambda x, i: F.array(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x), F.lit("2020. wrapped"))))
    by_author = F.transform("lines", lambda x, i: F.concat(x, F.when(i % 3 == 2, F.lit("")).otherwise(F.concat(F.lit(" ("), (2000 + i % 20).cast("string"), F.lit(")"))), F.lit("\n")))
    kind = F.col("doc_id") % 3
    body = F.when(kind == 0, F.array_join(numbered, "\n")).when(kind == 1, F.array_join(by_author, "\n")).otherwise(F.array_join("lines", "\n"))
    return lines.select("doc_id", body.alias("block"))


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: the pages, and a last one with the bibliography."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(R.ENTRIES - 1))).alias("k"))
    lines = docs.selectExpr("doc_id", "k", f"{R.BIB_LINE} AS line").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return pages(spark, sf_dir).unionByName(lines.select("doc_id", F.lit(1_000_000).cast("long").alias("page"), F.concat(F.lit("References\n"), "body").alias("text")))


def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, path_ord, doi, title, text, error of each source that has a file."""
    docs = table(spark, sf_dir, "documents").where(R.SOURCE_FILE).selectExpr(f"{R.SOURCE_PATH} AS path", f"{R.SOURCE_ERROR} AS error", "text")
    return docs.select("path", F.col("path").alias("path_ord"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("title"), F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


#: Without the checksum beside a file there are fewer. Other stores don't look at these.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: On a disk, the folders of documents stand in so many others: making and deleting them waits for others that do so in the same one.
FOLDERS = 64


def written_files(df: DataFrame, label: str) -> str:
    """A folder in the shared one with a text file for each row (doc_id, text), in a folder named by its document.

    On a disk that all tasks share, tasks make folders and files themselves: for each of them Hadoop starts a process that sets permissions, which
    costs far more than the file. Other stores get them from Spark's writer, which puts rows of one doc_id into one file.
    """
    path = new_folder(df.sparkSession, label)
    folder = on_disk(df.sparkSession, path)
    if folder is None:
        df.repartition("doc_id").write.options(**PLAIN_LOCAL).partitionBy("doc_id").text(path)
        return path
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = (text or b"") + b"\n"
                # a name that another attempt of the task repeats, in whatever order its rows come
                digest = hashlib.md5(text).hexdigest()
                seen[doc, digest] += 1
                own = f"{folder}/{(doc or 0) % FOLDERS}/doc_id={doc}"
                os.makedirs(own, exist_ok=True)
                draft = f"{own}/.{part}-{uuid.uuid4().hex}"
                with open(draft, "wb", buffering=0) as f:
                    f.write(text)
                os.replace(draft, f"{own}/part-{part:05d}-{digest}-{seen[doc, digest]}.txt")
        yield from ()

    df.select("doc_id", "text").mapInArrow(run, "doc_id long").write.format("noop").mode("append").save()
    return path


def removed_files(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``written_files``; on a disk, tasks share the work."""
    folder = on_disk(spark, path)
    if folder is not None and (names := os.listdir(folder)):
        spark.sparkContext.parallelize(names, len(names)).foreach(lambda name: shutil.rmtree(f"{folder}/{name}", ignore_errors=True))
    remove(spark, path)


#: About as many documents have files at a time. The driver keeps some 2 kB for each file it lists: half a million didn't fit a heap of 750 MB.
FILES_AT_ONCE = 50_000


def through_files(docs: DataFrame, n: int, label: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in folders of the text files of all ``docs`` (about n rows of doc_id, text). A folder is deleted when what it gave is written."""
    slices, found = max(1, -(-n // FILES_AT_ONCE)), []
    for k in range(slices):
        path = written_files(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k), label)
        found.append(written(read(path), f"{label}-read"))
        removed_files(docs.sparkSession, path)
    return reduce(DataFrame.unionByName, found)


def document_of(path: Column) -> Column:
    return F.regexp_extract(path, r"doc_id=(\d+)/", 1).try_cast("long")


def page_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each document's layout blocks as a decoder's pages, in JSON."""
    span = F.struct("text", "size", F.when(F.col("bold"), 16).otherwise(0).alias("flags"))
    block = F.struct("ord", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines"))
    by_page = blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.max("page_height").alias("height"))
    by_doc = by_page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "height", "blocks"))).alias("pages"))
    return by_doc.select("doc_id", F.to_json("pages").alias("text"))
