"""Acquisition: what became of the search for each reference's open-access file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.identifiers import pdf_name

#: Fixed value: the most bytes of a download.
MOST_BYTES = 50_000_000
# What a result says of a lookup that failed, one without a link, and a download that failed.
LOOKUP_FAILED, NO_LOCATION, DOWNLOAD_FAILED = "locate failed", "oa lookup returned no location", "download failed"
#: Days after which an answer is asked for again, by its status; a file that is open stays open. A lookup that failed is due at once.
GOOD_FOR = {"oa": None, "closed": 30, "unresolved": 7}


def unpaywall(status: Column, body: Column) -> Column:
    """struct<status, pdf_url> of an answer about a DOI: only a direct link to a PDF counts as open."""
    is_json = F.try_parse_json(body).isNotNull()
    url = F.nullif(F.get_json_object(body, "$.best_oa_location.url_for_pdf"), F.lit(""))
    is_open = F.get_json_object(body, "$.is_oa") == "true"
    found = F.when((status == 404) | ~F.coalesce(is_json, F.lit(False)), "unresolved").when(~F.coalesce(is_open, F.lit(False)) | url.isNull(), "closed").otherwise("oa")
    return F.struct(found.alias("status"), F.when(found == "oa", url).alias("pdf_url"))


def openalex(body: Column) -> Column:
    """struct<status, pdf_url> of an answer to a title search; its general link counts if it ends in .pdf."""
    is_json = F.try_parse_json(body).isNotNull()
    first = F.get_json_object(body, "$.results[0]")
    is_open = F.get_json_object(first, "$.open_access.is_oa") == "true"
    general = F.get_json_object(first, "$.open_access.oa_url")
    url = F.coalesce(F.nullif(F.get_json_object(first, "$.best_oa_location.pdf_url"), F.lit("")), F.when(F.lower(general).endswith(".pdf"), general))
    found = F.when(~F.coalesce(is_json, F.lit(False)) | first.isNull(), "unresolved").when(~F.coalesce(is_open, F.lit(False)) | url.isNull(), "closed").otherwise("oa")
    return F.struct(found.alias("status"), F.when(found == "oa", url).alias("pdf_url"))


def locate(by_doi: Column, by_title: Column) -> Column:
    """The DOI's answer, unless it is unresolved or missing; then the title's; else unresolved."""
    none = F.struct(F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("pdf_url"))
    return F.coalesce(F.when(by_doi["status"] != "unresolved", by_doi), by_title, none)


def is_pdf(content: Column, length: Column) -> Column:
    return (length <= MOST_BYTES) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def classify(refs: DataFrame, files: DataFrame, lookups: DataFrame, downloads: DataFrame) -> DataFrame:
    """ref_key, name, status, source_url, detail.

    refs: key, doi. files: name, valid. lookups: key, status (null: the lookup failed), pdf_url. downloads: url, ok.
    """
    named = refs.select(F.col("key").alias("ref_key"), pdf_name(F.col("doi"), F.col("key")).alias("name"))
    there = files.where("valid").select(F.lower("name").alias("lower_name")).distinct()
    # each side grows with the references, and compresses so well that its size alone would send it whole through the driver
    rows = named.join(there.hint("merge"), F.lower("name") == F.col("lower_name"), "left")
    rows = rows.join(lookups.select(F.col("key").alias("ref_key"), F.col("status").alias("found"), "pdf_url").hint("merge"), "ref_key", "left")
    rows = rows.join(downloads.select(F.col("url").alias("pdf_url"), "ok").hint("merge"), "pdf_url", "left")
    fetched = F.coalesce("ok", F.lit(False))
    have = F.col("lower_name").isNotNull()
    located = (F.col("found") == "oa") & F.col("pdf_url").isNotNull()
    status = F.when(have, "already_present").when(F.col("found") == "unresolved", "not_found").when(F.col("found") == "closed", "paywalled").when(located & fetched, "fetched").otherwise("error")
    detail = F.when(status != "error", "").when(F.col("found").isNull(), "locate failed").when(~located, "oa lookup returned no location").otherwise("download failed")
    return rows.select("ref_key", "name", status.alias("status"), F.when(located & ~have, F.col("pdf_url")).alias("source_url"), detail.alias("detail"))


def due(wanted: DataFrame, answers: DataFrame, today: Column) -> DataFrame:
    """The wanted keys that nobody has asked for, or whose last answer is no longer good.

    wanted: key. answers: key, status (null: the lookup failed), day: a table to which every run appends. today: a date.
    """
    last = answers.groupBy(F.col("key").alias("of")).agg(F.max_by("status", "day").alias("status"), F.max("day").alias("day"))
    days = F.lit(0)
    for status, n in GOOD_FOR.items():
        days = F.when(F.col("status") == status, F.lit(n)).otherwise(days)
    fresh = last.where(days.isNull() | (F.datediff(today, "day") < days))
    return wanted.select("key").distinct().join(fresh, F.col("key") == F.col("of"), "left_anti")


def ask_and_keep(wanted: DataFrame, lookup: Callable[[DataFrame], DataFrame], path: str, today: Column) -> int:
    """Asks for what is due and appends the answers to the table at ``path``; returns how many were asked for. lookup: key to key, status, pdf_url."""
    spark = wanted.sparkSession
    try:
        known = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], ANSWER)
    seen = Observation()
    asked = lookup(due(wanted, known, today)).select("key", "status", "pdf_url", today.cast("date").alias("day"))
    asked.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


ANSWER = "key string, status string, pdf_url string, day date"


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
