"""References: from a model's entries to one record per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import stripped

#: Longest raw text and most authors of a reference, and the failures worth another attempt.
RAW_CHARS, MOST_AUTHORS = 1000, 20
RETRYABLE_STATUS, RETRYABLE_ERRORS = (429, 500, 502, 503, 504), ("timeout", "transport")
ATTEMPTS = 2

ENTRY = "key string, raw string, title string, doi string, authors array<string>, year string"


def to_reference(entries: DataFrame) -> DataFrame:
    """Cleans parsed entries (ENTRY and any other columns): empty keys go, empty fields become null, texts and lists are held to their limits."""
    key = stripped(F.coalesce("key", F.lit("")))
    authors = F.slice(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != ""), 1, MOST_AUTHORS)
    year = F.left("year", F.lit(4)).try_cast("int")
    out = entries.withColumns({"key": key, "raw": F.left(F.coalesce("raw", F.lit("")), F.lit(RAW_CHARS)), "title": F.nullif("title", F.lit("")), "doi": F.nullif("doi", F.lit("")), "authors": authors, "year": year})
    return out.where(F.col("key") != "")


def populated() -> Column:
    return sum(x.cast("int") for x in (F.col("title").isNotNull(), F.col("doi").isNotNull(), F.size("authors") > 0, F.coalesce(F.col("year") != 0, F.lit(False))))


def dedupe_richest(refs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One record per key (and ``by``): the richest, the first of equal ones, in the place of the key's first. refs has ``ord``."""
    keys = [*by, "key"]
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("populated"), "ord"))
    ranked = refs.withColumn("populated", populated()).withColumn("rank", best).withColumn("first_ord", F.min("ord").over(W.partitionBy(*keys)))
    return ranked.where("rank = 1").drop("populated", "rank", "ord").withColumnRenamed("first_ord", "ord")


def next_step(attempt: Column, status: Column, error: Column) -> Column:
    """What a model client does after an attempt: ok, retry, or give_up (its chunk is skipped)."""
    failed = error.isNotNull() | (status >= 400)
    passing = error.isin(*RETRYABLE_ERRORS) | status.isin(*RETRYABLE_STATUS)
    return F.when(~F.coalesce(failed, F.lit(False)), "ok").when(F.coalesce(passing, F.lit(False)) & (attempt < ATTEMPTS), "retry").otherwise("give_up")
