"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's pages that contain it over the number of the host's
pages; lines above ``max_ratio`` are boilerplate and go, if they stand on ``min_pages`` pages (two: a page's own line is not its
boilerplate). A line is known by a 64-bit hash within its host. Counts are combined before they are shuffled; a page has at most as
many boilerplate lines as it has lines, so a host has at most 1 / max_ratio times its mean page's lines, and that list is all that is
sent back to its pages. Lists and totals are written first, so that their joins are of plain tables: small ones are broadcast by their
size, and the pages of one large host are otherwise split over as many tasks as their bytes need.

Defined results: null text has no lines and stays null; a null host is a host of its own; blank lines are never boilerplate; repeated
rows count as pages of their own (unless ``copies`` is off); all columns of the input are kept and names of other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, written

MAX_RATIO = 0.1
MIN_PAGES = 2


def host(url: Column) -> Column:
    """The host of an absolute URL, in lower case, without user, port and a leading ``www.``; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.when(found != "", F.regexp_replace(found, r"^www\.", ""))


def html_lines(html: Column) -> Column:
    """The text of a page, one line per block element: scripts, styles, comments and tags go, common entities are resolved."""
    text = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"[\r\n\t ]+", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def _line(x: Column) -> Column:
    return F.xxhash64(F.trim(x))


def _hashes(text: Column) -> Column:
    """The different lines of a text that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _line))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int, copies: bool = True) -> DataFrame:
    """site (struct of the host), lines: the hashes of its boilerplate lines. Without ``copies``, equal texts of a host are one page."""
    site = F.struct(F.col(host_col).cast("string").alias("h")).alias("site")
    rows = pages.select(site, _hashes(F.col(text_col)).alias("lines"), *([] if copies else [F.xxhash64(text_col).alias("tkey")]))
    if not copies:
        rows = rows.dropDuplicates(["site", "tkey"])
    totals = written(rows.groupBy("site").agg(F.count(F.lit(1)).alias("pages")), "site-totals")
    # the outer form, because a plain one adds a filter that would compute the lines a second time
    each = rows.select("site", F.explode_outer("lines").alias("line")).where("line is not null").groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    each = written(each, "site-counts")
    return each.join(totals, "site").where(F.col("n") > max_ratio * F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("lines"))


def line_dedup(pages: DataFrame, host_col: str = "host", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, report: bool = True, copies: bool = True) -> DataFrame:
    """All columns of ``pages`` with the boilerplate lines taken out of the text; ``report`` adds n_lines and n_dropped.

    Without ``copies``, equal texts of a host count as one page, so that lines repeated only by whole copies stay.
    """
    own = free_name(pages.columns)
    key, drop, text = f"{own}_key", f"{own}_drop", f"{own}_text"
    found = written(boilerplate(pages, host_col, text_col, max_ratio, min_pages, copies), "site-lines").select(F.col("site").alias(f"{own}_site"), F.col("lines").alias(drop))
    joined = pages.withColumn(key, F.struct(F.col(host_col).cast("string").alias("h"))).join(found, F.col(key) == F.col(f"{own}_site"), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _line(x)))
    out = joined.withColumn(text, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    shown = [F.col(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    if not report:
        return out.select(*shown)
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n)
    dropped = F.when(F.col(drop).isNull() | F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return out.select(*shown, n_lines.alias("n_lines"), dropped.alias("n_dropped"))
