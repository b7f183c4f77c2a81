"""What a reviewer is shown: passages as flowing text, reference lines, colours, neighbours among passages, and lists in the reader's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import audit

# Highlight colours by displayed verdict (red, green, blue from 0 to 1); others have none, and the viewer takes its own.
COLOURS = {"supported": (0.40, 0.80, 0.45), "partially": (1.00, 0.86, 0.30), "overstated": (1.00, 0.62, 0.25), "unsupported": (1.00, 0.45, 0.45)}
#: White space as a reader sees it, written alike for Java and RE2.
GAP = r"[\s\x0B\p{Z}\x{FEFF}]+"
#: Orders by the letters of all scripts, and compares without case.
BY_LETTERS, ANY_CASE = "UNICODE", "UTF8_LCASE"


def flowing(snippet: Column) -> Column:
    """A passage without its page's line ends. A word parted at a hyphen is joined again, hyphen kept; null is empty."""
    joined = F.regexp_replace(F.coalesce(snippet, F.lit("")), f"([A-Za-z])-{GAP}([A-Za-z])", "$1-$2")
    return F.trim(F.regexp_replace(joined, GAP, " "))


def colour(status: Column) -> Column:
    """array<double> of red, green, blue, or null."""
    out = F.lit(None).cast("array<double>")
    for name, rgb in COLOURS.items():
        out = F.when(status == name, F.array(*map(F.lit, rgb))).otherwise(out)
    return out


def reference_line(title: Column, raw: Column, authors: Column, year: Column) -> Column:
    """struct<title, line>: a reference's title, or else its raw text; its first author, with others not named, and its year."""
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit(""))
    named = F.when(F.size(authors) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    dated = F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), F.nullif(raw, F.lit("")), F.lit("—")).alias("title"), F.concat(named, dated).alias("line"))


def passage_neighbours(shown: Column, passages: Column) -> Column:
    """struct<previous, following>: the places to go to from the passage shown, staying at the ends; with one passage or none, there is nowhere to go."""
    last = F.size(passages) - 1
    moved = lambda d: F.when(last < 1, shown).otherwise(F.greatest(F.lit(0), F.least(shown + d, last)))
    return F.struct(moved(-1).alias("previous"), moved(1).alias("following"))


def in_reading_order(checks: DataFrame, group: str, text: str) -> DataFrame:
    """Adds ``place``: problems first and then by the letters of ``text``, as readers order them, accents and capitals next to their letters; ties by check_id."""
    order = W.partitionBy(group).orderBy(audit.rank(F.col("status")), F.collate(F.col(text), BY_LETTERS), "check_id")
    return checks.withColumn("place", F.row_number().over(order).cast("long"))


def holding(checks: DataFrame, text: str, wanted: str) -> DataFrame:
    """Checks whose ``text`` holds what is wanted, in capitals or not, in any script."""
    return checks.where(F.contains(F.collate(F.col(text), ANY_CASE), F.collate(F.lit(wanted), ANY_CASE)))
