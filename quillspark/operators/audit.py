"""The reviewer's side: overrides, displayed status, queues, order, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Statuses with the problems first, what a reviewer may set, which are problems; and the order of acquisition results.
ORDER = ("unsupported", "overstated", "not_found", "partially", "supported", "ambiguous", "no_pdf", "unresolved_marker", "unreadable_source", "not_a_claim", "unchecked")
OVERRIDES = ("supported", "partially", "overstated", "unsupported", "not_found", "not_a_claim", "unchecked")
PROBLEMS = ("unsupported", "overstated", "not_found", "partially")
ACQUISITION_ORDER = ("error", "not_found", "paywalled", "fetched", "already_present")
UNKNOWN = 99


def rank(status: Column, order: tuple[str, ...] = ORDER, unknown: int = UNKNOWN) -> Column:
    table = F.create_map(*[F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(status, F.lit(""))), F.lit(unknown))


def display_status(override: Column, verdict: Column, resolution: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.nullif(verdict, F.lit("unchecked")), resolution)


def fold_overrides(events: DataFrame) -> DataFrame:
    """check_id, human_override, reviewed, note after all events in order of seq.

    events: check_id, seq, verdict, clear, reviewed, note. Clearing wins over a verdict in the same event and leaves the review mark; a verdict
    marks as reviewed; a given mark counts last; the note is replaced each time. An unknown verdict makes the event void.
    """
    valid = F.coalesce("clear", F.lit(False)) | F.col("verdict").isNull() | F.col("verdict").isin(*OVERRIDES)
    e = events.where(valid).withColumn("clear", F.coalesce("clear", F.lit(False)))
    sets = ~F.col("clear") & F.col("verdict").isNotNull()
    mark = F.coalesce("reviewed", F.when(sets, F.lit(True)))
    folded = e.groupBy("check_id").agg(
        F.max_by(F.when(sets, F.col("verdict")), F.when(F.col("clear") | sets, F.col("seq"))).alias("human_override"),
        F.max_by(mark, F.when(mark.isNotNull(), F.col("seq"))).alias("reviewed"),
        F.max_by(F.coalesce("note", F.lit("")), F.col("seq")).alias("note"),
    )
    return folded.withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def queue(checks: DataFrame, preset: str = "all", statuses: tuple[str, ...] = (), section: str | None = None, text: str = "") -> DataFrame:
    """Checks that pass all given filters. checks: status, reviewed, section, claim, ref_key, title."""
    keep = F.lit(True)
    if preset == "problems":
        keep = keep & F.col("status").isin(*PROBLEMS)
    elif preset == "unreviewed":
        keep = keep & ~F.col("reviewed")
    if statuses:
        keep = keep & F.col("status").isin(*statuses)
    if section:
        keep = keep & (F.col("section") == section)
    if text:
        keep = keep & F.contains(F.lower(F.concat_ws(" ", "claim", "ref_key", "title")), F.lit(text.lower()))
    return checks.where(keep)


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank(F.col("status")))


def coverage(checks: DataFrame) -> DataFrame:
    """bucket, n: every check in exactly one bucket."""
    return checks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(W.partitionBy())
    return counts.withColumn("share", F.round(100 * F.col("n") / total, 2)).withColumn("rank", rank(F.col("bucket")))


def progress(checks: DataFrame) -> DataFrame:
    done, n = F.count_if("reviewed"), F.count(F.lit(1))
    return checks.agg(done.alias("reviewed"), n.alias("total"), F.when(n > 0, F.round(100 * done / n)).otherwise(0).cast("long").alias("percent"))


def neighbours(checks: DataFrame, group: str, order: str) -> DataFrame:
    """Adds previous and following (staying at the ends), and next_unreviewed, looked for from here on and then from the start."""
    w = W.partitionBy(group).orderBy(order)
    open_ = F.when(~F.col("reviewed"), F.col("check_id"))
    ahead = F.first(open_, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    around = F.first(open_, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return checks.withColumns({"previous": F.coalesce(F.lag("check_id").over(w), "check_id"), "following": F.coalesce(F.lead("check_id").over(w), "check_id"), "next_unreviewed": F.coalesce(ahead, around)})
