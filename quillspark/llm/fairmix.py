"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and queue up, as often over as the mix may repeat them. A document's
virtual finish time is the source's words so far, its own included, over the source's target, so that every source reaches its
target at time 1. The mix is all queues in order of that time, cut where the words reach the total budget.

No queue is sorted in one task. A source's words before a document are the words of earlier shuffle buckets (summed per bucket,
whose number doesn't depend on the data) and of earlier documents in its bucket; the cut is found from sums over time slices, then over
slices of the one slice where the budget runs out. Only DataFrame functions are used.

Defined results: null text has no words; null sources are one source, the last; a row with a null id is shuffled by its text; rows with equal id and size
are interchangeable, and each counts; sources without words have target 0; names of other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import free_name, written

#: Weights of the sources in order, repeating; and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
#: Shuffle buckets of a source, and slices of the time axis at each of its two levels.
BUCKETS = 4096
SLICES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled(doc: Column, body: Column, seed: str) -> Column:
    """48 bits of a digest of the id (without one: of the text, so that such rows are spread too); the same in any engine that has MD5."""
    text = F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc.cast("string"), F.concat(F.lit("~"), F.coalesce(body.cast("string"), F.lit("")))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target. Shares by weight, held to ``most_times`` the source's words; what is over is shared by weight again.

    The end of that sharing in closed form: sources in order of limit over weight; one is held if an even share of what those
    before it leave, per weight, is at least that. One row per source goes through one task here, none per document.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everything) - 1) % len(weights) + 1)
    s = sources.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(most_times))).withColumn("r", F.col("most") / F.col("w"))
    before = W.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("held", F.col("level") >= F.col("r"))
    level = F.max(F.when(~F.col("held"), F.col("level"))).over(whole)
    return s.select("source", "source_size", F.when(F.col("held"), F.col("most")).otherwise(level * F.col("w")).alias("target"))


def _before(df: DataFrame, keys: list[str], order: list[Column], value: str, bucket: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of the same keys that come earlier; order starts with the bucket's order."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__s"))
    sums = sums.withColumn("__b", F.coalesce(F.sum("__s").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__i", inside).join(sums, [*keys, bucket]).withColumn(name, F.col("__b") + F.col("__i")).drop("__b", "__i")


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, tkey (a hash of its text), source, size, source_size, target and taken (words, repeats counted).

    row_col names a column that is returned as ``row``, by which the caller knows the rows again.
    """
    doc, row = F.col(id_col).cast("long"), ["row"] if row_col else []
    sized = docs.select(*[F.col(row_col).alias(r) for r in row], doc.alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tkey"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), shuffled(doc, F.col(text_col), seed).alias("turn"))
    sized = sized.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")))  # null has a key too, the last
    sized = written(sized, "mix-sizes")  # ids and sizes are needed three times, texts once
    per_source = sized.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, most_times).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("src"), "source_size", "target")
    bucket = F.shiftright("turn", 36).cast("int")  # the upper 12 of 48 bits
    queued = _before(sized.withColumn("bucket", bucket), ["src"], [F.col("turn"), F.col("doc_id"), F.col("size"), F.col("tkey")], "size", "bucket", "so_far")
    timed = queued.join(goal, "src").withColumn("end", F.col("so_far") + F.col("size"))
    times = F.transform(F.sequence(F.lit(0), F.lit(most_times - 1)), lambda e: (e * F.col("source_size") + F.col("end")) / F.col("target"))
    timed = timed.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(F.array().cast("array<double>")))
    timed = written(timed.select(*row, "doc_id", "tkey", "source", "size", "source_size", "target", "times"), "mix-timed")
    cut = F.lit(_cut(timed))
    taken = F.size(F.filter("times", lambda t: t <= cut)) * F.col("size")
    return timed.select(*row, "doc_id", "tkey", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _cut(timed: DataFrame) -> float:
    """The latest time at which the words so far are within the budget (the sum of all sizes).

    Sums over at most SLICES + 1 slices are run through in order, first of the whole axis, then of the slice that passes the
    budget, and last of the single times in a slice of that slice; a few numbers come back each time.
    """
    shots = timed.select("size", F.explode("times").alias("t"))
    budget = timed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    base = 0

    def passing(rows: DataFrame, key: Column) -> tuple | None:
        sums = rows.groupBy(key.alias("k")).agg(F.sum("size").alias("w"))
        run = sums.withColumn("end", F.sum("w").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) + F.lit(base))
        return run.where(F.col("end") > budget).orderBy("k").select("k", F.col("end") - F.col("w")).first()

    for scale in (SLICES, SLICES * SLICES):
        # time 0 to 2 in even slices; what is later is in the last one
        slot = F.least(F.floor(F.col("t") * F.lit(scale / 2)), F.lit(scale)).cast("long")
        found = passing(shots, slot)
        if found is None:
            return float("inf")
        shots, base = shots.where(slot == found[0]), found[1]
    found = passing(shots, F.col("t"))
    before = shots.where(F.col("t") < found[0]).agg(F.max("t")).first()[0]
    # none of the slice fits: the cut lies just before its first time
    return before if before is not None else math.nextafter(found[0], 0.0)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows are written with a number first: of rows alike in id, text and source, one may be taken more often than another.
    """
    own = free_name(docs.columns)
    numbered = written(docs.withColumn(f"{own}_row", F.monotonically_increasing_id()), "mix-rows")
    found = fair_mix(numbered, id_col, text_col, source_col, weights, most_times, seed, f"{own}_row").where("taken > 0")
    times = found.select(F.col("row").alias(f"{own}_known"), (F.col("taken") / F.col("size")).cast("int").alias(f"{own}_times"))
    taken = numbered.join(times, F.col(f"{own}_row") == F.col(f"{own}_known"))
    turns = F.explode(F.sequence(F.lit(1), F.col(f"{own}_times"))).alias(f"{own}_turn")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], turns).drop(f"{own}_turn")
