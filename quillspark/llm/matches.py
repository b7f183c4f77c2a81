"""Where a pattern matches, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def places(text: Column, pattern: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in the unit that ``measure`` counts (code points).

    What lies between matches is as long as the pieces that a split leaves, so starts are running sums over both.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + measure(pair["p"])
        end = start + measure(pair["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["m"].alias("found")))).alias("out"))

    pairs = F.filter(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


NOWHERE = "array<struct<start:int,end:int,found:string>>"


def nowhere() -> Column:
    return F.array().cast(NOWHERE)
