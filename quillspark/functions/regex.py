"""Regular-expression helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<pos:int,found:string>>"


def stripped(x: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def found_at(text: Column, pattern: str, group: int = 0, opens: str = "") -> Column:
    """array<pos, found>: where each match starts (code points from 0) and its group's text, in order.

    The text is searched once. As the pattern looks at nothing outside its match, the next match is the first place of its own text after the last
    one, which is found by plain comparison. opens: what every match begins with; texts without it aren't searched.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast(PLACE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.position(x, text, acc["at"])
        part = x if group == 0 else F.regexp_extract(x, pattern, group)
        return F.struct((here + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct((here - 1).alias("pos"), part.alias("found")))).alias("out"))

    found = F.aggregate(whole, start, step, lambda acc: acc["out"])
    return F.when(F.contains(text, F.lit(opens)), found).otherwise(F.array().cast(PLACE)) if opens else found
