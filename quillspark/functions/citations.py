"""In-text citation markers, sentences and bibliography blocks as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import found_at, stripped

# What counts as a marker, a sentence end, a heading, a margin number, an entry's number and a year.
NUMERIC = r"\[\s*(\d+(?:\s*[–-]\s*\d+)?(?:\s*,\s*\d+(?:\s*[–-]\s*\d+)?)*)\s*\]"
AUTHOR_YEAR = r"\(([^()]*\b(?:19|20)\d{2}[a-z]?[^()]*)\)"
SURNAME_YEAR = r"([A-Z][A-Za-z'’\-]+).*?\b((?:19|20)\d{2})[a-z]?"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[\"'(\[A-Z])"
REFERENCES_HEADING = r"(?im)^\s*(?:references|bibliography|works cited|literature cited)\s*:?\s*$"
MARGIN_NUMBER = r"^\s*\d{1,4}\s*$"
ENTRY_NUMBER = r"^\s*(?:\[\s*(\d+)\s*\]|\(\s*(\d+)\s*\)|(\d+)[.)])\s+"
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
#: How many numbers a range may span, and the least share of ascending numbers of a numbered list of so many lines.
MOST_IN_RANGE, NUMBERED_SHARE, NUMBERED_LINES = 100, 0.7, 3

KEYS = "array<string>"


def strip_line_numbers(text: Column) -> Column:
    """Without the lines that are only a number of one to four digits."""
    return F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: ~line.rlike(MARGIN_NUMBER)), "\n")


def split_sentences(text: Column) -> Column:
    flat = stripped(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.transform(F.split(flat, SENTENCE_GAP), lambda s: F.trim(s)), lambda s: s != "")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def numeric_keys(inside: Column) -> Column:
    """Keys of the inside of one numeric marker; ranges too wide or reversed give none."""

    def spread(ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        fits = (b >= a) & (b - a < MOST_IN_RANGE)
        return F.coalesce(F.when(fits, F.transform(F.sequence(a, F.when(fits, b).otherwise(a)), lambda x: x.cast("string"))), F.array().cast(KEYS))

    def one(p: Column) -> Column:
        a, b = (F.regexp_extract(p, r"^(\d+)\s*[–-]\s*(\d+)$", g).try_cast("long") for g in (1, 2))
        return F.when(p.rlike(r"^\d+$"), F.array(p)).otherwise(_once(F.struct(a.alias("a"), b.alias("b")), spread))

    return F.flatten(F.transform(F.transform(F.split(inside, ","), stripped), one))


def author_year_keys(inside: Column) -> Column:
    """"Surname YYYY" for each part of one parenthesis that has both."""
    keyed = F.transform(F.split(inside, ";"), lambda p: F.concat_ws(" ", F.regexp_extract(p, SURNAME_YEAR, 1), F.regexp_extract(p, SURNAME_YEAR, 2)))
    return F.filter(keyed, lambda k: F.trim(k) != "")


def numeric_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1)), numeric_keys)


def author_year_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(AUTHOR_YEAR), F.lit(1)), author_year_keys)


def find_markers(text: Column) -> Column:
    """array<pos, keys> of all markers that give keys, in order. Both kinds are looked for apart, so one may lie within the other."""
    by_number = F.transform(found_at(text, NUMERIC, 1, "["), lambda m: F.struct(m["pos"].alias("pos"), numeric_keys(m["found"]).alias("keys")))
    by_author = F.transform(found_at(text, AUTHOR_YEAR, 1, "("), lambda m: F.struct(m["pos"].alias("pos"), author_year_keys(m["found"]).alias("keys")))
    return F.array_sort(F.filter(F.concat(by_number, by_author), lambda m: F.size(m["keys"]) > 0))


def has_marker(text: Column) -> Column:
    return F.size(find_markers(text)) > 0


def strip_markers(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, NUMERIC, ""), AUTHOR_YEAR, "")
    return stripped(F.regexp_replace(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"), r"\s+", " "))


def before_references(text: Column) -> Column:
    """What stands before the first heading of a reference list."""
    return F.element_at(F.split(text, REFERENCES_HEADING, 2), 1)


def references_block(text: Column) -> Column:
    """What stands after the last such heading; empty without one."""
    parts = F.split(text, REFERENCES_HEADING, -1)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def page_of_name(name: Column) -> Column:
    return F.regexp_extract(name, r"pages?\s+(\d+)", 1).try_cast("int")


def entry_number(line: Column) -> Column:
    """The number that opens a bibliography line, or null."""
    # all that a match holds but its number is brackets, stops and spaces
    return F.regexp_replace(F.regexp_extract(line, ENTRY_NUMBER, 0), r"\D", "").try_cast("long")


def blank(x: Column) -> Column:
    return stripped(x) == ""


def looks_numbered(lines: Column) -> Column:
    """Whether enough lines open with numbers, and enough of those ascend."""

    def ascend(numbers: Column) -> Column:
        pairs = F.size(numbers) - 1
        rises = F.size(F.filter(F.zip_with(F.slice(numbers, F.lit(1), pairs), F.slice(numbers, F.lit(2), pairs), lambda a, b: b > a), lambda up: up))
        return F.when(F.size(numbers) < NUMBERED_LINES, F.lit(False)).otherwise(rises >= NUMBERED_SHARE * pairs)

    return _once(F.filter(F.transform(lines, entry_number), lambda n: n.isNotNull()), ascend)


def entries_by_marker(lines: Column) -> Column:
    """Lines joined into entries. A line opens one if its number follows the last accepted one (the first number is free)."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(KEYS).alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, numbered: Column) -> Column:
        line, n = numbered["line"], numbered["n"]
        opens = n.isNotNull() & (acc["last"].isNull() | (n == acc["last"] + 1))
        closes = opens & acc["open"].isNotNull()
        return F.struct(
            F.when(opens, n).otherwise(acc["last"]).alias("last"),
            F.when(closes, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(opens | acc["open"].isNull(), line).otherwise(F.concat_ws("\n", acc["open"], line)).alias("open"),
        )

    numbered = F.transform(lines, lambda x: F.struct(x.alias("line"), entry_number(x).alias("n")))
    whole = F.aggregate(numbered, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.filter(whole, lambda e: ~blank(e))


def entries_by_blank_line(block: Column) -> Column:
    """Parts between blank lines; a part without a year goes to the one before it. Null if there is only one part."""
    parts = F.filter(F.split(block, r"\n\s*\n"), lambda p: ~blank(p))
    start = F.array().cast(KEYS)

    def step(acc: Column, part: Column) -> Column:
        n = F.size(acc)
        glued = F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit("\n\n"), part)))
        return F.when((n > 0) & ~part.rlike(YEAR), glued).otherwise(F.concat(acc, F.array(part)))

    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step))


def split_entries(block: Column) -> Column:
    lines = F.split(block, "\n")
    solid = F.filter(lines, lambda x: ~blank(x))
    return F.when(F.size(solid) == 0, F.array().cast(KEYS)).when(looks_numbered(solid), entries_by_marker(lines)).otherwise(F.coalesce(entries_by_blank_line(block), solid))


def pack_chunks(block: Column, budget: int = 6000) -> Column:
    """Entries packed in order into chunks of at most ``budget`` characters; a larger entry stands alone."""
    start = F.struct(F.array().cast(KEYS).alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, entry: Column) -> Column:
        size = F.length(entry) + 1
        full = acc["open"].isNotNull() & (acc["size"] + size > budget)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), entry).otherwise(F.concat_ws("\n", acc["open"], entry)).alias("open"),
            F.when(full, size).otherwise(acc["size"] + size).alias("size"),
        )

    packed = F.aggregate(split_entries(block), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    whole = F.array(F.regexp_replace(block, r"^\n+|\n+$", ""))
    return F.when(blank(block), F.array().cast(KEYS)).when(F.length(block) <= budget, whole).otherwise(packed)
