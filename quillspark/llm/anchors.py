"""Plan that the two substring operators share: content-defined segments, and which of them need a closer look.

A window (so many bytes or words) belongs to the smallest k-gram in it, its anchor. Windows in a row with one anchor form a
segment. Equal windows have equal anchors, so a window that occurs twice has both its occurrences in segments of one anchor.
That leaves three cases, told apart by counts that are combined before they are shuffled:

* the anchor occurs once: nothing in its segment occurs elsewhere;
* a whole segment occurs again: all its windows do, no text is compared;
* an anchor has different segments: one copy of each goes to the anchor's shard, where the operator's own method compares them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import discard, written

#: Of each segment: its row (doc_id, and the hash of its text), the anchor's hash, a digest of the segment, and the first window
#: and number of windows in one number.
SEGMENTS = "doc_id long, tkey long, a long, s long, at long"
COUNT_BITS = 9
MOST_WINDOWS = (1 << COUNT_BITS) - 1
#: Different segments that one shard of an anchor takes; more are dealt over several shards, which are then merged.
SHARD_SEGMENTS = 4096
#: Items (bytes or words) of a row that are handled at once.
STRETCH = 1 << 21


def lo(at: str = "at") -> Column:
    return F.expr(f"shiftrightunsigned({at}, {COUNT_BITS})")


def count(at: str = "at") -> Column:
    return F.expr(f"{at} & {MOST_WINDOWS}L")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (0 for null), no_id, tkey, text. tkey, 64 bits of the text, tells apart rows that share an id, and rows without one; rows with equal id and text are alike in all results."""
    text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    tkey = F.when(doc.isNull(), F.xxhash64(text, F.lit("no id"))).otherwise(F.xxhash64(text))
    return docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("no_id"), tkey.alias("tkey"), text.alias("text"))


def runs_of(column: pa.Array, unit: str, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Items, offsets, row numbers and first item of stretches short enough for one pass; a long row comes in pieces that overlap by a window less one."""
    data, offsets = K.buffer(column)
    if unit == "word":
        starts, stops, row = K.spans(data, offsets)
        items = K.hashes(data, starts, stops)
        offsets = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int64)
    else:
        items = data
    if len(items) <= STRETCH:
        yield items, offsets, np.arange(len(column)), 0
        return
    for r in range(len(column)):
        begin, end = int(offsets[r]), int(offsets[r + 1])
        for at in range(begin, max(begin + 1, end - window + 1), STRETCH):
            part = items[at : min(end, at + STRETCH + window - 1)]
            yield part, np.array([0, len(part)]), np.array([r]), at - begin


def segment_rows(unit: str, k: int, window: int) -> Callable:
    assert window - k + 1 <= MOST_WINDOWS

    def run(batches):
        for batch in K.slices(batches):
            column = K.texts(batch)
            keys = batch.column(1)
            for items, offsets, rows, base in runs_of(column, unit, window):
                row, start, n, gram = K.segments(K.BYTES[items] if unit == "byte" else items, offsets, k, window)
                if not len(row):
                    continue
                digest = K.digests(items, start, start + n + window - 1)
                at = ((start - offsets[row] + base) << COUNT_BITS) | n
                own = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), keys.take(own), pa.array(gram.view(np.int64)), pa.array(digest), pa.array(at)], names=["doc_id", "tkey", "a", "s", "at"])

    return run


def recurring(docs: DataFrame, unit: str, k: int, window: int, label: str) -> DataFrame:
    """SEGMENTS of the anchors that occur more than once.

    Counts are combined before they are shuffled, and written: a join of two plain tables is one whose large partitions Spark can
    split, so an anchor that a third of all rows have doesn't end in one task. The same holds for the joins further on.
    """
    found = written(docs.select("doc_id", "tkey", "text").mapInArrow(K.trimmed(segment_rows(unit, k, window)), SEGMENTS), f"{label}-segments")
    again = written(found.groupBy("a").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a"), f"{label}-again")
    out = written(found.join(again, "a").select("doc_id", "tkey", "a", "s", "at"), f"{label}-recurring")
    discard(found)
    discard(again)
    return out


def with_shards(kinds: DataFrame, shard_segments: int, label: str) -> DataFrame:
    """Adds ``kinds`` (different segments of the anchor), ``parts`` (its shards) and ``part`` to one row for each anchor and segment."""
    kinds = written(kinds, f"{label}-kinds")
    per_anchor = written(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), f"{label}-anchors")
    parts = F.ceil(F.col("kinds") / shard_segments).cast("int")
    dealt = kinds.join(per_anchor, "a", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))).withColumn("parts", parts)
    return written(dealt.withColumn("part", F.pmod(F.col("s"), F.col("parts")).cast("int")), f"{label}-dealt")


def cut_out(unit: str, window: int) -> Callable:
    """From rows (text, wanted) to a row for each wanted segment, with its bytes (words: parted by a space)."""
    schema = pa.schema([("a", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("s", pa.int64()), ("first", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:  # texts with their wanted stretches
            wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist()
            for text, asked in zip(K.texts(batch), wanted, strict=True):
                raw = text.as_buffer().to_pybytes()
                if unit == "word":
                    words = raw.split()
                    content = [b" ".join(words[w["lo"] : w["lo"] + w["n"] + window - 1]) for w in asked]
                else:
                    content = [raw[w["lo"] : w["lo"] + w["n"] + window - 1] for w in asked]
                yield pa.RecordBatch.from_pydict({x: [w[x] for w in asked] for x in ("a", "part", "parts", "s", "first")} | {"content": content}, schema=schema)

    return run


CONTENT = "a long, part int, parts int, s long, first long, content binary"


def contents(docs: DataFrame, kinds: DataFrame, unit: str, window: int) -> DataFrame:
    """One copy of each segment in ``kinds`` (a, part, parts, s, doc_id, tkey, at), read from its document."""
    wanted = kinds.select(F.col("doc_id").alias("r_id"), F.col("tkey").alias("r_key"), F.struct("a", "part", "parts", "s", F.col("doc_id").alias("first"), lo().alias("lo"), count().alias("n")).alias("w")).groupBy("r_id", "r_key").agg(F.collect_list("w").alias("wanted"))
    # rows with equal id and text give the same content twice; the shard drops repeats
    return docs.join(wanted, (docs.doc_id == wanted.r_id) & (docs.tkey == wanted.r_key)).select("text", "wanted").mapInArrow(K.trimmed(cut_out(unit, window)), CONTENT)


def gathered(batches, most: int) -> Iterator[list[tuple]]:
    """Rows sorted by shard and segment, in lists that hold whole shards and, but for a larger shard, about ``most`` bytes of content."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:4] == held[-1][:4]:
                continue
            if held and size > most and row[:2] != held[-1][:2]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
    if held:
        yield held


def attach(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, marks: array of (lo, hi) or null. marks: doc_id, tkey, lo, hi."""
    per_doc = marks.groupBy(F.col("doc_id").alias("r_id"), F.col("tkey").alias("r_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    joined = docs.join(per_doc, (docs.doc_id == per_doc.r_id) & (docs.tkey == per_doc.r_key), "left")
    return joined.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "marks")


def merged(ranked: DataFrame, tail: str, run: Callable) -> DataFrame:
    """Rows of shards, those with a window's fingerprint (f1, f2) brought together and in order, for ``run`` to settle; others pass."""
    place = F.coalesce("f1", F.xxhash64("a", "s"))
    return ranked.repartition(place).sortWithinPartitions("f1", "f2", tail).mapInArrow(K.trimmed(run), "a long, s long, lo int, hi int")


def settled(judge: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> Callable:
    """Runs over rows sorted by (f1, f2). judge gets, for rows that have a fingerprint, the number of each row's run and the rows; it says which stay."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        f1 = batch.column(batch.schema.get_field_index("f1"))
        free = f1.null_count
        stay = np.ones(batch.num_rows, bool)
        if free < batch.num_rows:
            own = batch.slice(free)
            x, y = (own.column(own.schema.get_field_index(f)).to_numpy() for f in ("f1", "f2"))
            # the runs' first rows, by binary search in the sorted fingerprints; equal first halves are rare, so their second ones are compared
            head = np.searchsorted(x, x, "left")
            fresh = (head == np.arange(len(x))) | np.append(True, y[1:] != y[:-1])
            stay[free:] = judge(np.cumsum(fresh) - 1, own)
        return batch.filter(pa.array(stay)).select(["a", "s", "lo", "hi"])

    def run(batches):
        pending = None
        for batch in batches:
            pending = batch if pending is None else pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
            f1 = pending.column(pending.schema.get_field_index("f1"))
            last = f1[len(f1) - 1].as_py()
            cut = pending.num_rows if last is None else f1.null_count + int(np.searchsorted(f1.slice(f1.null_count).to_numpy(), last, "left"))
            yield keep(pending.slice(0, cut))
            pending = pending.slice(cut) if cut < pending.num_rows else None
        if pending is not None:
            yield keep(pending)

    return run
