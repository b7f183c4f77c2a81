"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against reference blocks of documents with smaller ids. The blocks are content-defined segments
(``anchors``): a block that recurs whole is one factor, found by its digest. Where blocks of one anchor differ, the anchor's shard
parses each greedily against the indexed windows of all earlier ones: the longest match at the cursor becomes a factor, and the
windows that straddle its end are checked one by one before the next factor begins. Factors of ``window`` words or more are
duplicate spans. An anchor with very many different blocks is split over shards, which exchange the smallest document of each
window, so that no task holds an unbounded group.

Defined results: null text has no words; a row with null id neither refers nor loses words; rows with equal ids are one document
(nothing in one is removed for another); documents below ``window`` words stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import textkit as K
from .scratch import written

FOUND = "a long, s long, lo int, hi int, f1 long, f2 long, first long"


def parse(block: np.ndarray, own: np.ndarray, doc: int, index: dict, docs: dict, ends: dict, words: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Factors of one block, as ranges of window starts. index: window hash to its first place in ``words``; docs, ends: that place's document and where its block ends."""
    factors, i, n = [], 0, len(own)
    while i < n:
        ref = index.get(own[i])
        if ref is None or docs[ref] >= doc:
            i += 1
            continue
        room = min(n - i + window - 1, ends[ref] - ref)  # blocks lie end to end: what runs on into the next one is no text
        same = block[i : i + room] == words[ref : ref + room]
        length = room if same.all() else int(np.argmin(same))
        if length < window:
            i += 1
            continue
        factors.append((i, i + length - window + 1))
        i += length - window + 1  # the first window that crosses the factor's end
    return factors


def hashed(contents: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Word hashes of all contents end to end, and how many each has."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in contents])])
    starts, stops, row = K.spans(data, offsets)
    return K.hashes(data, starts, stops), np.bincount(row, minlength=len(contents)).tolist()


def shard_parser(window: int, most: int = 8 << 20):
    def run(batches):
        for rows in A.gathered(batches, most):
            out: list[tuple] = []
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][:2] == rows[at][:2]:
                    end += 1
                group = sorted(rows[at:end], key=lambda r: (r[4], r[3]))
                at = end
                words, sizes = hashed([r[5] for r in group])
                gram = K.grams(words, window).tolist()
                place = 0
                index: dict[int, int] = {}
                docs: dict[int, int] = {}
                ends: dict[int, int] = {}
                for (a, _, parts, s, doc, _), n in zip(group, sizes, strict=True):
                    block, own = words[place : place + n], gram[place : place + n - window + 1]
                    done = parse(block, own, doc, index, docs, ends, words, window)
                    out += [(a, s, lo, hi, None, None, doc) for lo, hi in done]
                    hit = {i for lo, hi in done for i in range(lo, hi)} if parts > 1 else ()
                    for i, g in enumerate(own):
                        if g not in index:
                            index[g] = place + i
                            docs[place + i] = doc
                            ends[place + i] = place + n
                        if parts > 1 and i not in hit:
                            f1, f2 = np.frombuffer(hashlib.blake2b(block[i : i + window].tobytes(), digest_size=16).digest(), np.int64).tolist()
                            out.append((a, s, i, i + 1, f1, f2, doc))
                    place += n
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["a", "s", "lo", "hi", "f1", "f2", "first"])

    return run


def after_the_first(run: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    """Rows of a run are in order of their document; those of a later document than its first have the window again."""
    first = rows.column(rows.schema.get_field_index("first")).to_numpy()
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, first)
    return first > least[run]


def cutter(batches):
    """Counts and digest of what stays of each document."""
    for batch in K.slices(batches):
        out = []
        marks = batch.column(batch.schema.get_field_index("marks")).to_pylist()
        for doc, text, ranges in zip(batch.column(0).to_pylist(), K.texts(batch), marks, strict=True):
            words = text.as_buffer().to_pybytes().split()
            gone, n = 0, len(words)
            if ranges:
                lo, hi = K.union_length(np.array([r["lo"] for r in ranges]), np.array([r["hi"] for r in ranges]))
                keep = np.ones(n, bool)
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    keep[x:y] = False
                gone = n - int(keep.sum())
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            kept = b" ".join(words)
            out.append((doc, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _without_text(batches):
    for batch in cutter(batches):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 16, shard_segments: int = A.SHARD_SEGMENTS, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (words joined by a space)."""
    docs = A.keyed(docs, id_col, text_col)
    segments = A.recurring(docs.where("not no_id"), "word", k, window, "lz")
    first = F.min(F.struct("doc_id", "tkey", "at")).alias("m")
    kinds = A.with_shards(segments.groupBy("a", "s").agg(first).select("a", "s", "m.*"), shard_segments, "lz")
    content = A.contents(docs, kinds.where("kinds > 1"), "word", window).repartition("a", "part").sortWithinPartitions("a", "part", "s")
    parsed = content.mapInArrow(K.trimmed(shard_parser(window)), FOUND)
    # blocks of one anchor that lie in different shards: the smallest document of each window, wherever it is
    factors = A.merged(parsed, "first", A.settled(after_the_first))
    per_block = factors.groupBy("a", "s").agg(F.collect_list(F.struct("lo", "hi")).alias("factors"))
    # the smallest document of a block has the factors found; in later ones the block is a factor as a whole
    blocks = written(kinds.select("a", "s", F.col("doc_id").alias("first")).join(per_block, ["a", "s"], "left"), "lz-factors")
    whole = F.array(F.struct(F.lit(0).alias("lo"), A.count().cast("int").alias("hi")))
    placed = segments.join(blocks, ["a", "s"]).select("doc_id", "tkey", "at", F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("factors"))).alias("f"))
    marks = placed.select("doc_id", "tkey", (A.lo() + F.col("f.lo")).alias("lo"), (A.lo() + F.col("f.hi") + F.lit(window - 1)).alias("hi"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    joined = A.attach(docs, marks)
    return joined.mapInArrow(K.trimmed(cutter), schema + ", kept_text string") if with_text else joined.mapInArrow(K.trimmed(_without_text), schema)
