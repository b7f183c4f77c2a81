"""Substring dedup with suffix arrays, one for each shard.

Bytes covered by a string of ``window`` bytes that also starts elsewhere are removed. ``anchors`` says which content-defined
segments can hold such strings; where an anchor has different segments, their shard

1. sorts the suffixes by Larsson-Sadakane refinement: groups of equal prefixes are split by the groups of the suffixes that
   lie one prefix length further on, so the length doubles each round; sorted suffixes drop out;
2. finds the common prefixes of neighbours with Kasai's rule (the next suffix of a text shares at most one byte less), for all
   segments of the shard at once;
3. if the anchor was dealt over several shards, gives out one fingerprint for each different window; the shards' sorted
   runs are merged and equal ones are located by binary search.

Defined results: null and empty texts have no bytes; matches never cross rows; a repeated row counts as another place; an id is only
handed through (null too); texts below ``window`` bytes stay whole; other columns are ignored.
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

FIRST = 7  #: symbols (of 9 bits) that the first sort compares


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each suffix's place. symbols: 0 (a border) to 256.

    The order is full, beyond any window: Kasai's rule needs that.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(FIRST, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(FIRST):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    order = order.astype(np.int32)
    group = np.zeros(n + 1, np.int32)  # of each suffix: the place of its group's first, from 1; 0 beyond the end
    heads = np.ones(n, bool)
    heads[1:] = sorted_key[1:] != sorted_key[:-1]
    length = FIRST
    open_at = np.arange(n, dtype=np.int32)  # places whose suffix isn't alone in its group
    while True:
        first = np.flatnonzero(heads)
        group[order[open_at]] = open_at[first][np.cumsum(heads) - 1] + 1
        sizes = np.diff(np.append(first, len(heads)))
        several = np.repeat(sizes > 1, sizes)
        open_at = open_at[several]
        if not len(open_at):
            break
        suffix = order[open_at]
        pair = group[suffix].astype(np.int64) * (n + 2) + group[np.minimum(suffix + length, n)]
        by = np.argsort(pair)
        order[open_at] = suffix[by]
        pair = pair[by]
        heads = np.ones(len(open_at), bool)
        heads[1:] = pair[1:] != pair[:-1]
        length *= 2
    del key, sorted_key, padded
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def common_prefixes(symbols: np.ndarray, order: np.ndarray, place: np.ndarray, begins: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """By place: symbols, ``depth`` at most, that a suffix shares with the one before it; for the first ``counts`` suffixes after each of ``begins``, others 0.

    Borders (0) match nothing.
    """
    n = len(symbols)
    shared = np.zeros(n + 1, np.int16)
    known = np.zeros(len(begins), np.int64)
    padded = np.concatenate([symbols, np.zeros(depth + 1, symbols.dtype)])
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        here = begins[live] + step
        before_at = place[here] - 1
        before = order[np.maximum(before_at, 0)]
        h = np.maximum(known[live] - 1, 0)
        h[before_at < 0] = 0
        going = np.flatnonzero(before_at >= 0)
        while len(going):
            x, y = padded[here[going] + h[going]], padded[np.minimum(before[going] + h[going], n)]
            going = going[(x == y) & (x > 0) & (h[going] < depth)]
            h[going] += 1
        known[live] = h
        shared[place[here]] = h
    return shared


def _stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


FOUND = "a long, s long, lo int, hi int, f1 long, f2 long, part int"


def shard_sorter(window: int, most: int = 1 << 20):
    def run(batches):
        for rows in A.gathered(batches, most):
            raw = b"".join(r[5] for r in rows)
            sizes = np.array([len(r[5]) for r in rows])
            begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            symbols = np.zeros(int(sizes.sum()) + len(rows), np.int16)
            spots = np.ones(len(symbols), bool)
            spots[begins + sizes] = False
            symbols[spots] = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
            order, place = suffix_array(symbols)
            counts = sizes - window + 1
            shared = common_prefixes(symbols, order, place, begins, counts, window)
            alike = shared >= window
            twice = alike[place] | alike[np.minimum(place + 1, len(alike) - 1)]
            out = []
            for (a, part, parts, s, _, text), at, n in zip(rows, begins.tolist(), counts.tolist(), strict=True):
                hit = twice[at : at + n]
                out += [(a, s, lo, hi, None, None, part) for lo, hi in _stretches(hit)]
                if parts > 1:
                    for i in np.flatnonzero(~alike[place[at : at + n]]).tolist():  # the first of each different window
                        f = np.frombuffer(hashlib.blake2b(text[i : i + window], digest_size=16).digest(), np.int64).tolist()
                        out.append((a, s, i, i + 1, *f, part))
                        # the others of its run are marked already
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "s", "lo", "hi", "f1", "f2", "part"])

    return run


def in_two_shards(run: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    """A shard gives out one row for each different window, so a run of two or more rows has a window of two shards."""
    return np.bincount(run)[run] > 1


def cutter(batches):
    for batch in K.slices(batches):
        out = []
        marks = batch.column(batch.schema.get_field_index("marks")).to_pylist()
        for doc, text, ranges in zip(batch.column(0).to_pylist(), K.texts(batch), marks, strict=True):
            kept = text.as_buffer().to_pybytes()
            n, gone, lo = len(kept), 0, ()
            if ranges:
                lo, hi = K.union_length(np.array([r["lo"] for r in ranges]), np.array([r["hi"] for r in ranges]))
                gone = int((hi - lo).sum())
                cuts = [0, *np.stack([lo, hi], 1).ravel().tolist(), n]
                kept = b"".join(kept[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
            out.append((doc, n, gone, len(lo), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _without_bytes(batches):
    for batch in cutter(batches):
        yield batch.select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, k: int = 160, shard_segments: int = A.SHARD_SEGMENTS, with_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay; cuts may part a code point)."""
    docs = A.keyed(docs, id_col, text_col)
    segments = A.recurring(docs, "byte", k, window, "sa")
    first = F.min(F.struct("doc_id", "tkey", "at")).alias("m")
    kinds = A.with_shards(segments.groupBy("a", "s").agg(F.count(F.lit(1)).alias("times"), first).select("a", "s", "times", "m.*"), shard_segments, "sa")
    content = A.contents(docs, kinds.where("kinds > 1"), "byte", window).repartition("a", "part").sortWithinPartitions("a", "part", "s")
    ranked = content.mapInArrow(K.trimmed(shard_sorter(window)), FOUND)
    runs = A.merged(ranked, "part", A.settled(in_two_shards))
    per_kind = runs.groupBy("a", "s").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    # a segment that stands once has the runs found; one that stands twice is covered as a whole
    whole = F.array(F.struct(F.lit(0).alias("lo"), A.count().cast("int").alias("hi")))
    kinds = kinds.join(per_kind, ["a", "s"], "left").select("a", "s", F.when(F.col("times") > 1, whole).otherwise(F.col("runs")).alias("runs"))
    kinds = written(kinds.where("runs is not null"), "sa-runs")
    placed = segments.join(kinds, ["a", "s"]).select("doc_id", "tkey", "at", F.explode("runs").alias("r"))
    marks = placed.select("doc_id", "tkey", (A.lo() + F.col("r.lo")).alias("lo"), (A.lo() + F.col("r.hi") + F.lit(window - 1)).alias("hi"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = A.attach(docs, marks)
    return joined.mapInArrow(K.trimmed(cutter), schema + ", kept binary") if with_bytes else joined.mapInArrow(K.trimmed(_without_bytes), schema)
