"""A stored index of the passages of each source, and the nearest passages of a claim within its source.

The index holds blocks of about a thousand passages of one source with their vectors. Claims are gathered into blocks as well, and a claims' block
meets every block of its source: a matrix product gives their cosines, of which a running list keeps the best. So a task holds two blocks and
that list, no row stands for a pair, and a source with very many passages is very many blocks, which Spark can deal over tasks. It is not
bucketed by source, because a bucket can't be split: the join deals one large source over several tasks instead.

Defined results: a vector that is null, of another length than the claim's, zero, or not finite throughout is like nothing: its cosine is 0.
(source_id, chunk_ord) is a key; chunk_ord counts from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Passages and claims of a block.
PASSAGES, CLAIMS = 1024, 256


def build_index(vectors: DataFrame, path: str) -> DataFrame:
    """Writes the index of ``vectors`` (source_id, chunk_ord, vector) to ``path`` and reads it: source_id, block, ords, vectors."""
    rows = vectors.select("source_id", F.struct(F.col("chunk_ord").cast("long").alias("o"), F.col("vector").cast("array<double>").alias("v")).alias("x"))
    blocks = rows.groupBy("source_id", F.floor(F.col("x.o") / PASSAGES).alias("block")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    blocks = blocks.select("source_id", "block", F.col("x.o").alias("ords"), F.col("x.v").alias("vectors"))
    blocks.sortWithinPartitions("source_id", "block").write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _units(vectors: pa.Array) -> list[np.ndarray | None]:
    """Each vector with length 1, or None for what is like nothing."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    size = int(offsets[1] - offsets[0]) if len(vectors) else 0
    if size and (np.diff(offsets) == size).all():  # the same, for all at once
        rows = values[offsets[0] : offsets[-1]].reshape(-1, size)
        norms = np.sqrt(np.matmul(rows[:, None, :], rows[:, :, None])[:, 0, 0])
        good = valid & np.isfinite(norms) & (norms > 0)
        rows = rows / np.where(good, norms, 1.0)[:, None]
        return [row if ok else None for row, ok in zip(rows, good.tolist(), strict=True)]
    out: list[np.ndarray | None] = []
    for i in range(len(vectors)):
        v = values[offsets[i] : offsets[i + 1]]
        norm = np.sqrt(v @ v) if valid[i] and len(v) else 0.0
        out.append(v / norm if np.isfinite(norm) and norm > 0 else None)
    return out


def _cosines(claims: list, passages: list) -> np.ndarray:
    out = np.zeros((len(claims), len(passages)))
    for size in {len(v) for v in claims if v is not None}:
        x = [i for i, v in enumerate(claims) if v is not None and len(v) == size]
        y = [i for i, v in enumerate(passages) if v is not None and len(v) == size]
        if y:
            out[np.ix_(x, y)] = np.stack([claims[i] for i in x]) @ np.stack([passages[i] for i in y]).T
    return out


def best_first(score: np.ndarray, ords: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores, the places of its ``k`` best to six decimals; of equal ones, those that come first in the source.

    Only what is as good as a row's k-th best is sorted: sorting all of it costs many times the matrix product.
    """
    falling = -np.floor(score * 1e6 + 0.5)
    if not 0 < k < score.shape[1]:
        return np.lexsort((ords, falling), axis=-1)[:, :k]
    near = falling <= np.partition(falling, k - 1, axis=1)[:, k - 1 : k]
    if near.sum() > 16 * k * len(near):  # very many ties
        return np.lexsort((ords, falling), axis=-1)[:, :k]
    rows, places = np.nonzero(near)
    order = np.lexsort((ords[near], falling[near], rows))
    first = np.cumsum(near.sum(axis=1)) - near.sum(axis=1)
    return places[order][first[:, None] + np.arange(k)]


def _search(k: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # what claims' block is at work: its key, ids, vectors, best scores and their places

        def out() -> Iterator[pa.RecordBatch]:
            (source, _), ids, _, score, ords = held
            n = score.shape[1]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), pa.array([source] * ords.size, schema.field(1).type), pa.array(ords.ravel()), pa.array(score.ravel())], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if held is None or held[0] != key:
                    if held is not None:
                        yield from out()
                    ids = batch.column(2)[i].values
                    held = (key, ids, _units(batch.column(3)[i].values), np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64))
                _, ids, claims, score, ords = held
                there = batch.column(4)[i].values.to_numpy()
                score = np.concatenate([score, _cosines(claims, _units(batch.column(5)[i].values))], axis=1)
                ords = np.concatenate([ords, np.broadcast_to(there, (len(ids), len(there)))], axis=1)
                best = best_first(score, ords, k)
                held = (key, ids, claims, np.take_along_axis(score, best, 1), np.take_along_axis(ords, best, 1))
        if held is not None:
            yield from out()

    return run


def top_in_source(claims: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """claim_id, source_id, chunk_ord, score (to six decimals), rank: the k nearest passages of the cited source alone.

    claims: claim_id, source_id, vector; they are read twice, so pass a table that is written or cheap. index: that of ``build_index``.
    """
    parts = claims.groupBy(F.col("source_id").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CLAIMS).cast("int").alias("parts"))
    dealt = claims.join(parts, F.col("source_id") == F.col("of")).select("source_id", F.pmod(F.xxhash64("claim_id"), F.col("parts")).cast("int").alias("part"), F.struct("claim_id", F.col("vector").cast("array<double>").alias("v")).alias("c"))
    blocks = dealt.groupBy("source_id", "part").agg(F.collect_list("c").alias("c")).select("source_id", "part", F.col("c.claim_id").alias("ids"), F.col("c.v").alias("v"))
    both = blocks.join(index, "source_id").select("source_id", "part", "ids", "v", "ords", "vectors")
    kinds = {f.name: f.dataType.simpleString() for f in claims.schema.fields}
    names = f"claim_id {kinds['claim_id']}, source_id {kinds['source_id']}, chunk_ord long, score double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    found = both.mapInArrow(_search(k, to_arrow_schema(_parse_datatype_string(names))), names).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc("score"), "chunk_ord"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
