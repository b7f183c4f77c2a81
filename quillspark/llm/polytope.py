"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the axis that it then lies nearest to, with its sign,
is its hash: one of twice as many as there are dimensions. Several turns together make a bucket's name, and there are ``TABLES`` such
tables. As many turns are used as keep the buckets of the largest group of random vectors near ``BUCKET``, so the work grows with the
input. A vector lies in one bucket of each table and looks into the next likeliest ``PROBES`` as well: those whose axes come near to the
nearest one. Vectors that meet are compared twice: by sketches of 128 signs, which alone are sent at first, with a limit eight standard deviations
above what a pair of the wanted cosine differs in; and, where a sketch has found a partner, by their cosine in double precision.

Equal vectors of a label are one class and never meet. A bucket beyond ``BLOCK`` rows is dealt into blocks, of which every two meet in a task of
their own. No task emits pairs: it counts each vector's links, a pair in the first table and bucket where it meets, and names one vector
for each set of linked ones, from which components are joined. So a group of c near copies costs c * c products (their links are counted
one by one), but c / BLOCK rows for each of its vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing;
vectors of different lengths don't link; rows are vectors, also where ids repeat; a null id names no component (null if it holds no other), and
``kept`` is true where vec_id and component_id are the same, null included; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .graphs import components
from .scratch import discard, written

COSINE = 0.93
#: Tables, other buckets that a vector looks into in each, random vectors of a bucket that are aimed at, and rows of a block.
TABLES = 8
PROBES = 3
BUCKET = 4
BLOCK = 1024
#: Alternatives that are weighed for each turn of a bucket's name; bits of a sketch; numbers that a task turns at once.
NEAR = 3
SKETCH = 128
TURNED = 1 << 21


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of the last axis, whose length is a power of two; vectors become longer by the root of that length."""
    n, width = x.shape[-1], 1
    while width < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * width), 2, width)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        width *= 2
    return x


def width(d: int) -> int:
    """Dimensions after padding; eight at least, so that there are axes enough to look at."""
    return 1 << max(3, (d - 1).bit_length())


@functools.lru_cache(maxsize=8)
def _signs(size: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Three rounds of signs for every turn, the same on all machines."""
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1.0, 1.0]), (3, tables, hashes, size))


def buckets(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, tables, 1 + probes): the numbers of each vector's own bucket and of those it looks into, likeliest first; and sketches, as bytes."""
    n, d = unit.shape
    size = width(d)
    turned = np.zeros((n, 1, 1, size))
    turned[:, 0, 0, :d] = unit
    for signs in _signs(size, tables, hashes, seed):
        turned = _hadamard(turned * signs) / np.sqrt(size)
    far = np.abs(turned)  # vectors, tables, hashes, axes
    near = min(max(NEAR, 1 + probes if hashes == 1 else 0), size)
    axes = np.argpartition(-far, near - 1, axis=-1)[..., :near]
    value = np.take_along_axis(far, axes, -1)
    order = np.argsort(-value, axis=-1, kind="stable")
    axes, value = np.take_along_axis(axes, order, -1), np.take_along_axis(value, order, -1)
    named = 2 * axes + (np.take_along_axis(turned, axes, -1) < 0)
    loss = (value[..., :1] - value) ** 2
    choices = np.array(list(itertools.product(range(near), repeat=hashes)))  # the first is the vector's own bucket
    total = sum(loss[:, :, k, choices[:, k]] for k in range(hashes))
    total[..., 0] = -1
    best = np.argsort(total, axis=-1, kind="stable")[..., : 1 + probes]
    name = np.zeros((n, tables, len(choices)), np.int64)
    for k in range(hashes):
        name = name * (2 * size) + named[:, :, k, choices[:, k]]
    sketch = np.packbits(turned[:, :, 0].reshape(n, -1)[:, :SKETCH] < 0, axis=1)
    return np.take_along_axis(name, best, -1), sketch


def sketch_limit(bits: int, cosine: float) -> int:
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(bits * p + 8 * math.sqrt(bits * p * (1 - p)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, size, key and unit (the vector of length 1, as bytes); key and unit are null for what links with nothing."""
    for batch in batches:
        column, labels = batch.column(1), batch.column(2).to_pylist()
        offsets = column.offsets.to_numpy().astype(np.int64)
        value = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        size = np.diff(offsets) * ~np.asarray(column.is_null())
        key: list = [None] * len(column)
        unit: list = [None] * len(column)
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            v = value[offsets[at][:, None] + np.arange(n)]
            with np.errstate(all="ignore"):
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True)) + 0.0  # no negative zeros
            for i, whole, row in zip(at.tolist(), np.isfinite(v).all(axis=1).tolist(), v, strict=True):
                if whole and labels[i] is not None:
                    unit[i] = row.tobytes()
                    key[i] = hashlib.blake2b(f"{n}:{labels[i]}:".encode() + unit[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size.astype(np.int32)), pa.array(key, pa.binary()), pa.array(unit, pa.binary())], names=["vec_id", "label", "size", "key", "unit"])


def _hashed(tables: int, hashes: int, probes: int) -> Callable:
    """From classes (node, label, size, unit) to their bucket names and sketches."""

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = batch.column(2)[at].as_py()
                end = min(batch.num_rows, at + max(1, TURNED // (tables * hashes * width(size))))
                own = batch.slice(at, end - at)
                sizes = own.column(2).to_numpy()
                end = at + (int(np.argmax(sizes != size)) or len(sizes))
                own = own.slice(0, end - at)
                unit = np.frombuffer(b"".join(own.column(3).to_pylist()), np.float64).reshape(-1, size)
                names, sketch = buckets(unit, tables, hashes, probes)
                names = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * names[0].size), pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(3)), names, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["node", "label", "size", "names", "sketch"])
                at = end

    return run


#: What one task's group is known by: a bucket and two of its blocks.
GROUP = ["label", "size", "t", "name", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one group at a time, from rows in order; a group is at most two blocks."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
        if not table:
            continue
        now, new = table[0], np.zeros(table[0].num_rows - 1, bool)
        for k in range(len(GROUP)):
            column = now.column(k)
            codes = column.dictionary_encode().indices.to_numpy() if k == 0 else column.to_numpy()
            new |= codes[1:] != codes[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                yield now.slice(a, b - a)
        rest = now.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _sides(group: pa.RecordBatch) -> np.ndarray:
    """Which rows may be compared: those of which one has its own bucket here, and, between two blocks, from one to the other."""
    own, block = group.column(7).to_numpy(zero_copy_only=False), group.column(8).to_numpy()
    may = own[:, None] | own[None, :]
    if group.column(4)[0].as_py() != group.column(5)[0].as_py():
        may &= block[:, None] != block[None, :]
    np.fill_diagonal(may, False)
    return may


def _sketched(limit_of: Callable[[int], int]) -> Callable:
    """The rows of a group whose sketch comes near to another's."""
    schema = pa.schema([("label", pa.string()), ("size", pa.int32()), ("t", pa.int32()), ("name", pa.int64()), ("node", pa.int64()), ("own", pa.bool_()), ("blocks", pa.int32())])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for group in _groups(batches):
            raw = group.column(10).to_pylist()
            bits = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            apart = np.zeros((len(raw), len(raw)), np.uint16)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[:, None, k] ^ bits[None, :, k])
            near = (apart <= limit_of(bits.shape[1] * 8)) & _sides(group)
            kept = near.any(axis=1)
            if kept.any():
                held.append(group.select([0, 1, 2, 3, 6, 7, 9]).filter(pa.array(kept)))
            if len(held) > 500:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].cast(schema)
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].cast(schema)

    return run


def _verified(cosine: float, per_table: int) -> Callable:
    """node, root, links of each row of a group that has a partner: links it is the first to see, and the smallest node that it is joined with here."""

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for group in _groups(batches):
            node, table, name = group.column(6).to_numpy(), group.column(2)[0].as_py(), group.column(3)[0].as_py()
            unit = np.frombuffer(b"".join(group.column(10).to_pylist()), np.float64).reshape(len(node), -1)
            names = group.column(11).values.to_numpy()[group.column(11).offsets[0].as_py() :][: len(node) * len(group.column(11)[0])].reshape(len(node), -1, per_table)
            times = group.column(12).to_numpy()
            linked = (unit @ unit.T >= cosine) & _sides(group)
            if not linked.any():
                continue
            x, y = np.nonzero(linked)
            first = np.ones(len(x), bool)
            for t in range(table):  # seen by an earlier table
                first &= ~((names[x, t, :1] == names[y, t]).any(axis=1) | (names[y, t, :1] == names[x, t]).any(axis=1))
            # in this table the own bucket of both, or of the one with the smaller bucket that qualifies, counts
            a, b = names[x, table, 0], names[y, table, 0]
            in_a, in_b = (names[y, table] == a[:, None]).any(axis=1), (names[x, table] == b[:, None]).any(axis=1)
            place = np.where(in_a & in_b, np.minimum(a, b), np.where(in_a, a, b))
            first &= place == name
            links = np.bincount(x, weights=np.where(first, times[y], 0), minlength=len(node)).astype(np.int64)
            root = node.copy()
            while True:
                low = root.copy()
                np.minimum.at(low, x, root[y])
                if (low == root).all():
                    break
                root = low
            some = linked.any(axis=1)
            out.append((node[some], root[some], links[some]))
            if len(out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "root", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "root", "links"])

    return run


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a bucket with ``blocks`` blocks, once for each pair of blocks that theirs is in; in order, a group together."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return each.select(*GROUP, "node", "own", "block", "blocks", *more).repartition(*GROUP).sortWithinPartitions(*GROUP)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    assert 0 < cosine <= 1 and 0 <= probes < 8
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    keyed = written(rows.mapInArrow(K.trimmed(_keyed), "vec_id long, label string, size int, key binary, unit binary"), "vectors-keyed")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors-classes")
    # turns that keep buckets of random vectors small, in the group that needs most
    per_group = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    bits = 1 + F.greatest(F.lit(3), F.ceil(F.log2("size")))  # of one turn's part of a name
    turns, most = per_group.agg(F.max(F.ceil(F.log2(F.col("n") / F.lit(float(BUCKET))) / bits)), F.min(F.floor(F.lit(62) / bits))).first()
    hashes = min(max(1, int(turns or 1)), int(most or 1))
    per_table = 1 + probes
    hashed = written(classes.select("node", "label", "size", "unit").mapInArrow(K.trimmed(_hashed(tables, hashes, probes)), "node long, label string, size int, names array<long>, sketch binary"), "vectors-hashed")
    rows = hashed.select("node", "label", "size", "sketch", F.posexplode("names").alias("p", "name"))
    # a name that two of a vector's buckets share can't be: its own comes first and the others differ
    rows = rows.select("label", "size", F.expr(f"p div {per_table}").cast("int").alias("t"), "name", "node", (F.col("p") % per_table == 0).alias("own"), "sketch")
    bucket = ["label", "size", "t", "name"]
    full = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    full = written(full.select(*[F.col(c).alias(f"b_{c}") for c in bucket], F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vectors-buckets")
    same = functools.reduce(lambda p, q: p & q, [rows[c] == full[f"b_{c}"] for c in bucket])
    met = rows.join(full, same).select(*bucket, "node", "own", "blocks", "sketch")
    near = _dealt(met, "sketch").mapInArrow(K.trimmed(_sketched(functools.partial(sketch_limit, cosine=cosine))), "label string, size int, t int, name long, node long, own boolean, blocks int")
    near = written(near.distinct(), "vectors-near")
    # what is left is dealt anew, by the rows that are left
    left = written(near.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).select(*[F.col(c).alias(f"b_{c}") for c in bucket], "blocks"), "vectors-left")
    same = functools.reduce(lambda p, q: p & q, [near[c] == left[f"b_{c}"] for c in bucket])
    near = written(near.drop("blocks").join(left, same).select(*bucket, "node", "own", "blocks"), "vectors-dealt")
    whole = classes.select(F.col("node").alias("c_node"), "unit", "times").join(hashed.select(F.col("node").alias("h_node"), "names"), F.col("c_node") == F.col("h_node"))
    whole = written(whole.select("c_node", "unit", "names", "times"), "vectors-whole")
    found = _dealt(near.join(whole, F.col("node") == F.col("c_node")), "unit", "names", "times").mapInArrow(K.trimmed(_verified(cosine, per_table)), "node long, root long, links long")
    found = written(found.groupBy("node", "root").agg(F.sum("links").alias("links")), "vectors-links")
    for table in (full, near, left, whole, hashed):
        discard(table)
    roots = components(found.select(F.col("node").alias("x"), F.col("root").alias("y"))).select(F.col("node").alias("r_node"), "root")
    links = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    ends = classes.select("key", "node", "least", "times").join(links, F.col("node") == F.col("l_node"), "left").join(roots, F.col("node") == F.col("r_node"), "left")
    ends = ends.select("key", "least", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    ends = written(ends, "vectors-ends")
    name = ends.groupBy(F.col("root").alias("o_root")).agg(F.min("least").alias("component_id"))
    per_class = written(ends.join(name, F.col("root") == F.col("o_root")).select(F.col("key").alias("c_key"), "n_links", "component_id"), "vectors-result")
    out = keyed.select("vec_id", "key").join(per_class, F.col("key") == F.col("c_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
