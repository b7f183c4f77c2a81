"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one bounded slice of rows at a time: texts are laid end to end in a byte buffer and handled
with numpy, so no Python code runs for each word or byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The bytes 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: By number of bytes: the mask that keeps so many of eight.
LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Bytes beyond which a stretch is hashed by itself.
LONG = 256

#: Text bytes that one slice holds, unless a single row is longer.
SLICE_BYTES = 1 << 20


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as plain 32-bit strings; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.string()), "")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one entry more than there are texts)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets.astype(np.int64) - (int(offsets[0]) if len(offsets) else 0)


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` text bytes, or of one row."""
    for batch in batches:
        _, offsets = buffer(texts(batch, name))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it is in; words never cross rows. space: which bytes part words."""
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # of rows that have bytes
    begins[edges] = inside[edges]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def as_binary(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The given stretches, in order and apart, as one Arrow array."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[stops] -= 1  # no two stretches end at one place
    taken = data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    sizes = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=sizes[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(taken)])


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """An exact number for each distinct value of this slice, and the values in that order."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given stretches; equal bytes have equal hashes wherever they stand. Eight bytes of all stretches at a time."""
    sizes = stops - starts
    if not len(sizes):
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = np.minimum(sizes, 8)
    out = mixed((lanes[starts] & LANE[left]) ^ mixed(sizes.astype(np.uint64)))
    live = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    at = 8
    while len(live):
        left = np.minimum(sizes[live] - at, 8)
        out[live] = mixed(out[live] * np.uint64(BASE) + (lanes[starts[live] + at] & LANE[left]))
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes())
    return out


#: An odd multiplier; its powers run through a quarter of all 64-bit words.
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which near values fall far apart."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def grams(x: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Hash of each k consecutive items of a 64-bit sequence, by doubling; shorter than k: none."""
    if len(x) < k:
        return np.empty(0, np.uint64)
    out, have, part, width, done = None, 0, x.astype(np.uint64), 1, 0
    with np.errstate(over="ignore"):
        while done < k:
            if (k >> have) & 1:
                piece = part[done : len(part)] if out is not None else part
                if out is None:
                    out = piece.copy()
                else:
                    n = min(len(out), len(piece))
                    out = mixed(out[:n] * np.uint64(base) + piece[:n])
                done += width
            if done < k:
                n = len(part) - width
                part = mixed(part[:n] * np.uint64(base) + part[width : width + n] + np.uint64(width))
                width, have = 2 * width, have + 1
    return out[: len(x) - k + 1]


#: A 64-bit number for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the power 0, 1, ... (mod 2**64), at least ``n`` of them; kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Like ``grams``, by differences of running sums: as fast for any k. For sequences of bounded length."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * powers(BASE, len(x)), dtype=np.uint64)])
        return mixed((sums[k:] - sums[:n]) * powers(pow(BASE, -1, 1 << 64), n))


#: Low bits of a key that hold the position; the rest holds the hash.
PLACE_BITS = 24


def owners(hashed: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, where its smallest is (the first of equal ones), by block minima from both ends.

    Only the upper bits of a hash count, so the outcome depends on the run's content and on nothing else.
    """
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    assert len(hashed) <= int(low)
    key = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def segments(items: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Content-defined stretches: windows in a row that share their smallest k-gram.

    Returns row, first window start, number of windows (starts count from the slice's begin) and the k-gram's hash. Equal
    windows have equal k-gram hashes, wherever they stand; windows that cross rows are left out.
    """
    gram = rolling(items, k)
    owner = owners(gram, window - k + 1)
    if not len(owner):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    start = np.arange(len(owner))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(owner)]
    whole = start + window <= offsets[row + 1]
    start, row, owner = start[whole], row[whole], owner[whole]
    if not len(start):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], start[first], np.diff(np.append(first, len(start))), gram[owner[first]]


def trimmed(run):
    """The same step for ``mapInArrow``; when its task ends, freed memory goes back to the system, so that idle workers hold little."""

    @functools.wraps(run)
    def step(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the usual C library
                ctypes.CDLL(None).malloc_trim(0)

    return step


def digests(items: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch."""
    raw, step = items.tobytes(), items.itemsize
    joined = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip((starts * step).tolist(), (stops * step).tolist(), strict=True))
    return np.frombuffer(joined, np.int64)


def union_length(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches merged, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]
