"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its word n-grams. The hashes of a set are dealt into groups; the group counts are a point, and no two
sets share more than the sum of the smaller count of each group. Points that meet in a shard are put into an R-tree: a shard is
split again and again at the median of the coordinate that varies most, which gives leaves of points that lie together, and levels
of nodes above them, each with the largest count of every group below it. The tree is run against itself from the root: two nodes,
and in the end two points, are dropped when the summed minima are below what the similarity needs, sizes included. Survivors
come out as they are found, in bounded batches, and are verified on the whole sets.

Shards come from prefixes: sets that are similar enough share one of the first hashes of each (rare ones first; which are
frequent is counted over all documents, and only decides on the order and on salts). Equal sets are one class from the start. Each
class is first tried against the smallest of a shard and those next to it in size, so that large groups of near copies become few
components at once; all pairs that still lie in different components then go through the R-tree, which loses no component. Hashes
of very many sets are salted for the first tries, and a shard beyond ``SHARD_POINTS`` is dealt into blocks, of which every two meet in
a task of their own; so no task holds an unbounded group.

Defined results: sets without words are empty and linked with nothing; a null id never names a component (null if it holds no other);
rows with equal ids are one document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread
from . import textkit as K
from .graphs import components
from .scratch import discard, free_name, written

GROUPS = 512
#: Points of a leaf at most, and children of a node.
LEAF, CHILDREN = 16, 8
#: Pairs whose bound is computed at once.
AT_ONCE = 4096
#: Partners of a hash, next to a set in size, that are tried before any shard; so shards are needed for hashes of more sets only.
BACK = 3
PROBED = ["h", "n", "node", "sets", *(f"p{i}" for i in range(BACK + 1))]
#: Points that a task of a shard takes; a larger shard is dealt into blocks of half as many.
SHARD_POINTS = 4096
#: Frequent hashes that are put last, at most; that many fit a broadcast, whatever the input.
MOST_FREQUENT = 1 << 17
#: Times a hash is seen (twice or more in a task) before it counts as frequent, and before its sets are dealt over several tasks.
FREQUENT, HOT = 8, 10_000
#: Rows of one hash that are looked at together; a longer run is cut, and its pieces meet in the R-tree.
RUN_ROWS = 1 << 18
#: Times a set is asked for (about twice for each set) up to which texts are looked up by a broadcast; more are joined by a shuffle.
MOST_BROADCAST = 400_000
#: Times a set is sent after one look-up, or so; one that is asked for more often is looked up several times.
ASKS = 256
#: Bytes of sets that a task sends at once.
SENT_BYTES = 1 << 24


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted different n-gram hashes of each text."""
    data, offsets = K.buffer(column)
    data = K.LOWER[data]
    starts, stops, row = K.spans(data, offsets)
    words = K.hashes(data, starts, stops)
    grams = K.grams(words, n)
    edges = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo >= n:
            own = np.sort(grams[lo : hi - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif hi > lo:  # the whole sequence as one; its length keeps it apart from whole n-grams
            out.append(np.frombuffer(hashlib.blake2b(words[lo:hi].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def counts(own: np.ndarray) -> np.ndarray:
    """The point of a set; a set too large for 16-bit counts gets a point that bounds nothing."""
    found = np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return (found if len(own) < 1 << 16 else np.full(GROUPS, 65535)).astype(np.uint16)


def packed(point: np.ndarray) -> bytes:
    """A point as it is stored and sent: low bytes, then high ones, Huffman-coded; counts are small, so that is an eighth (LZ4 alone: a half)."""
    coder = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return coder.compress(point.view(np.uint8).reshape(-1, 2).T.tobytes()) + coder.flush()


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The points of a column, one in each row."""
    planes = np.frombuffer(b"".join(zlib.decompress(p, -15) for p in column.to_pylist()), np.uint8).reshape(-1, 2, GROUPS)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint16).reshape(-1, GROUPS)


def needed(a, b, percent: int):
    """What two sets of these sizes must share for a Jaccard index of ``percent`` in a hundred."""
    return -(-(percent * (a + b)) // (100 + percent))


class Tree:
    """An R-tree over the points of a shard: levels of nodes, from the leaves up."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, side: np.ndarray):
        self.order = self._packed(points)
        self.points, self.sizes, self.side = points[self.order], sizes[self.order].astype(np.int64), side[self.order]
        edges = np.append(np.arange(0, len(sizes), LEAF), len(sizes))
        first = edges[:-1]
        self.edges = edges
        top, low, high = np.maximum.reduceat(self.points, first, axis=0), np.minimum.reduceat(self.sizes, first), np.maximum.reduceat(self.sizes, first)
        least, most = np.minimum.reduceat(self.side, first), np.maximum.reduceat(self.side, first)
        self.levels = [(top, low, high, least, most)]
        while len(self.levels[-1][0]) > CHILDREN:
            top, low, high, least, most = self.levels[-1]
            first = np.arange(0, len(top), CHILDREN)
            self.levels.append((np.maximum.reduceat(top, first, axis=0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))

    @staticmethod
    def _packed(points: np.ndarray) -> np.ndarray:
        """An order in which near points are neighbours: groups are split at the median of their widest coordinate, into whole leaves."""
        out: list[np.ndarray] = []
        waiting = [np.arange(len(points))]
        while waiting:
            own = waiting.pop()
            if len(own) <= LEAF:
                out.append(own)
                continue
            sample = points[own[:: max(1, len(own) // 512)]].astype(np.float32)  # where to split is a matter of speed alone
            along = points[own, int(np.argmax(sample.var(0)))]
            cut = -(-len(own) // LEAF // 2) * LEAF
            own = own[np.argpartition(along, cut)] if cut < len(own) else own
            waiting += [own[cut:], own[:cut]]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _near(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a pair of points: not all of one side, sizes that fit, and a bound that is high enough."""
        top, low, high, least, most = self.levels[level]
        ok = (high[x] * 100 >= low[y] * percent) & (high[y] * 100 >= low[x] * percent) & ((least[x] != most[x]) | (least[y] != most[y]) | (least[x] != least[y]))
        at = np.flatnonzero(ok)
        for k in range(0, len(at), AT_ONCE):
            some = at[k : k + AT_ONCE]
            a, b = x[some], y[some]
            ok[some] = (np.minimum(top[a], top[b]).sum(1, dtype=np.int64) >= needed(low[a], low[b], percent)) | (np.maximum(high[a], high[b]) >= 1 << 16)
        return ok

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points of different sides that the bound can't exclude, and their bounds, in batches."""
        root = len(self.levels) - 1
        n = len(self.levels[root][0])
        x, y = np.triu_indices(n)
        waiting = [(root, x, y)]
        while waiting:
            level, x, y = waiting.pop()
            near = self._near(level, x, y, percent)
            x, y = x[near], y[near]
            if not len(x):
                continue
            if level:
                below = len(self.levels[level - 1][0])
                p, q = _crossed(x * CHILDREN, np.minimum((x + 1) * CHILDREN, below), y * CHILDREN, np.minimum((y + 1) * CHILDREN, below))
                keep = p <= q
                p, q = p[keep], q[keep]
                waiting += [(level - 1, p[k : k + AT_ONCE], q[k : k + AT_ONCE]) for k in range(0, len(p), AT_ONCE)]
                continue
            for k in range(0, len(x), AT_ONCE // 16):
                some = slice(k, k + AT_ONCE // 16)
                p, q = _crossed(self.edges[x[some]], self.edges[x[some] + 1], self.edges[y[some]], self.edges[y[some] + 1])
                sp, sq = self.sizes[p], self.sizes[q]
                keep = (p < q) & (self.side[p] != self.side[q]) & (sp * 100 >= sq * percent) & (sq * 100 >= sp * percent)
                p, q = p[keep], q[keep]
                for j in range(0, len(p), AT_ONCE):
                    a, b = p[j : j + AT_ONCE], q[j : j + AT_ONCE]
                    shared = np.minimum(self.points[a], self.points[b]).sum(1, dtype=np.int64)
                    ok = (shared >= needed(self.sizes[a], self.sizes[b], percent)) | (np.maximum(self.sizes[a], self.sizes[b]) >= 1 << 16)
                    if ok.any():
                        yield self.order[a[ok]], self.order[b[ok]], shared[ok]


def _crossed(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with i in the k-th range of a and j in the k-th range of b, for all k."""
    wide = b_end - b
    each = (a_end - a) * wide
    k = np.repeat(np.arange(len(a)), each)
    at = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
    return a[k] + at // wide[k], b[k] + at % wide[k]


def _count_frequent(n: int):
    """(hash, times) of the hashes that a task sees twice or more, from the lowest quarter, where nearly all prefixes lie."""

    def run(batches):
        keys, times = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def merged(keys, times):
            fresh = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            held.clear()
            first = np.flatnonzero(np.append(True, fresh[1:] != fresh[:-1])) if len(fresh) else np.empty(0, np.int64)
            each = np.diff(np.append(first, len(fresh)))
            every, weight = np.concatenate([keys, fresh[first]]), np.concatenate([times, each])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            head = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
            total = np.add.reduceat(weight, head) if len(head) else weight
            several = total > 1
            return every[head][several], total[several]

        waiting = 0
        for batch in K.slices(batches):
            for own in sets_of(K.texts(batch), n):
                low = own[: np.searchsorted(own, np.uint64(1 << 62))]
                held.append(low)
                waiting += len(low)
            if waiting > 1 << 21:
                keys, times = merged(keys, times)
                waiting = 0
        keys, times = merged(keys, times)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["h", "times"])

    return run


def _points(n: int, percent: int, frequent):
    """doc_id, tkey, size, digest of the set, point and prefix of each document."""

    def run(batches):
        last = frequent.value
        for batch in K.slices(batches):
            rows = []
            for own in sets_of(K.texts(batch), n):
                size = len(own)
                d1, d2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
                length = size - -(-percent * size // 100) + 1 if size else 0
                head = own[: length + 64]
                common = last[np.minimum(np.searchsorted(last, head), len(last) - 1)] == head if len(last) else np.zeros(len(head), bool)
                if (~common).sum() < length:  # look further than the usual
                    common = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(size, bool)
                    head = own
                prefix = np.concatenate([head[~common], head[common]])[:length]
                rows.append((size, d1, d2, packed(counts(own)), prefix.view(np.int64)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(list(cols[4]), pa.list_(pa.int64()))],
                names=["doc_id", "tkey", "n", "d1", "d2", "point", "prefix"],
            )

    return run


def _shared_hashes(percent: int, rows: int):
    """From rows (h, n, node, salt, salts) sorted by (h, salt, n, node): those whose hash another node has, how many sets have it, and the nodes to try first (itself: none).

    A run that is salted, or longer than ``rows`` and so cut, has all its rows given out, with more sets than the first tries settle.
    """

    def key(table, i):
        return table.column(0)[i].as_py(), table.column(3)[i].as_py()

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, going = 0, None  # going: the run that was cut last
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            ends = key(batch, batch.num_rows - 1)
            if key(held[0], 0) == ends and size < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h, salt = table.column(0).to_numpy(), table.column(3).to_numpy()
            same = (h == ends[0]) & (salt == ends[1])
            start = int(np.argmax(same))  # of the last run, which may go on
            cut = start if start else size
            yield from _led(table.slice(0, cut), percent, {going, ends if not start else None})
            going = ends if not start else going
            rest = table.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from _led(pa.Table.from_batches(held).combine_chunks(), percent, {going})

    return run


def _led(table: pa.Table, percent: int, cut: set):
    h, n, node, salt, salts = (table.column(i).to_numpy() for i in range(5))
    fresh = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]) | (salt[1:] != salt[:-1]))
    h, n, node, salt = h[fresh], n[fresh].astype(np.int64), node[fresh], salt[fresh]
    many = salts[fresh] > 1
    for part in cut - {None}:
        many |= (h == part[0]) & (salt == part[1])
    # in order of size, a fitting partner is a neighbour if there is any
    fits = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
    at = np.flatnonzero(np.append(False, fits) | np.append(fits, False) | many)
    if not len(at):
        return
    h, n, node, salt, many = h[at], n[at], node[at], salt[at], many[at]
    edges = np.append(np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))), len(h))
    run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    # leaders, of all runs at a time: the first set, then the first that is too large for the last leader
    span = int(n.max()) + 1
    place = run * span + n
    leads = np.zeros(len(h), bool)
    now = edges[:-1]
    while len(now):
        leads[now] = True
        nearest = np.searchsorted(place, run[now] * span + np.minimum(n[now] * 100 // percent, span - 1), "right")
        now = nearest[nearest < edges[run[now] + 1]]
    lead = np.maximum.accumulate(np.where(leads, np.arange(len(h)), 0))
    # probes: the leader and those just before in order of size, where sizes fit; all pairs of a run of BACK + 1 are among them
    probes = [node[lead]]
    for step in range(1, BACK + 1):
        back = np.maximum(np.arange(len(h)) - step, edges[run])
        probes.append(np.where(n[back] * 100 >= n * percent, node[back], node))
    sets = np.where(many, np.maximum(np.diff(edges)[run], BACK + 2), np.diff(edges)[run])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, n, node, sets, *probes)], names=PROBED)


def _bounded(percent: int):
    """From (x, y, nx, ny, px, py) to the pairs (x, y) that the points can't exclude."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                a, b = (unpacked(batch.column(i)) for i in (4, 5))
                nx, ny = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
                ok = (np.minimum(a, b).sum(1, dtype=np.int64) >= needed(nx, ny, percent)) | (np.maximum(nx, ny) >= 1 << 16)
                yield batch.select(["x", "y"]).filter(pa.array(ok))

    return run


def _runs(batches, keys: int):
    """Rows of Arrow batches sorted by their first ``keys`` columns, in tables that hold whole runs of equal keys."""
    pending = None
    for batch in batches:
        pending = pa.Table.from_batches([batch]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([batch])]).combine_chunks()
        change = np.zeros(max(0, pending.num_rows - 1), bool)
        for k in range(keys):
            x = pending.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        ends = np.flatnonzero(change)
        if len(ends):
            yield pending.slice(0, int(ends[-1]) + 1)
            pending = pending.slice(int(ends[-1]) + 1)
    if pending is not None and pending.num_rows:
        yield pending


def _edges(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, bool)
    for k in range(keys):
        x = table.column(k).to_numpy()
        change |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def _crossing(percent: int):
    """From rows (h, i, j, n, node, root) sorted by shard and size: those with a partner of fitting size in another component."""

    def run(batches):
        for table in _runs(batches, 3):
            edges = _edges(table, 3)
            shard = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            n, root = table.column(3).to_numpy(), table.column(5).to_numpy()
            # partners lie between two places of the same shard; a key that grows with both finds them
            span = int(n.max()) * 2 + 2
            key = shard * span + n
            low = np.searchsorted(key, shard * span + -(-n * percent // 100), "left")
            high = np.searchsorted(key, shard * span + np.minimum(n * 100 // percent, span - 1), "right")
            turns = np.concatenate([[0, 0], np.cumsum(root[1:] != root[:-1])])
            keep = turns[high] > turns[low + 1]
            yield from table.filter(pa.array(keep)).to_batches()

    return run


#: Pairs of a shard that are held for the choice of the likeliest.
HELD = 1 << 18


def _likeliest(pairs: list[np.ndarray], most: int = 4) -> np.ndarray:
    """Of rows (x, y, root, other root, score), the ``most`` best of each two components; equal scores by x and y, so that all shards choose alike."""
    t = np.concatenate(pairs, axis=1)
    t = t[:, np.lexsort((t[1], t[0], -t[4], t[3], t[2]))]
    first = np.append(True, (t[2, 1:] != t[2, :-1]) | (t[3, 1:] != t[3, :-1]))
    at = np.arange(t.shape[1])
    return t[:, at - np.maximum.accumulate(np.where(first, at, 0)) < most]


#: What a shard gives out: pairs (x, y), and, with no pair, itself (h, i, j) if it held some back.
SEARCHED = "x long, y long, h long, i int, j int"


def _searched(x: list | np.ndarray, y: list | np.ndarray, shard: tuple | None = None) -> pa.RecordBatch:
    h, i, j = shard or (None, None, None)
    columns = [(x, pa.int64()), (y, pa.int64()), ([h] * len(x), pa.int64()), ([i] * len(x), pa.int32()), ([j] * len(x), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["x", "y", "h", "i", "j"])


def _shard_search(percent: int, best: bool):
    """From rows (h, i, j, n, node, root, block, point) sorted by shard to the pairs across components that a shard's R-tree can't exclude.

    best: of the pairs of the same two components, only the likeliest few, for a first round; a shard that has more says so, others are done.
    """

    def run(batches):
        for table in _runs(batches, 3):
            edges = _edges(table, 3)
            h, i, j, n, node, root, block = (table.column(k).to_numpy() for k in range(7))
            points = unpacked(table.column(7))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                tree = Tree(points[lo:hi], n[lo:hi], root[lo:hi])
                two = i[lo] != j[lo]  # two blocks: the pairs within each are another task's
                held, size, back = [], 0, False
                for x, y, shared in tree.pairs(percent):
                    x, y = x + lo, y + lo
                    if two:
                        apart = block[x] != block[y]
                        x, y, shared = x[apart], y[apart], shared[apart]
                    first, second = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                    if not best:
                        if len(x):
                            yield _searched(first, second)
                        continue
                    score = (shared << 32) // (n[x] + n[y])
                    held.append(np.stack([first, second, np.minimum(root[x], root[y]), np.maximum(root[x], root[y]), score]))
                    size += len(x)
                    if size > HELD:
                        held = [_likeliest(held)]
                        back |= held[0].shape[1] < size
                        size = held[0].shape[1]
                        if size > HELD // 2:  # very many components: what is known goes out
                            yield _searched(held[0][0], held[0][1])
                            held, size = [], 0
                if size:
                    chosen = _likeliest(held)
                    back |= chosen.shape[1] < size
                    yield _searched(chosen[0], chosen[1])
                if back:
                    yield _searched([None], [None], (int(h[lo]), int(i[lo]), int(j[lo])))

    return run


def _sent(n: int):
    """From rows (node, some, text, asks) to (x, part, role, node, own) for each ask: the set as bytes of sorted hashes.

    A row that is repeated gives its set once in a task; what several tasks repeat does no harm.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in K.slices(batches):
            out, size = [], 0
            asks = batch.column(batch.schema.get_field_index("asks")).to_pylist()
            for node, some, asked, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), asks, sets_of(K.texts(batch), n), strict=True):
                if (node, some) in seen:
                    continue
                seen.add((node, some))
                content = own.tobytes()
                for ask in asked:
                    out.append((ask["x"], ask["part"], ask["role"], node, content))
                    size += len(content)
                    if size > SENT_BYTES:
                        yield _ask_rows(out)
                        out, size = [], 0
            if out:
                yield _ask_rows(out)

    return run


def _ask_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["x", "part", "role", "node", "own"])


def _verified(percent: int):
    """From rows (x, part, role, node, own), the set of x itself first, to the pairs that are similar."""

    def run(batches):
        current, base = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for x, part, role, node, own in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if role == 0:
                    current, base = (x, part), own.copy()
                    continue
                assert current == (x, part)
                shared = int((base[np.minimum(np.searchsorted(base, own), len(base) - 1)] == own).sum())
                if 100 * shared >= percent * (len(base) + len(own) - shared):
                    out.append((x, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["x", "y"])

    return run


class Join:
    """The join's steps over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, shard_points: int = SHARD_POINTS, frequent: int = FREQUENT, hot: int = HOT, run_rows: int = RUN_ROWS):
        text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
        self.docs = docs.select(doc.alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
        self.spark, self.n, self.percent, self.shard_points, self.frequent, self.hot, self.run_rows = docs.sparkSession, n, percent, shard_points, frequent, hot, run_rows

    def members(self) -> tuple[DataFrame, DataFrame]:
        """The points of all documents, and the hashes that are dealt over salts (MOST_FREQUENT at most)."""
        seen = self.docs.select("text").mapInArrow(K.trimmed(_count_frequent(self.n)), "h long, times long")
        often = seen.groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= self.frequent).orderBy(F.desc("times"), "h").limit(MOST_FREQUENT)
        often = written(often, "join-often")
        known = np.sort(often.select("h").toArrow().column(0).to_numpy().view(np.uint64))
        shared = self.spark.sparkContext.broadcast(known)
        salted = often.where(F.col("times") > self.hot).select("h", F.ceil(F.col("times") / self.hot).alias("salts"))
        return written(self.docs.mapInArrow(K.trimmed(_points(self.n, self.percent, shared)), "doc_id long, tkey long, n int, d1 long, d2 long, point binary, prefix array<long>"), "join-points"), salted

    def verify(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (x, y) whose whole sets are similar. classes: node, doc_id, tkey."""
        per = written(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("c")), "join-per")
        dealt = pairs.join(per, "x").select("x", F.pmod(F.xxhash64("y"), F.ceil(F.col("c") / 256)).cast("int").alias("part"), "y")
        asked = dealt.select("x", "part", F.lit(0).alias("role"), F.col("x").alias("node")).distinct().unionByName(dealt.select("x", "part", F.lit(1).alias("role"), F.col("y").alias("node")))
        asked = written(asked, "join-asked")
        # each set goes from its document's text to all that ask for it, in one shuffle
        times = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("parts"))
        some = asked.join(times, "node").select("node", F.pmod(F.xxhash64("x", "part"), F.col("parts")).cast("int").alias("some"), F.struct("x", "part", "role").alias("ask"))
        lists = some.groupBy("node", "some").agg(F.collect_list("ask").alias("asks"))
        keys = written(lists.join(classes, "node").select("node", "some", F.col("doc_id").alias("r_id"), F.col("tkey").alias("r_key"), "asks"), "join-keys")
        side = F.broadcast(keys) if asked.count() <= MOST_BROADCAST else keys
        texts = self.docs.join(side, self.docs.doc_id.eqNullSafe(F.col("r_id")) & (self.docs.tkey == F.col("r_key"))).select("node", "some", "text", "asks")
        rows = texts.mapInArrow(K.trimmed(_sent(self.n)), "x long, part int, role int, node long, own binary").repartition("x", "part").sortWithinPartitions("x", "part", "role")
        out = written(rows.mapInArrow(K.trimmed(_verified(self.percent)), "x long, y long"), "join-links")
        for table in (per, asked, keys):
            discard(table)
        return out

    def same_id(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """Edges (x, y) between the classes of each id that has several: it is one document."""
        sets = members.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2")
        ends = sets.groupBy("doc_id").agg(F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2")).where("a1 < b1 or a2 < b2")
        ends = written(ends.select(F.col("doc_id").alias("of_id")), "join-ids")
        nodes = sets.join(ends, F.col("doc_id") == F.col("of_id")).select("doc_id", "d1", "d2").distinct().join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node")
        nodes = written(nodes, "join-id-nodes")
        least = nodes.groupBy(F.col("doc_id").alias("of_id")).agg(F.min("node").alias("x"))
        return written(nodes.join(least, F.col("doc_id") == F.col("of_id")).where("x < node").select("x", F.col("node").alias("y")), "join-id-edges")

    def run(self) -> DataFrame:
        p = self.percent
        points, salted = self.members()
        members = written(points.select("doc_id", "tkey", "n", "d1", "d2"), "join-members")
        classes = members.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("m"), F.min("n").alias("n"))
        # a class goes by a number of its own, in the order of ids: different sets may stand under one id, and the first ones of a group are tried first
        classes = classes.orderBy("m.no_id", "m.doc_id", "m.tkey", "d1").select("d1", "d2", F.monotonically_increasing_id().alias("node"), "n", "m.doc_id", "m.tkey")
        classes = written(classes, "join-classes")
        own = self.same_id(members, classes)
        first = points.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("doc_id").alias("e_id"), F.col("tkey").alias("e_key"), "point", "prefix")
        leads = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("tkey") == F.col("e_key")) & F.col("doc_id").eqNullSafe(F.col("e_id"))
        hashes = classes.join(first, leads).select(F.explode("prefix").alias("h"), "n", "node").join(F.broadcast(salted), "h", "left")
        hashes = hashes.select("h", "n", "node", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0)).alias("salt"), F.coalesce("salts", F.lit(1)).alias("salts"))
        hashes = hashes.repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "node")
        shared = written(hashes.mapInArrow(K.trimmed(_shared_hashes(p, self.run_rows)), ", ".join(f"{x} long" for x in PROBED)), "join-shared")
        wanted = written(shared.select("node").distinct(), "join-wanted")
        point = classes.join(wanted, "node", "left_semi").join(first, leads).select("node", F.col("n").cast("long").alias("n"), "point")
        point = written(point.dropDuplicates(["node"]), "join-nodes")
        discard(points)

        stars = shared.select("node", F.explode(F.array_distinct(F.array(*PROBED[4:]))).alias("x")).where("x != node").select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct()
        stars = self._with_points(written(stars, "join-pairs"), point)
        tried = written(stars.mapInArrow(K.trimmed(_bounded(p)), "x long, y long"), "join-stars")
        roots = written(components(self.verify(tried, classes).unionByName(own)), "join-roots")

        # the likeliest pairs of each two components first, then, over the components that makes, all pairs that are left, in the shards that held some back
        left = None
        for best in (True, False):
            searched = written(self._across(shared, roots, point, best, left), "join-searched")
            found = written(searched.where("x is not null").select("x", "y").join(tried, ["x", "y"], "left_anti"), "join-found")
            late = self.verify(found, classes)
            tried = tried.unionByName(found)
            if not late.isEmpty():
                roots = written(components(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(late)), "join-roots")
            left = written(searched.where("x is null").select("h", "i", "j"), "join-left")
            if left.isEmpty():
                break
        for table in (shared, wanted, point):
            discard(table)
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
        placed = classes.join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), "doc_id", "tkey")
        names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(first).alias("best"))
        named = written(placed.join(names, "root").select("d1", "d2", "component_id", "best"), "join-named")
        out = members.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), "d1", "d2").join(named, ["d1", "d2"], "left")
        lead = (F.col("n_shingles") == 0) | (F.col("tkey").eqNullSafe(F.col("best.tkey")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
        return out.select("doc_id", "tkey", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), lead.alias("leads"))

    def _across(self, shared: DataFrame, roots: DataFrame, point: DataFrame, best: bool, left: DataFrame | None = None) -> DataFrame:
        """SEARCHED: pairs across components that no shard's R-tree excludes. left: the shards (h, i, j) to search; None: all."""
        p = self.percent
        of = shared.where(F.col("sets") > BACK + 1).select("h", "n", "node")
        of = of if left is None else of.join(left.select("h").distinct(), "h", "left_semi")  # all rows of a hash, so that it has the same blocks
        of = of.join(roots, "node", "left").select("h", "n", "node", F.coalesce("root", "node").alias("root"))
        of = written(of, "join-of")
        blocks = F.when(F.col("c") > self.shard_points, F.ceil(F.col("c") / (self.shard_points / 2))).otherwise(1).cast("int")
        mixed = written(of.groupBy("h").agg(F.min("root").alias("u"), F.max("root").alias("v"), F.count(F.lit(1)).alias("c")).where("u != v").select("h", blocks.alias("blocks")), "join-mixed")
        rows = of.join(mixed, "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "node", "root", "block")
        rows = rows if left is None else rows.join(left, ["h", "i", "j"], "left_semi")
        names = "h long, i int, j int, n long, node long, root long, block int"
        rows = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "node").mapInArrow(K.trimmed(_crossing(p)), names)
        full = rows.join(point.select("node", "point"), "node").select("h", "i", "j", "n", "node", "root", "block", "point")
        # a row costs far more to search than to send
        return spread(full, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "node").mapInArrow(K.trimmed(_shard_search(p, best)), SEARCHED).distinct()

    def _with_points(self, pairs: DataFrame, point: DataFrame) -> DataFrame:
        x = point.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("point").alias("px"))
        y = point.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("point").alias("py"))
        return pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", "px", "py")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, **limits: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach, its own included). limits: those of ``Join``."""
    return Join(docs, id_col, text_col, n, percent, **limits).run().select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that lead their component, with all their columns; rows without words stay. Of rows alike in id and text one stays."""
    own = free_name(docs.columns)
    doc, tkey, key, times, n_sets = (f"{own}_{x}" for x in ("id", "tkey", "key", "times", "n"))
    found = Join(docs, id_col, text_col, n, percent).run()
    leaders = found.where("leads").groupBy(F.col("doc_id").alias(doc), F.col("tkey").alias(tkey)).agg(F.count(F.lit(1)).alias(times), F.max("n_shingles").alias(n_sets))
    leaders = written(leaders, "join-leaders")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = keyed.join(leaders, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(tkey)))
    several = (F.col(times) > 1) & (F.col(n_sets) > 0)
    if not leaders.where(several).isEmpty():
        kept = kept.where(~several).unionByName(kept.where(several).dropDuplicates([doc, tkey]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
