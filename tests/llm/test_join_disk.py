"""What the Jaccard join keeps on disk and sends, and that sparing it loses no link."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from quillspark import shared
from quillspark.llm import rtree

from . import plain


def near_copies(groups: int, copies: int) -> list[tuple]:
    """Groups share half of their words with each other; copies within a group all but one."""
    r = np.random.default_rng(groups)
    found = []
    for g in range(groups):
        base = [f"c{i}" for i in range(60)] + [f"g{g}w{i}" for i in range(60)]
        for _ in range(copies):
            own = base.copy()
            own[int(r.integers(60, 120))] = f"x{r.integers(10**6)}"
            found.append((len(found), " ".join(own), "en", "s"))
    return found


def test_packed_points_come_back_and_are_small():
    r = np.random.default_rng(1)
    points = np.stack([r.poisson(1.3, rtree.GROUPS), r.integers(0, 65535, rtree.GROUPS), np.full(rtree.GROUPS, 65535), np.zeros(rtree.GROUPS)]).astype(np.uint16)
    column = pa.array([rtree.packed(p) for p in points])
    assert (rtree.unpacked(column) == points).all() and len(column[0].as_py()) < points[0].nbytes / 5
    assert rtree.unpacked(pa.array([], pa.binary())).shape == (0, rtree.GROUPS)


def search(nodes: list[int], roots: list[int], best: bool) -> tuple[set, set]:
    """Pairs of a shard whose points are all equal, and the shards that say they held some back."""
    n = len(nodes)
    point = rtree.packed(rtree.counts(np.arange(100, dtype=np.uint64)))
    columns = [[77] * n, [0] * n, [0] * n, [100] * n, nodes, roots, [0] * n, [point] * n]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "i", "j", "n", "node", "root", "block", "point"])
    rows = [tuple(r.values()) for b in rtree._shard_search(80, best)(iter([batch])) for r in b.to_pylist()]
    return {r[:2] for r in rows if r[0] is not None}, {r[2:] for r in rows if r[0] is None}


def test_a_shard_says_that_it_held_pairs_back():
    few = search([1, 2, 3], [1, 1, 3], True)
    assert few == ({(1, 3), (2, 3)}, set()) and search([1, 2, 3], [1, 1, 3], False) == few
    pairs, left = search([1, 2, 3, 4, 5, 6], [1, 1, 1, 4, 4, 4], True)
    assert len(pairs) == 4 and left == {(77, 0, 0)}
    assert len(search([1, 2, 3, 4, 5, 6], [1, 1, 1, 4, 4, 4], False)[0]) == 9


def test_second_search_only_takes_shards_that_held_pairs_back(spark, monkeypatch):
    asked = []
    across = rtree.Join._across

    def noted(self, shared, roots, point, best, left=None):
        asked.append((best, None if left is None else left.count()))
        return across(self, shared, roots, point, best, left)

    monkeypatch.setattr(rtree.Join, "_across", noted)
    for groups, copies in ((3, 2), (4, 12)):
        found = near_copies(groups, copies)
        got = [tuple(r) for r in rtree.jaccard_join(plain.table(spark, found), shard_points=8).collect()]
        assert plain.same(got, plain.jaccard9(found))
    assert all(left is None if best else left for best, left in asked) and asked[0] == (True, None)


def test_sets_asked_for_often_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(rtree, "ASKS", 2)
    monkeypatch.setattr(rtree, "SENT_BYTES", 1)
    found = near_copies(3, 9)
    got = [tuple(r) for r in rtree.jaccard_join(plain.table(spark, found + found[:5])).collect()]
    assert plain.same(got, plain.jaccard9(found + found[:5]))


def test_points_and_sets_do_not_stay_on_disk(spark):
    found = near_copies(3, 9)
    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    out = rtree.jaccard_join(plain.table(spark, found))
    stays = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "join-members" in stays and not stays & {"join-points", "join-sets", "join-nodes", "join-shared"}
    assert plain.same([tuple(r) for r in out.collect()], plain.jaccard9(found))
