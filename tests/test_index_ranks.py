"""How the best passages of a block are chosen."""

import time

import numpy as np
import pyarrow as pa
from quillspark.operators import index


def everything_sorted(score, ords, k):
    return np.lexsort((ords, -np.floor(score * 1e6 + 0.5)), axis=-1)[:, :k]


def test_best_first_is_what_a_full_sort_gives():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n, m, k = int(rng.integers(1, 9)), int(rng.integers(1, 60)), int(rng.integers(1, 12))
        score = rng.integers(-3, 4, (n, m)) / 3 if trial % 3 else rng.normal(size=(n, m))
        ords = np.stack([rng.permutation(m) for _ in range(n)])
        assert (index.best_first(score, ords, k) == everything_sorted(score, ords, k)).all()


def test_best_first_sorts_few():
    score, ords = np.random.default_rng(6).normal(size=(256, 1028)), np.broadcast_to(np.arange(1028), (256, 1028))

    def seconds(f):
        took = []
        for _ in range(7):
            at = time.perf_counter()
            f(score, ords, 4)
            took.append(time.perf_counter() - at)
        return min(took)

    assert seconds(index.best_first) < 0.7 * seconds(everything_sorted)


def test_units_of_equal_lengths():
    rows = [[3.0, 4.0], [0.0, 0.0], [float("inf"), 1.0], [1e200, 1e200], [None, 1.0], [0.0, -2.0]]
    got = index._units(pa.array(rows, pa.list_(pa.float64())))
    assert [None if v is None else v.tolist() for v in got] == [[0.6, 0.8], None, None, None, None, [0.0, -1.0]]
