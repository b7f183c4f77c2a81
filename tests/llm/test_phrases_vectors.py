"""Operators 11 and 12 against plain versions, odd rows included."""

import random

import numpy as np
import pytest
from quillspark.llm import phrases, polytope

from . import plain

VECTORS = "embedding array<float>, label int, vec_id long, node long, key string, n_links int"


def corpus(seed, n=900):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(16)]
    rows = []
    for i in range(n):
        text = "".join(r.choice(vocab) + r.choice(["", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", ";", "! "]) for _ in range(r.choice([0, 1, 5, 40, 90])))
        rows.append((text.title() if i % 9 == 0 else text, r.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t\n.,", "de"), ("the the the the the " * 400, "en"), ("Ünï — 日本語 " * 30, "ja"), ("x" * 70000 + " y", "en"), ("İ A ß É " * 20, "tr"), ("a\x00b \x0b c\x1fd " * 15, "en")]
    return rows


@pytest.mark.parametrize(("large", "most"), [(256, 3), (1, 3), (3, 4), (256, 2)])
def test_collocations_match_plain_counts(spark, monkeypatch, large, most):
    monkeypatch.setattr(phrases, "LARGE_PREFIX", large)
    rows = corpus(large + most)
    df = spark.createDataFrame([(t, lang, 1, "h", 2, "p") for t, lang in rows], "text string, lang string, n int, h string, w1 int, path string").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, most_words=most).collect()]
    assert sorted(got) == sorted(plain.collocations11(rows, most=most)) and len(got) > 9
    assert sorted(tuple(r) for r in phrases.collocations(df, least=4, inside_percent=80, top=7).collect()) == sorted(plain.collocations11(rows, 4, 3, 80, 7))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one two", "en")], empty.schema)).count() == 0


def test_a_full_filter_loses_and_invents_nothing(spark, monkeypatch):
    """With so few bits that all are set, every pair passes; counts stay exact."""
    rows = corpus(3)
    want = sorted(plain.collocations11(rows))
    monkeypatch.setattr(phrases, "_filter", lambda found: b"\xff" * (phrases.FILTER_BITS // 8))
    assert sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).collect()) == want


def test_scores_pass_64_bits():
    """The exact products: 1000000 * a * a of a = 3 * 10**9 has 25 digits."""
    a, l, r = 3 * 10**9, 4 * 10**9, 5 * 10**9
    assert 1000000 * a * a > 2**64 and 1000000 * a * a // (l * r) == 450000


def vectors(seed, d, n, near):
    """Random vectors, each with ``near`` others at cosines on both sides of the limit."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a = r.normal(size=d)
        rows.append((a, int(r.integers(3))))
        for _ in range(near):
            b = r.normal(size=d)
            b -= a * (a @ b) / (a @ a)
            b *= np.sqrt((a @ a) / max(b @ b, 1e-9))
            c = r.choice([0.9, 0.94, 0.97, 0.999])
            rows.append((c * a + np.sqrt(1 - c * c) * b, rows[-1][1] if r.random() < 0.9 else 0))
    return [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame([(v, label, i, 1, "k", 9) for i, v, label in rows], VECTORS).repartition(3)


def compared(spark, rows, **options):
    got = [tuple(r) for r in polytope.near_vectors(table(spark, rows), **options).collect()]
    want = plain.vectors12(rows)
    assert plain.same(got, want)
    return want


@pytest.mark.parametrize(("d", "block"), [(64, 1024), (64, 4), (48, 1024), (3, 1024)])
def test_near_vectors_match_all_pairs(spark, monkeypatch, d, block):
    monkeypatch.setattr(polytope, "BLOCK", block)
    want = compared(spark, vectors(d + block, d, 60, 3))
    assert sum(x[1] for x in want) > 100


def test_odd_vectors(spark):
    rows = vectors(5, 16, 12, 2)
    v = rows[0][1]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 16, 1), (103, [*v[:-1], None], 1), (104, [*v[:-1], float("nan")], 1), (105, [*v[:-1], float("inf")], 1), (106, v, None), (107, v, rows[0][2]), (108, v, rows[0][2])]
    rows += [(None, v, rows[0][2]), (None, [1.0] * 16, 7), (7, rows[3][1], rows[3][2]), (7, [-x for x in v], 8), (109, v[:8], rows[0][2]), (110, [x * 2**100 for x in v], rows[0][2]), (111, [x * 1e-30 for x in v], rows[0][2])]
    rows += [(200 + i, v, 5) for i in range(30)] + [(240, [1e-40] * 16, 5), (241, [2e-40] * 16, 5), (242, [0.0, -0.0] * 7 + [1.0, 0.0], 5), (243, [-0.0, 0.0] * 7 + [1.0, -0.0], 5)]
    want = compared(spark, [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x], label) for i, x, label in rows])
    assert max(x[1] for x in want) == 29
    assert polytope.near_vectors(table(spark, [])).count() == 0
    assert polytope.near_vectors(table(spark, [(1, None, None)])).collect()[0].kept


def test_recall_near_the_limit(spark):
    """Pairs at 0.931, where each table finds fewest, under two turns a table: none of 400 is lost."""
    r = np.random.default_rng(8)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    names, _ = polytope.buckets(np.concatenate([a, 0.931 * a + np.sqrt(1 - 0.931**2) * b]), polytope.TABLES, 2, polytope.PROBES)
    x, y = names[:400], names[400:]
    met = (x[..., :1] == y).any(axis=2) | (y[..., :1] == x).any(axis=2)
    assert met.any(axis=1).mean() >= 0.995


def test_the_transform_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 8))
    h = polytope._hadamard(np.eye(8))
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and set(np.unique(h)) == {-1.0, 1.0}
    assert np.allclose(polytope._hadamard(x), x @ h)
