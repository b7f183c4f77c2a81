import numpy as np
import pytest
from quillspark.llm import boilerplate, fairmix, graphs, lempel, rtree, suffix, textkit

from . import plain

ROWS = plain.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return plain.table(spark, ROWS).repartition(3)


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


@pytest.mark.parametrize("shard", [4096, 2])
def test_substring_dedup_is_exact(docs, shard):
    got = rows(lempel.substring_dedup(docs, shard_segments=shard), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = plain.windows10(ROWS)
    assert plain.same(got, want) and sum(r[2] for r in want) > 500


def test_factors_end_with_their_reference_block(spark):
    """P / x y P / P x: the end of document 1 and the begin of document 2 make no P + x."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(0, 60, 3):
        p = " ".join(f"p{i}w{k}" for k in r.integers(0, 10**6, 50))
        rows += [(i, p), (i + 1, f"x{i} y{i} {p}"), (i + 2, f"{p} x{i}")]
    got = {r.doc_id: r.n_removed for r in lempel.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 50, 50)[i % 3] for i in range(60)}


def test_rows_without_an_id_are_told_apart(spark):
    """Many rows share no id or one id; none loses what only another one repeats."""
    r = np.random.default_rng(9)
    passage = " ".join(f"p{k}" for k in r.integers(0, 10**6, 90))
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) + (f" {passage}" if i % 2 else "") for i in range(1500)]
    found = [(None if i % 3 else 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(found, "doc_id long, text string")
    got = rows(suffix.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert plain.same(got, plain.bytes5(found)) and sum(r[2] > 0 for r in got) == 750
    assert all(x.n_removed == 0 for x in lempel.substring_dedup(df).collect())  # one document, and rows that refer to none


@pytest.mark.parametrize("shard", [4096, 2])
def test_suffix_dedup_is_exact(docs, shard):
    got = rows(suffix.suffix_dedup(docs, shard_segments=shard), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = plain.bytes5(ROWS)
    assert plain.same(got, want) and sum(r[2] for r in want) > 5000


def test_long_rows_are_cut_into_overlapping_stretches(spark, monkeypatch):
    from quillspark.llm import anchors

    text = " ".join(f"w{i % 700}" for i in range(2000))
    column = textkit.pa.array([text, "short", text[:900]])
    whole = [list(x) for x in _segments(anchors, column)]
    monkeypatch.setattr(anchors, "STRETCH", 256)
    parts = [list(x) for x in _segments(anchors, column)]
    assert {w for s in whole for w in s} == {w for s in parts for w in s}


def _segments(anchors, column):
    """The windows that each segment covers, with their anchor."""
    for items, offsets, at, base in anchors.runs_of(column, "word", 50):
        row, start, n, gram = textkit.segments(items, offsets, 16, 50)
        for r, s, c, g in zip(row, start, n, gram):
            yield ((int(at[r]), int(s - offsets[r] + base + k), int(g)) for k in range(c))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for size in (1, 2, 50, 400):
        symbols = rng.integers(1, 4, size).astype(np.int16)
        symbols[rng.random(size) < 0.03] = 0
        order, place = suffix.suffix_array(symbols)
        data = symbols.tolist()
        assert order.tolist() == sorted(range(size), key=lambda i: data[i:])
        got = suffix.common_prefixes(symbols, order, place, np.array([0]), np.array([size]), 30)

        def shared(a, b):
            k = 0
            while a + k < size and b + k < size and data[a + k] == data[b + k] and data[a + k] and k < 30:
                k += 1
            return k

        assert [int(got[i]) for i in range(1, size)] == [shared(order[i - 1], order[i]) for i in range(1, size)]


@pytest.mark.parametrize("limits", [{}, {"shard_points": 4, "frequent": 10**9}, {"frequent": 2, "hot": 2}, {"run_rows": 1}, {"run_rows": 3, "shard_points": 4}])
def test_jaccard_join_is_exact(docs, limits):
    got = rows(rtree.jaccard_join(docs, **limits), "doc_id", "n_shingles", "component_id")
    assert plain.same(got, plain.jaccard9(ROWS))


@pytest.mark.parametrize("limits", [{}, {"run_rows": 7}, {"frequent": 2, "hot": 5, "shard_points": 8}])
def test_jaccard_join_of_many_near_copies(spark, limits):
    """Groups that share words with each other but not enough, over cut, salted and dealt shards."""
    r = np.random.default_rng(8)
    common = [f"c{i}" for i in range(60)]
    found = []
    for g in range(4):
        base = common + [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            own = base.copy()
            own[int(r.integers(60, 120))] = f"x{r.integers(10**6)}"
            found.append((len(found), " ".join(own), "en", "s"))
    got = rows(rtree.jaccard_join(plain.table(spark, found), **limits), "doc_id", "n_shingles", "component_id")
    assert plain.same(got, plain.jaccard9(found)) and {c for _, _, c in got} == {0, 25, 50, 75}


def test_one_of_each_keeps_one_row_of_a_group(docs):
    kept = rtree.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    lead = {c for _, n, c in plain.jaccard9(ROWS) if n}
    assert {i for i, _ in got} == lead | {202, 203, 204}
    assert sum(i == 200 for i, _ in got) == 0  # a copy of document 1


def test_rtree_loses_no_similar_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64)
        for _ in range(4):
            own = base.copy()
            own[: rng.integers(0, max(1, len(own) // 6))] = rng.integers(0, 2**63)
            sets.append(np.unique(own))
    points = np.stack([rtree.counts(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = rtree.Tree(points, sizes, np.arange(len(sets)))
    assert len(tree.levels) > 1 and sorted(tree.order.tolist()) == list(range(len(sets)))
    out = [tuple(sorted(p)) for x, y, _ in tree.pairs(80) for p in zip(x.tolist(), y.tolist())]
    found = set(out)
    assert len(out) == len(found)  # each pair once
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (sizes[a] + sizes[b] - o):
                assert (b, a) in found
    assert len(found) < len(sets) ** 2 / 8


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 90, 90: 90, 95: 90}


def test_line_dedup(spark):
    pages = [("a", f"shared line\nown {i}\n\nown {i}") for i in range(20)] + [("b", "shared line\nx")] * 3 + [(None, "shared line")] * 6 + [("a", None), ("c", "")]
    pages += [("d", "the only page\nof its host")] + [("e", f"rare\nown {i}" if i < 3 else f"own {i}") for i in range(30)] + [("f", f"rare\nown {i}" if i < 4 else f"own {i}") for i in range(30)]
    df = spark.createDataFrame([(i, h, t, "x") for i, (h, t) in enumerate(pages)], "page_id long, host string, text string, lines string")
    got = {r.page_id: (r.text, r.n_lines, r.n_dropped) for r in boilerplate.line_dedup(df).collect()}
    assert got[0] == ("own 0\n\nown 0", 4, 1)
    assert got[20] == ("", 2, 2)  # on all pages of a small host
    assert got[31] == ("the only page\nof its host", 2, 0)
    assert got[32] == ("rare\nown 0", 2, 0) and got[62] == ("own 0", 2, 1)  # a tenth of the pages, and more
    assert got[23] == ("", 1, 1)  # null is a host
    assert got[29] == (None, 0, 0) and got[30] == ("", 1, 0)
    assert boilerplate.line_dedup(df.limit(0)).count() == 0
    assert boilerplate.line_dedup(df, report=False).columns == df.columns


def test_hosts_and_lines(spark):
    from pyspark.sql import functions as F

    urls = ["https://User:pw@WWW.Example.org:80/x?y", "http://[::1]/", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(boilerplate.host(F.col("u"))).collect()]
    assert got == ["example.org", "[::1]", None, None]
    html = "<html><script>a<p>b</script><p>x &amp; <b>y</b>\n z</p><!-- c --><br>  w </html>"
    assert spark.createDataFrame([(html,)], "h string").select(boilerplate.html_lines(F.col("h"))).first()[0] == "x & y z\nw"


def test_empty_tables(docs):
    none = docs.limit(0)
    for df in (lempel.substring_dedup(none), suffix.suffix_dedup(none), rtree.jaccard_join(none), rtree.one_of_each(none)):
        assert df.count() == 0


def clashing(df):
    """With columns named as operators used to name their own, and as they name them now."""
    from pyspark.sql import functions as F

    names = ["__key", "__text", "__own", "__turn", "__drop", "__site", "__id", "__times", "__tkey", "__q", "__q_row", "__Q_Key", "__q__id"]
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names]), names


def test_texts_of_one_id_are_one_document(spark):
    """40 ids with two texts each; every text has a near copy under an id of its own."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(40):
        for k in range(2):
            w = [f"w{x}" for x in r.integers(0, 10**6, 80)]
            rows += [(i, " ".join(w)), (1000 + 2 * i + k, " ".join([*w[:40], "changed", *w[41:]]))]
    rows += [(500, "one two three"), (500, "four five six seven"), (500, "four five six seven"), (501, "four five six seven"), (None, rows[0][1]), (None, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(x) for x in rtree.jaccard_join(df).collect()]
    assert plain.same(got, plain.jaccard9(rows))
    assert all(c < 40 for i, _, c in got if i is not None and i >= 1000)
    kept = rtree.one_of_each(df).collect()
    assert sorted(x.doc_id for x in kept) == [*range(40), 500]


def test_names_of_other_columns_do_not_matter(spark):
    rows = [(i, f"line {i % 7}\nown line number {i} of many\nfooter", f"s{i % 2}") for i in range(30)]
    df, names = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for out in (boilerplate.line_dedup(df, "source", report=False), fairmix.mixed(df), rtree.one_of_each(df)):
        assert out.columns == df.columns
        found = out.collect()
        assert found and all(x[n] == f"{n}:{x.doc_id}" for x in found for n in names)
    assert all("footer" not in x.text for x in boilerplate.line_dedup(df, "source").collect())


def test_equal_rows_of_a_mix_count_each(spark):
    """500 equal rows of one source: the mix takes as many words as fair_mix says, though not each row as often."""
    rows = [(7, "three words here", "a", k) for k in range(500)] + [(8 + i, "one two " * (i % 5), "b", 0) for i in range(40)] + [(None, "no id", "c", k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k int").repartition(5)
    taken = fairmix.fair_mix(df).collect()
    mixed = fairmix.mixed(df).collect()
    for source in "abc":
        want, got = sum(x.taken for x in taken if x.source == source), sum(len(x.text.split()) for x in mixed if x.source == source)
        assert want == got
        assert abs(got - next(x.target for x in taken if x.source == source)) <= 30
    assert max(sum(x.k == k and x.doc_id == 7 for x in mixed) for k in range(500)) <= 3
