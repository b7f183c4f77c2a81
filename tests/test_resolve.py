import pytest
from pyspark.sql import functions as F
from quillspark.functions import identifiers as I
from quillspark.operators import resolve

REF = "key string, ref_ord int, title string, doi string, authors array<string>, year int"
FILE = "path string, doi string, title string"


def match(spark, refs, files, **kw):
    r = spark.createDataFrame([(k, i, t, d, a, y) for i, (k, t, d, a, y) in enumerate(refs)], REF)
    f = spark.createDataFrame(files, FILE).withColumn("path_ord", F.col("path"))
    return {x.key: (x.path, x.resolution) for x in resolve.match_files(r, f, **kw).collect()}


def ref(key, title=None, doi=None, authors=(), year=None):
    return key, title, doi, list(authors), year


def test_doi_then_slug_then_title(spark):
    files = [("b/one.pdf", "https://doi.org/10.1000/ABC.", None), ("b/10.1000_abc__k-1.pdf", None, None), ("c/10.1_a__b__k-2.pdf", None, None), ("d/x.pdf", None, "A study of large rivers in the north"), ("a/10.1000_abcd.pdf", None, None)]
    refs = [ref("1", doi="doi:10.1000/abc"), ref("2", doi="10.1/a__b"), ref("3", doi="10.9/none", title="Study of large rivers in the North"), ref("4", title="Nothing like it"), ref("5", doi="10.1000/abcd"), ref("6", doi="10.1/a"), ref("7", doi="10.1000/ab")]
    assert match(spark, refs, files) == {
        "1": ("b/one.pdf", "resolved"), "2": ("c/10.1_a__b__k-2.pdf", "resolved"), "3": ("d/x.pdf", "resolved"), "4": (None, "no_pdf"), "5": ("a/10.1000_abcd.pdf", "resolved"), "6": ("c/10.1_a__b__k-2.pdf", "resolved"), "7": (None, "no_pdf"),
    }


def test_close_titles_are_ambiguous(spark):
    files = [("a.pdf", None, "Deep rivers of the north, part one"), ("b.pdf", None, "Deep rivers of the north, part two"), ("c.pdf", None, "Mountain paths")]
    got = match(spark, [ref("1", title="Deep rivers of the north, part"), ref("2", title="Mountain paths")], files)
    assert got == {"1": (None, "ambiguous"), "2": ("c.pdf", "resolved")}


def test_likeness_depends_on_order():
    assert resolve.likeness("tide", "diet") == 0.25 and resolve.likeness("diet", "tide") == 0.5


@pytest.mark.parametrize("blocks", [(256, 32768), (2, 1)])
def test_title_scores_lose_no_pair(spark, monkeypatch, blocks):
    import itertools

    monkeypatch.setattr(resolve, "REFERENCES", blocks[0])
    monkeypatch.setattr(resolve, "FILES", blocks[1])
    titles = ["rivers", "river", "rivers of the north", "the north", "north rivers of", "a", "ab", "rivers of the north and the far south beyond the sea"]
    r = spark.createDataFrame([(t, t) for t in titles], "key string, title string")
    f = spark.createDataFrame([(t, i, t) for i, t in enumerate(titles)], "path string, path_ord int, title string")
    got = {(x.key, x.path) for x in resolve.title_scores(r, f).collect()}
    want = set()
    for a in titles:
        scores = sorted(((resolve.likeness(a, b), b) for b in titles if resolve.likeness(a, b) >= 0.62), reverse=True)
        want |= {(a, b) for s, b in scores if len(scores) < 2 or s >= scores[1][0]}
    assert got == want


def test_match_files_against_all_pairs(spark):
    """Titles of like words, as in a catalogue, against every pair."""
    import random

    r = random.Random(5)
    words = "river north bridge stone winter garden light paper harbour glass Öl 雪".split()
    titles = [" ".join(r.sample(words, r.randint(2, 6))) for _ in range(120)]
    refs = spark.createDataFrame([(f"k{i}", i, t.upper() if i % 2 else t, None, [], None) for i, t in enumerate(titles)] + [("k3", 1000, "the last one counts here", None, [], None)], REF)
    held = [(f"f{i:03}.pdf", None, t + " v2" if i % 3 else t) for i, t in enumerate(titles) if i % 4] + [("same.pdf", None, titles[0]), ("last.pdf", None, "The last one counts, here")]
    files = spark.createDataFrame(held, FILE).withColumn("path_ord", F.col("path"))
    plain = {x.t: x.n for x in spark.createDataFrame([(t,) for t in {*titles, *(h[2] for h in held)}], "t string").select("t", I.norm_title(F.col("t")).alias("n")).collect()}
    got = {x.key: (x.path, x.resolution) for x in resolve.match_files(refs, files).collect()}
    assert len(got) == len(titles) and got["k3"] == ("last.pdf", "resolved")
    for i, t in enumerate(titles):
        if i == 3:
            continue
        a = plain[t]
        scores = sorted(((resolve.likeness(a, plain[h[2]]), h[0]) for h in held), key=lambda x: (-x[0], x[1]))
        (s1, path), (s2, _) = scores[:2]
        want = (None, "no_pdf") if s1 < 0.62 else (None, "ambiguous") if s2 >= 0.62 and s1 - s2 < 0.08 else (path, "resolved")
        assert got[f"k{i}"] == want, (t, scores[:3])


def test_find_references(spark):
    refs = spark.createDataFrame([("1", 0, None, None, ["A. Smithson"], 2020), ("2", 1, None, None, ["Smith B"], 2020), ("Lee 2001", 2, None, None, [], None)], REF)
    checks = spark.createDataFrame([("1",), ("Smith 2020",), ("Lee 2001",), ("Smith 2021",), ("9",), ("1",)], "ref_key string")
    got = sorted(((r.ref_key, r.found_key) for r in resolve.find_references(checks, refs).collect()), key=str)
    assert got == sorted([("1", "1"), ("1", "1"), ("Smith 2020", "1"), ("Lee 2001", "Lee 2001"), ("Smith 2021", None), ("9", None)], key=str)


def test_checks_never_vanish(spark):
    refs = spark.createDataFrame([("1", 0, None, "10.1/x", [], None)], REF)
    files = spark.createDataFrame([("10.1_x.pdf", None, None)], FILE).withColumn("path_ord", F.col("path"))
    checks = spark.createDataFrame([("1",), ("2",)], "ref_key string")
    assert {r.ref_key: r.resolution for r in resolve.resolve(checks, refs, files).collect()} == {"1": "resolved", "2": "unresolved_marker"}


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(expression(F.col("t"))).collect()]


def test_identifiers(spark):
    assert values(spark, [" HTTPS://doi.org/10.1/A. ", "doi:10.2/b", None], I.norm_doi) == ["10.1/a", "10.2/b", None]
    assert values(spark, ["10.1/A b", "__x__", "///"], I.slug) == ["10.1_a_b", "x", "ref"]
    names = values(spark, ["O'Brien 2020", "O Brien 2020"], lambda k: I.pdf_name(F.lit("https://doi.org/10.1/X"), k))
    assert names[0] != names[1] and all(n.startswith("10.1_x__o_brien_2020-") and n.endswith(".pdf") for n in names)
    assert values(spark, ["a.b-1", "..", ".", "a/b", "", "a b"], I.is_safe_id) == [True, False, False, False, False, False]
    assert [sorted(x) for x in values(spark, ["A__b___c.PDF"], I.stems)] == [["a", "a__b", "a__b_", "a__b___c"]]


def test_document_title(spark):
    rows = [(" A fine long title ", "x"), ("Microsoft Word - a.doc", "short\n  the first line that is long  \n"), ("short", "tiny"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, t string").select(I.document_title(F.col("m"), F.col("t"))).collect()]
    assert got == ["A fine long title", "the first line that is long", None, None]


LOCAL = ["http://localhost:11434", "127.0.0.1", "10.1.2.3:80", "192.168.0.4", "172.16.0.1", "172.31.255.1", "100.64.0.1", "box", "printer.local", "http://[::1]:1/", "0.0.0.0", "http://[fd00::1]"]
AWAY = ["", "https://api.example.com", "http://user:pw@public.example.com", "http://[2001:db8::1]/", "10.evil.example", "172.32.0.1", "100.200.1.1", "8.8.8.8", "1.2.3", "http://localhost@evil.example", "999.1.1.1", "http://localhost.evil.example"]


def test_local_hosts_on_both_sides(spark):
    from quillspark import config

    assert values(spark, LOCAL + AWAY + [None], I.is_local_host) == [True] * len(LOCAL) + [False] * (len(AWAY) + 1)
    assert [config.is_local_host(x) for x in LOCAL + AWAY] == [True] * len(LOCAL) + [False] * len(AWAY)


def test_keys_once_and_checks_find_the_same(spark):
    refs = spark.createDataFrame([ref("7", "t", authors=["Garcia B."], year=2001), ref("8", "u", authors=["Del Garcia"], year=2001), ref("9", "v", authors=[], year=2001), ref("10", "w", authors=["Meyer"], year=None)], "key string, title string, doi string, authors array<string>, year int").withColumn("ref_ord", F.monotonically_increasing_id())
    checks = spark.createDataFrame([("7",), ("7",), ("Garcia 2001",), ("garcia 2001",), ("Del 2001",), ("Meyer 2001",), ("", ), (None,), (" 2001",), ("Novak 1999",)], "ref_key string")
    found = {r.ref_key: r.found_key for r in resolve.find_references(checks.where("ref_key is not null"), refs).collect()}
    assert found == {"7": "7", "Garcia 2001": "7", "garcia 2001": "7", "Del 2001": "8", "Meyer 2001": None, "": None, " 2001": None, "Novak 1999": None}
    counts = checks.groupBy("ref_key").agg(F.count(F.lit(1)).alias("n"))
    once = {r.ref_key: (r.n, r.found_key) for r in resolve.references_of_keys(counts, refs).collect()}
    assert once == {k: (2 if k == "7" else 1, v) for k, v in found.items()} | {None: (1, None)}


def rows_of_joins(df):
    """How many rows each join of a table that has been collected gave."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            metric = node.metrics().get("numOutputRows")
            if "Join" in name and metric.isDefined():
                out.append(metric.get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_equal_titles_meet_nowhere(spark, monkeypatch):
    """300 references and 300 files of one title: 90000 pairs, of which the gate needs two files."""
    refs = spark.createDataFrame([(f"k{i}", i, "Rivers of the north", None, [], None) for i in range(300)] + [("one", 300, "Mountain paths", None, [], None)], REF)
    files = spark.createDataFrame([(f"f{i:03}.pdf", None, "Rivers of the North v2") for i in range(300)] + [("m.pdf", None, "Mountain paths")], FILE).withColumn("path_ord", F.col("path"))
    kept, keep = [], resolve.written
    monkeypatch.setattr(resolve, "written", lambda df, label: kept.append(df.count()) or keep(df, label))
    found = resolve.match_files(refs, files)
    assert {(x.key, x.path, x.resolution) for x in found.collect()} == {(f"k{i}", None, "ambiguous") for i in range(300)} | {("one", "m.pdf", "resolved")}
    assert 0 < max(rows_of_joins(found)) <= 301 and max(kept) <= 301, kept
