import pytest
from pyspark.sql import functions as F
from quillspark.operators import acquire, audit, judge, retrieve
from quillspark.sources import schemas


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"verdict": "supported", "rationale": "ok", "confidence": 0.9}', ("supported", "ok", 0.9)),
        ('x ```json\n{"verdict": "partially"}\n``` y', ("partially", "", 0.0)),
        ("nonsense " * 50, ("unsupported", ("nonsense " * 50)[:200], 0.0)),
        ("[1]", ("unsupported", "", 0.0)),
        ('{"verdict": "maybe", "rationale": null, "confidence": 7}', ("unsupported", "", 1.0)),
        ('{"verdict": ["supported"], "confidence": "x"}', ("unsupported", "", 0.0)),
        ('{"verdict": "overstated", "confidence": "0.8"}', ("overstated", "", 0.8)),
        ('{"verdict": "supported"} tail', ("unsupported", '{"verdict": "supported"} tail', 0.0)),
        (None, ("unsupported", "", 0.0)),
    ],
)
def test_verdicts(raw, want):
    assert judge.verdict_of(raw) == want


class Fake:
    def complete(self, system, user):
        if "boom" in user:
            raise TimeoutError
        return '{"verdict": "supported", "rationale": "%d"}' % user.count("\n- ")


def test_judge_isolates_failures_and_skips_empty(spark):
    rows = [("1", "fine", ["a", "b"]), ("2", "boom", ["a"]), ("3", "none", [])]
    got = {r.check_id: (r.verdict, r.rationale, r.failed) for r in judge.parse_verdicts(judge.judge(spark.createDataFrame(rows, "check_id string, claim string, snippets array<string>"), Fake, "s")).collect()}
    assert got == {"1": ("supported", "2", False), "2": ("unsupported", "", True)}


def test_every_bucket(spark):
    rows = [("empirical", "resolved", True, False, 2, "supported", "supported"), ("empirical", "resolved", True, False, 0, None, "not_found"), ("non_checkable", "no_pdf", False, False, 0, None, "not_a_claim"), ("empirical", "no_pdf", False, False, 0, None, "no_pdf"), ("empirical", "resolved", True, True, 0, None, "unreadable_source"), ("empirical", "ambiguous", False, True, 0, None, "ambiguous")]
    df = spark.createDataFrame(rows, "kind string, resolution string, has boolean, failed boolean, n int, said string, want string")
    v, o = judge.settle(F.col("kind"), F.col("resolution"), F.col("has"), F.col("failed"), F.col("n"), F.col("said"))
    for r in df.select(v.alias("verdict"), o.alias("resolution"), "want").withColumn("got", judge.bucket(F.col("verdict"), F.col("resolution"))).collect():
        assert r.got == r.want


def test_overrides(spark):
    rows = [("a", 1, "supported", False, None, "n1"), ("a", 2, None, True, None, None), ("b", 1, "partially", True, None, "x"), ("c", 1, "bogus", False, True, "x"), ("c", 2, None, False, None, "note"), ("d", 1, "unchecked", False, False, ""), ("e", 1, "supported", False, None, "k"), ("e", 2, "nope", False, False, "void")]
    got = {r.check_id: (r.human_override, r.reviewed, r.note) for r in audit.fold_overrides(spark.createDataFrame(rows, schemas.OVERRIDE)).collect()}
    assert got == {"a": (None, True, ""), "b": (None, False, "x"), "c": (None, False, "note"), "d": ("unchecked", False, ""), "e": ("supported", True, "k")}


def test_status_rank_and_queue(spark):
    rows = [(1, "supported", False, "Methods", "Claim A", "3", None), (2, "unsupported", True, "Results", "claim b", "4", "Rivers"), (3, "no_pdf", False, "", "claim c", "5", None)]
    df = spark.createDataFrame(rows, "check_id int, status string, reviewed boolean, section string, claim string, ref_key string, title string")
    ids = lambda d: sorted(r.check_id for r in d.collect())
    assert ids(audit.queue(df, "problems")) == [2] and ids(audit.queue(df, "unreviewed")) == [1, 3] and ids(audit.queue(df, text="RIVERS")) == [2]
    assert ids(audit.queue(df, statuses=("no_pdf", "supported"), section="Methods")) == [1]
    assert [r.check_id for r in df.orderBy(audit.rank(F.col("status"))).collect()] == [2, 1, 3]
    assert spark.range(1).select(audit.rank(F.lit("strange")), audit.rank(F.lit(None).cast("string"))).first()[0:2] == (99, 99)
    status = spark.createDataFrame([("unchecked", "supported", "resolved"), (None, "unchecked", "no_pdf"), ("", "partially", "resolved")], "o string, v string, r string")
    assert [r[0] for r in status.select(audit.display_status(*map(F.col, "ovr"))).collect()] == ["unchecked", "no_pdf", "partially"]


def test_neighbours_and_progress(spark):
    df = spark.createDataFrame([("m", 1, False), ("m", 2, True), ("m", 3, True)], "manuscript string, check_id int, reviewed boolean")
    got = [(r.previous, r.following, r.next_unreviewed) for r in audit.neighbours(df, "manuscript", "check_id").orderBy("check_id").collect()]
    assert got == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]
    assert tuple(audit.progress(df).first()) == (2, 3, 67) and tuple(audit.progress(df.limit(0)).first()) == (0, 0, 0)


def test_chunks_and_top(spark):
    docs = spark.createDataFrame([("a", "x" * 3000), ("b", ""), ("c", None), ("d", "short")], "doc_id string, text string")
    got = [(r.source_id, r.chunk_ord, len(r.chunk)) for r in retrieve.chunks(docs).orderBy("source_id", "chunk_ord").collect()]
    assert got == [("a", 0, 1500), ("a", 1, 1500), ("a", 2, 300), ("d", 0, 5)]
    vec = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.0, 1.0]), ("s", 2, [1.0, 0.0]), ("t", 0, [1.0, 0.0])], "source_id string, chunk_ord int, vector array<double>")
    claims = spark.createDataFrame([("q", "s", [1.0, 0.1])], "claim_id string, source_id string, vector array<double>")
    assert [(r.rank, r.chunk_ord) for r in retrieve.top_in_source(claims, vec, 2).orderBy("rank").collect()] == [(1, 0), (2, 2)]
    nothing = claims.select("claim_id", "source_id", F.array(F.lit(0.0), F.lit(0.0)).alias("vector"))
    assert [(r.chunk_ord, r.score) for r in retrieve.top_in_source(nothing, vec, 2).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0)]


def test_highlights(spark):
    pages = spark.createDataFrame([("s", 1, "The whole snippet stands here."), ("s", 2, "A long fragment that is found alone. And more.")], "source_id string, page int, text string")
    snippet = "A long fragment that is found alone. Another fragment that is nowhere at all."
    passages = spark.createDataFrame([("p1", "s", "whole snippet", 1), ("p2", "s", snippet, 2), ("p3", "s", snippet, 1), ("p4", "s", "absent", None)], "passage_id string, source_id string, snippet string, page int")
    got = sorted((r.passage_id, r.page, r.start, r.length) for r in retrieve.highlights(passages, pages).collect())
    assert got == [("p1", 1, 4, 13), ("p2", 2, 0, 36), ("p3", 2, 0, 36)]
    pages = spark.createDataFrame([("s", 1, r"a.b \\E a.b aXb aaa"), ("s", 2, "a.b")], "source_id string, page int, text string")
    asked = spark.createDataFrame([("q1", "s", "a.b", None), ("q2", "s", "aa", 1), ("q3", "s", r"\\E", 1), ("q4", "s", "", 1)], "passage_id string, source_id string, snippet string, page int")
    got = sorted((r.passage_id, r.page, r.start, r.length) for r in retrieve.highlights(asked, pages).collect())
    text = r"a.b \\E a.b aXb aaa"
    assert got == [("q1", 1, 0, 3), ("q1", 1, text.rindex("a.b"), 3), ("q1", 2, 0, 3), ("q2", 1, text.index("aaa"), 2), ("q3", 1, text.index("\\"), len(r"\\E"))]
    many = " ".join(f"Fragment number {i} is long enough to count." for i in range(30))
    assert len(spark.createDataFrame([(many,)], "t string").select(retrieve.fragments(F.col("t"))).first()[0]) == 20


def test_acquisition(spark):
    refs = spark.createDataFrame([(k, None) for k in "abcdef"], "key string, doi string")
    lookups = spark.createDataFrame([("a", "oa", "u1"), ("b", "oa", "u2"), ("c", "closed", None), ("d", "unresolved", None), ("e", "oa", None), ("f", None, None)], "key string, status string, pdf_url string")
    downloads = spark.createDataFrame([("u1", True), ("u2", False)], "url string, ok boolean")
    got = acquire.classify(refs, spark.createDataFrame([], "name string, valid boolean"), lookups, downloads)
    assert {r.ref_key: (r.status, r.detail) for r in got.collect()} == {"a": ("fetched", ""), "b": ("error", "download failed"), "c": ("paywalled", ""), "d": ("not_found", ""), "e": ("error", "oa lookup returned no location"), "f": ("error", "locate failed")}
    there = got.where("ref_key = 'c'").select(F.upper("name").alias("name"), F.lit(True).alias("valid"))
    assert {r.ref_key: r.status for r in acquire.classify(refs, there, lookups, downloads).collect()}["c"] == "already_present"


def test_lookup_answers(spark):
    rows = [(404, "{}"), (200, "<html>"), (200, '{"is_oa": false}'), (200, '{"is_oa": true, "best_oa_location": {"url": "x"}}'), (200, '{"is_oa": true, "best_oa_location": {"url_for_pdf": "p"}}'), (200, '{"is_oa": true, "best_oa_location": null}')]
    got = [(r[0].status, r[0].pdf_url) for r in spark.createDataFrame(rows, "s int, b string").select(acquire.unpaywall(F.col("s"), F.col("b"))).collect()]
    assert got == [("unresolved", None), ("unresolved", None), ("closed", None), ("closed", None), ("oa", "p"), ("closed", None)]
    rows = [('{"results": []}',), ("busy",), ('{"results": [{"open_access": {"is_oa": true, "oa_url": "http://a/x.PDF"}}]}',), ('{"results": [{"open_access": {"is_oa": true, "oa_url": "http://a/x"}}]}',)]
    got = [(r[0].status, r[0].pdf_url) for r in spark.createDataFrame(rows, "b string").select(acquire.openalex(F.col("b"))).collect()]
    assert got == [("unresolved", None), ("unresolved", None), ("oa", "http://a/x.PDF"), ("closed", None)]
