"""The stored index, what a reviewer is shown, overrides as state, and the whole check's progress."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.operators import audit, display, index, retrieve
from quillspark.plans import doubles, pipeline
from quillspark.sources import readers, schemas
from quillspark.streaming import overrides

VECTORS = "source_id string, chunk_ord int, vector array<double>"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in (*a, *b)):
        return 0.0
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0


@pytest.mark.parametrize(("passages", "claims"), [(1024, 256), (3, 2)])
def test_index_finds_what_all_pairs_give(spark, tmp_path, monkeypatch, passages, claims):
    monkeypatch.setattr(index, "PASSAGES", passages)
    monkeypatch.setattr(index, "CLAIMS", claims)
    r = random.Random(4)
    vector = lambda: [float(r.randint(-2, 2)) for _ in range(4)]  # noqa: E731  ties are common
    held = [(s, i, vector()) for s, n in (("a", 40), ("b", 1), ("c", 7)) for i in range(n)] + [("c", 7, None), ("c", 8, [1.0]), ("c", 9, [0.0] * 4), ("c", 10, [1.0, None, 1.0, 1.0])]
    asked = [(i, r.choice("abc"), vector()) for i in range(30)] + [(30, "a", None), (31, "c", [2.0]), (32, "nowhere", vector()), (33, None, vector())]
    built = index.build_index(spark.createDataFrame(held, VECTORS).repartition(3), str(tmp_path / "index"))
    assert built.select(F.max(F.size("ords"))).first()[0] <= passages
    found = index.top_in_source(spark.createDataFrame(asked, "claim_id long, source_id string, vector array<double>").repartition(3), built, 5)
    got = {(x.claim_id, x.source_id, x["rank"], x.chunk_ord, x.score) for x in found.collect()}
    want = set()
    for claim, source, v in asked:
        scores = sorted((-cosine(v, w), o) for s, o, w in held if s == source)
        want |= {(claim, source, k + 1, o, -s) for k, (s, o) in enumerate(scores[:5])}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_index_is_kept_and_read_again(spark, tmp_path):
    held = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.0, 1.0])], VECTORS)
    index.build_index(held, str(tmp_path / "i"))
    claims = spark.createDataFrame([("q", "s", [0.1, 1.0])], "claim_id string, source_id string, vector array<double>")
    kept = spark.read.parquet(str(tmp_path / "i"))
    assert [x.chunk_ord for x in index.top_in_source(claims, kept, 1).collect()] == [1] == [x.chunk_ord for x in retrieve.top_in_source(claims, held, 1).collect()]
    assert index.top_in_source(claims.limit(0), kept, 3).count() == 0


def test_shown_text(spark):
    texts = ["under-\nstood  and\tread", "a - b -\n5 pages 3- 4", None, "  ", "re-  use﻿ it\x0bnow", "x- y- z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [x.t for x in df.select("i", display.flowing(F.col("t")).alias("t")).orderBy("i").collect()] == ["under-stood and read", "a - b - 5 pages 3- 4", "", "", "re-use it now", "x-y- z"]
    colours = spark.createDataFrame([("supported",), ("not_found",), (None,)], "s string").select(display.colour(F.col("s"))).collect()
    assert [x[0] for x in colours] == [[0.40, 0.80, 0.45], None, None]
    refs = spark.createDataFrame([("T", "r", ["A", "B"], 2001), ("", "r", ["A"], None), (None, "", [], 0), (None, None, None, 1999)], "t string, r string, a array<string>, y int")
    assert [tuple(x[0]) for x in refs.select(display.reference_line(*map(F.col, "tray"))).collect()] == [("T", "A et al. (2001)"), ("r", "A"), ("—", ""), ("—", " (1999)")]


def test_neighbours_among_passages(spark):
    df = spark.createDataFrame([(0, []), (0, ["a"]), (0, ["a", "b", "c"]), (1, ["a", "b", "c"]), (2, ["a", "b", "c"])], "i int, p array<string>")
    assert [tuple(x[0]) for x in df.select(display.passage_neighbours(F.col("i"), F.col("p"))).collect()] == [(0, 0), (0, 0), (0, 1), (0, 2), (1, 2)]


def test_order_and_search_by_letters(spark):
    claims = ["zebra", "Äpfel", "apfel", "Zebra", "äpfel", "öl", "ol", "Ångström"]
    df = spark.createDataFrame([(i, "m", "supported", c) for i, c in enumerate(claims)] + [(99, "m", "unsupported", "zz")], "check_id int, m string, status string, claim string")
    got = [x.claim for x in display.in_reading_order(df, "m", "claim").orderBy("place").collect()]
    assert got == ["zz", "Ångström", "apfel", "äpfel", "Äpfel", "ol", "öl", "zebra", "Zebra"]
    assert sorted(x.claim for x in display.holding(df, "claim", "ÄPF").collect()) == ["Äpfel", "äpfel"]


def test_overrides_as_state_equal_the_fold(spark, tmp_path):
    r = random.Random(3)
    events = [(f"c{r.randint(0, 5)}", i, r.choice([None, None, "supported", "overstated", "bogus"]), r.choice([None, False, False, True]), r.choice([None, None, True, False]), r.choice([None, "", "n1", "n2"])) for i in range(60)]
    base = str(tmp_path)
    order = events[:]
    r.shuffle(order)  # events come late, and some twice
    for k, part in enumerate((order[:25], order[20:45], order[45:] + order[:3])):
        spark.createDataFrame(part, schemas.OVERRIDE).coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = overrides.start(spark.readStream.schema(schemas.OVERRIDE).parquet(f"{base}/in"), f"{base}/log", f"{base}/state", f"{base}/cp")
        query.awaitTermination(180)
        seen = {e[1]: e for e in itertools.chain(order[:25], order[20:45] if k else [], order if k > 1 else [])}
        want = {tuple(x) for x in audit.fold_overrides(spark.createDataFrame(list(seen.values()), schemas.OVERRIDE)).select("check_id", "human_override", "reviewed", "note").collect()}
        assert {tuple(x) for x in overrides.state(spark, f"{base}/state").select("check_id", "human_override", "reviewed", "note").collect()} == want
    assert spark.read.parquet(f"{base}/log").count() == 25 + 25 + 18
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != overrides.ROCKS


def test_progress_and_unreadable_sources(spark):
    bib = "References\n[1] Smith A. (2001) Study of one. 10.1/a\n[2] Jones A. (2002) Study of two. 10.1/b\n[5] Meyer A. (2003) Study of five. 10.1/c\n[6] Rossi A. (2004) Study of six. 10.1/d"
    pages = spark.createDataFrame([("m", 1, "One holds [1]. Two holds [2]. Five holds [5]. Six holds [6]. None [9]."), ("m", 2, bib)], "doc_id string, page int, text string")
    sources = spark.createDataFrame([("r/10.1_a.pdf", "text " * 100, None), ("r/10.1_b.pdf", None, "ValueError: no PDF"), ("r/10.1_d.pdf", "", None)], "path string, text string, error string")
    files = sources.select("path", F.col("path").alias("path_ord"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("title"))
    told = []
    parts = pipeline.Parts(doubles.RuleModel, doubles.counted, "judge", "references")
    out = pipeline.check(pages, spark.createDataFrame([], schemas.BLOCK), files, sources, config.Settings(), parts, on_progress=lambda *x: told.append(x))
    got = {x.ref_key: (x.bucket, len(x.snippets or [])) for x in out.collect()}
    assert got["1"][0] in ("supported", "partially", "overstated", "unsupported") and got["1"][1] == 1
    assert {k: v for k, v in got.items() if k != "1"} == {"2": ("unreadable_source", 0), "5": ("unresolved_marker", 0), "6": ("not_found", 0), "9": ("unresolved_marker", 0)}
    assert told == [("references", 3), ("citations", 5), ("resolved", 5), ("passages", 1), ("claims", 3), ("snippets", 1), ("answers", 1)]


def test_folders_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("first\fsecond\n")
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 small")
    (tmp_path / "d.PDF").write_bytes(b"%PDF-1.4 " + b"x" * 100)
    (tmp_path / "e.pdf").write_bytes(b"<html>")
    texts = {x.path.rsplit("/", 1)[1]: x.text for x in readers.text_folder(spark, str(tmp_path)).collect()}
    assert texts == {"one.txt": "first\fsecond\n"}  # an empty file gives no row
    small = readers.bounded_pdfs(spark, str(tmp_path), 50)
    assert [x.path.rsplit("/", 1)[1] for x in small.collect()] == ["c.pdf"]
    assert "LessThanOrEqual(length,50)" in small._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text('{"manuscript": "m", "checks": [{"ref_key": "1"}], "coverage": {"no_pdf": 1}}\n{"manuscript": "cut", "che\n\n[]\n')
    good, bad = readers.report_lines(spark, str(tmp_path / "r"))
    assert [x.verdict for x in readers.checks_of(good).collect()] == ["unchecked"] and '{"manuscript": "cut", "che' in [x.line for x in bad.collect()]


def test_lookups_are_kept(spark, tmp_path):
    from quillspark.operators import acquire

    path, asked = str(tmp_path / "answers"), []
    status = {"a": "oa", "b": "closed", "c": "unresolved", "d": None}

    def lookup(due):
        keys = sorted(r.key for r in due.collect())
        asked.append("".join(keys))
        return spark.createDataFrame([(k, status[k], None) for k in keys], "key string, status string, pdf_url string")

    def run(day, keys):
        return acquire.ask_and_keep(spark.createDataFrame([(k,) for k in keys], "key string"), lookup, path, F.lit(day).cast("date"))

    assert [run("2024-01-01", "abc"), run("2024-01-01", "abcdd"), run("2024-01-02", "abcd"), run("2024-01-08", "abcd")] == [3, 1, 1, 2]
    status["c"] = "oa"
    run("2024-01-31", "abcd"), run("2024-03-30", "abcd")
    assert asked == ["abc", "d", "d", "cd", "bcd", "bd"]
