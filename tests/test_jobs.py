"""Both jobs over growing input: what is new is taken, reruns change nothing, and a run that broke off is made good."""

import hashlib
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import passage_index, review_queue
from jobs.common import settings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def expected(versions, size=1500):
    """Passages of (doc_id, text, lang, source)."""
    out = set()
    for doc, text, lang, source in versions:
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        out |= {(doc, lang, source, sha, i, text[at : at + size], len(text[at : at + size])) for i, at in enumerate(range(0, len(text or ""), size - min(150, size // 8)))}
        if not text:
            out.add((doc, lang, source, sha, None, None, 0))
    return out


def docs(versions):
    return [(*v, len(v[1] or ""), 1) for v in versions]


def test_passage_index_takes_only_what_is_new(spark, tmp_path):
    given, out, mark = (str(tmp_path / x) for x in ("documents", "index", "checkpoint"))
    first = [(1, "word " * 900, "en", "s"), (2, "", "de", "s"), (3, None, None, "s"), (4, "ünï 日本 😀 " * 400, "", None), (None, "no id", "en", "s")]
    add(spark, docs([*first, first[0]]), DOCS, given)
    done = passage_index.run(spark, given, out, mark)
    assert done["documents"] == 6 and done["new_documents"] == 5 and done["batches"] == 1
    rows = lambda: [tuple(r) for r in passage_index.index(spark, out).collect()]
    assert set(rows()) == expected(first) and len(rows()) == len(expected(first)) == done["passages"] + 2
    # nothing new
    assert passage_index.run(spark, given, out, mark)["batches"] == 0
    assert set(rows()) == expected(first)
    # one document again, one in another version, one that is new; what was there isn't read again
    later = [(5, "more " * 500, "en", "t"), (2, "now with text", "de", "s")]
    add(spark, docs([first[0], first[4], *later]), DOCS, given)
    done = passage_index.run(spark, given, out, mark)
    assert (done["documents"], done["new_documents"]) == (4, 2)
    assert set(rows()) == expected(first + later) and len(rows()) == len(expected(first + later))


def test_passage_index_repeats_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    given, out, mark = (str(tmp_path / x) for x in ("documents", "index", "checkpoint"))
    first, second = [(i, f"text {i} " * 300, "en", "s") for i in range(20)], [(i, f"text {i} " * 300, "de", "s") for i in range(15, 30)]
    add(spark, docs(first), DOCS, given)
    passage_index.run(spark, given, out, mark)
    add(spark, docs(second), DOCS, given)
    whole = passage_index.passages
    # the batch's rows are written in part, then the run breaks off
    spark.createDataFrame([(7, "x")], "doc_id long, chunk string").write.parquet(f"{out}/epoch=1/language=en")
    monkeypatch.setattr(passage_index, "passages", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        passage_index.run(spark, given, out, mark)
    monkeypatch.setattr(passage_index, "passages", whole)
    done = passage_index.run(spark, given, out, mark)
    assert (done["documents"], done["new_documents"]) == (15, 10)
    got = [tuple(r) for r in passage_index.index(spark, out).collect()]
    # a text that comes again under another language is known
    assert set(got) == expected(first + second[5:]) and len(got) == len(set(got))


def test_passage_index_by_files_and_settings(spark, tmp_path):
    given, out, mark = (str(tmp_path / x) for x in ("documents", "index", "checkpoint"))
    all_docs = [(i, f"text {i} " * (i * 10), "en", "s") for i in range(1, 7)]
    for d in all_docs:
        add(spark, docs([d]), DOCS, given)
    config = settings("passage_index") | {"chunk_chars": 80, "files_per_batch": 2, "columns": {"doc_id": "doc_id + 100", "text": "text", "lang": "'xx'", "source": "source"}}
    assert passage_index.run(spark, given, out, mark, config)["batches"] == 3
    assert {tuple(r) for r in passage_index.index(spark, out).collect()} == expected([(i + 100, t, "xx", s) for i, t, _, s in all_docs], 80)
    (tmp_path / "odd.json").write_text('{"chunks": 3}')
    with pytest.raises(ValueError, match="chunks"):
        settings("passage_index", str(tmp_path / "odd.json"))


CHECKS = "check_id long, seq long, manuscript string, status string, reviewed boolean, section string, claim string, ref_key string, note string, extra int"
OVERRIDES = "check_id long, seq long, verdict string, clear boolean, reviewed boolean, note string"


def check(i, status="unsupported", manuscript=None, reviewed=False):
    return (i, i, f"m{i % 5}" if manuscript is None else manuscript, status, reviewed, "Results", f"claim {i}", "1", "", 7)


def queue_of(checks, overrides):
    """(manuscript, check_id, status, reviewed, open_problems) by plain loops."""
    problems = {"unsupported", "overstated", "not_found", "partially"}
    state = {}
    for i, _, verdict, clear, mark, note in sorted(overrides, key=lambda o: o[1]):
        if not clear and verdict == "bogus":
            continue
        s = state.setdefault(i, [None, False])
        if clear:
            s[0] = None
        elif verdict is not None:
            s[0], s[1] = verdict, True
        if mark is not None:
            s[1] = mark
    rows = []
    for i, _, manuscript, status, seen, *_ in checks:
        override, marked = state.get(i, (None, seen))
        rows.append((manuscript, i, override or status, marked))
    return {(m, i, s, r, sum(x[0] == m and x[2] in problems and not x[3] for x in rows)) for m, i, s, r in rows}


def test_review_queue_over_growing_tables(spark, tmp_path):
    checks, overrides, out, mark = (str(tmp_path / x) for x in ("checks", "overrides", "queue", "mark"))
    have = [check(i, s) for i, s in enumerate(["unsupported", "supported", "not_found", "no_pdf"] * 6)] + [check(90, "partially", "m0", True)]
    said = [(0, 1, "supported", False, None, "ok"), (4, 2, "bogus", False, None, ""), (8, 3, None, True, None, None), (999, 4, "supported", False, None, "")]
    add(spark, have, CHECKS, checks)
    add(spark, said, OVERRIDES, overrides)
    rows = lambda: [(r.manuscript, r.check_id, r.status, r.reviewed, r.open_problems) for r in review_queue.queue(spark, out).collect()]
    done = review_queue.run(spark, checks, overrides, out, mark)
    assert done["new_checks"] == 25 and done["rows"] == 25
    assert set(rows()) == queue_of(have, said) and len(rows()) == 25
    # nothing new: nothing is written
    assert review_queue.run(spark, checks, overrides, out, mark) == {"new_checks": 0, "new_overrides": 0, "buckets": 0, "rows": 0}
    # one override touches one manuscript's bucket alone
    said.append((1, 5, "overstated", False, False, "look"))
    add(spark, said[-1:], OVERRIDES, overrides)
    before = {f: f.stat().st_mtime_ns for f in Path(out).rglob("*.parquet")}
    done = review_queue.run(spark, checks, overrides, out, mark)
    assert done["buckets"] == 1 and done["new_overrides"] == 1 and 0 < done["rows"] < 25
    after = {f: f.stat().st_mtime_ns for f in Path(out).rglob("*.parquet")}
    assert sum(before.get(f) == t for f, t in after.items()) >= 1
    assert set(rows()) == queue_of(have, said) and len(rows()) == 25
    # new checks of an old and of a new manuscript; an override that comes for a check of an earlier run
    more, late = [check(100, "overstated", "m1"), check(101, "supported", "new")], [(0, 6, None, True, False, None), (777, 7, "supported", False, None, "")]
    add(spark, more, CHECKS, checks)
    add(spark, late, OVERRIDES, overrides)
    review_queue.run(spark, checks, overrides, out, mark)
    assert set(rows()) == queue_of(have + more, said + late) and len(rows()) == 27


def test_review_queue_without_its_mark_gives_the_same(spark, tmp_path):
    """A run that failed between output and mark is repeated whole."""
    checks, overrides, out, mark = (str(tmp_path / x) for x in ("checks", "overrides", "queue", "mark"))
    have = [check(i) for i in range(12)] + [(50, 50, None, "supported", None, None, None, None, None, 7)]
    add(spark, have, CHECKS, checks)
    spark.createDataFrame([], OVERRIDES).write.parquet(overrides)
    review_queue.run(spark, checks, overrides, out, mark)
    first = sorted(review_queue.queue(spark, out).collect(), key=str)
    done = review_queue.run(spark, checks, overrides, out, str(tmp_path / "another mark"))
    assert done["rows"] == 13 and sorted(review_queue.queue(spark, out).collect(), key=str) == first
    assert {r.note for r in review_queue.queue(spark, out).where("manuscript is null").collect()} == {""}


def test_command_line(spark, tmp_path):
    given = str(tmp_path / "documents")
    add(spark, docs([(1, "a text", "en", "s")]), DOCS, given)
    root = str(Path(__file__).resolve().parent.parent)
    call = [sys.executable, "-m", "jobs.passage_index", "--documents", given, "--output", str(tmp_path / "index"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run(call, cwd=root, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "1 documents read, 1 of them new, 1 passages written" in done.stderr
    assert passage_index.index(spark, str(tmp_path / "index")).count() == 1
