"""The pipeline against a plain version of each stage, on the rows that the stage before it kept."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from quillspark.llm import fertility, vocab

from . import plain
from .test_columns import water

ROWS = plain.corpus(seed=11, n=90)


def quality(rows):
    found = []
    for i, text, lang, source in rows:
        name = fertility.VOCABULARIES.get(lang, fertility.DEFAULT_VOCABULARY)
        band = lang if lang in fertility.LANGUAGE_BANDS else fertility.script(text or "")
        found.append(((i, text, lang, source), plain.base2(text)[-1], band, fertility.figures(text or "", name, vocab.VOCAB_DIR)[1:]))
    out = []
    for row, failed, band, figures in found:
        if failed:
            continue
        own = [f for _, bad, b, f in found if b == band and not bad]
        steps = (512, 1024, 1024)
        low, middle, high = ([float(np.quantile([math.floor(f[k] * steps[k]) / steps[k] for f in own], q)) for k in range(3)] for q in (0.25, 0.5, 0.75))
        iqr = [b - a for a, b in zip(low, high)]
        least, most, fallback, entropy = fertility.general(band)
        least = max(least, low[0] - max(4 * iqr[0], 0.08 * middle[0]))
        most = min(most, high[0] + max(8 * iqr[0], 0.25 * middle[0]))
        fallback = min(fallback, high[1] + max(8 * iqr[1], 0.10))
        entropy = max(entropy, low[2] - max(5 * iqr[2], 0.20))
        if least <= figures[0] <= most and figures[1] <= fallback and figures[2] >= entropy:
            out.append(row)
    return out


def line_dedup(rows):
    pages, having = Counter(r[3] for r in rows), Counter()
    for _, text, _, source in rows:
        having.update({(source, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    drop = {k for k, n in having.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    return [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop), lang, s) for i, t, lang, s in rows]


def near_duplicates(rows):
    out, seen = [], set()
    for row, (i, n, component) in zip(rows, plain.jaccard9(rows), strict=True):
        if (n == 0 or i == component) and (n == 0 or row[:2] not in seen):
            seen.add(row[:2])
            out.append(row)
    return out


def mix(rows):
    """Documents with how often they are taken."""
    size = [len(plain.words(t)) for _, t, *_ in rows]
    totals = defaultdict(int)
    for n, r in zip(size, rows, strict=True):
        totals[r[3]] += n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    target = water(dict(totals), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    turn = [int(hashlib.md5(f"mix:{'~' + (r[1] or '') if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) for r in rows]
    so_far, times = defaultdict(int), {}
    for k in sorted(range(len(rows)), key=lambda k: (turn[k], rows[k][0] or 0, size[k])):
        s = rows[k][3]
        so_far[s] += size[k]
        times[k] = [(e * totals[s] + so_far[s]) / target[s] for e in range(3)] if size[k] and target[s] else []
    shots = sorted((t, size[k]) for k, ts in times.items() for t in ts)
    budget, at, cut = sum(size), 0, 0.0
    for t, n in shots:
        at += n
        if at > budget:
            break
        cut = t
    return [row for k, row in enumerate(rows) for t in times[k] if t <= cut]


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_each_stage(spark):
    docs = plain.table(spark, ROWS).select("doc_id", "text", "lang", "source", "n_chars")
    now, rows = docs, ROWS
    steps = dict(corpus_pipeline.STAGES)
    for name, version in (("quality rules", quality), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mix)):
        now, rows = steps[name](spark, now, ""), version(rows)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        assert rows_of(now) == Counter(rows), name
        now = now.persist()
    assert 10 < len(rows) and max(Counter(rows).values()) > 1
    assert all(r.n_chars == len(r.text) for r in now.collect())
    pieces = steps["packing"](spark, now, "").collect()
    tokens = sum(len(vocab.ids(t)) + 1 for _, t, *_ in rows)
    assert sum(p.length for p in pieces) == tokens
    lengths = Counter()
    for p in pieces:
        lengths[p.sequence_id] += p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())


def test_one_of_a_large_group_of_copies_is_left(spark):
    r = np.random.default_rng(3)
    copy = "\n".join(" ".join(f"c{k}" for k in r.integers(0, 10**6, 20)) for _ in range(5))
    rows = [(i, copy, "en", "s1") for i in range(30)]
    rows += [(100 + i, "A line of all.\n" + " ".join(f"w{k}" for k in r.integers(0, 10**6, 60)), "en", "s1") for i in range(40)]
    steps = dict(corpus_pipeline.STAGES)
    lines = steps["line dedup"](spark, plain.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), "").persist()
    got = {x.doc_id: x.text for x in lines.collect()}
    assert all(got[i] == copy for i in range(30)) and not any("A line" in t for t in got.values())
    assert {x.doc_id for x in steps["near duplicates"](spark, lines, "").collect()} == {0, *range(100, 140)}


def test_run_writes_each_stage(spark, tmp_path):
    plain.table(spark, ROWS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_documents(spark, name):
    docs = plain.table(spark, ROWS).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0
