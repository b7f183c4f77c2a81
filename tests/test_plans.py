"""Plans that decide whether a query's time grows with its input alone."""

from pyspark.sql import functions as F
from quillspark.functions import citations as C
from quillspark.operators import layout
from quillspark.plans import pipeline
from quillspark.sources import schemas


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_shuffled_once(spark):
    """Margins, columns, body size and segments are all parts of one document's work."""
    plan = layout.clean_pages(spark.createDataFrame([], schemas.BLOCK))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_bibliography_is_cut_out_once(spark):
    pages = spark.createDataFrame([("d", 1, "References\n[1] A 2001")], "doc_id string, page int, text string")
    plan = optimized(pipeline.parse_references(pages, pipeline.Parts(None, None, "", ""), 1000))
    assert plan.count("works cited") <= 3, plan.count("works cited")


def test_body_size_is_the_same_either_way(spark):
    rows = [("a", 1, i, t, 10.0, float(i * 20), 200.0, i * 20 + 10.0, s, False, 800.0) for i, (t, s) in enumerate([("aaaa", 10.04), ("bb", 12.0), ("cc", 12.0), (" ", 20.0), (None, 30.0)])] + [("b", 1, 0, " ", 1.0, 1.0, 2.0, 2.0, 9.0, False, 800.0)]
    blocks = spark.createDataFrame(rows, schemas.BLOCK)
    placed = layout.ordered(blocks)
    joined = {r.doc_id: r.body_size for r in layout.body_size(placed.withColumn("ord", F.col("place"))).collect()}
    window = {r.doc_id: r.body_size for r in layout._with_body_size(placed).collect()}
    assert joined == {"a": 10.0} and window == joined | {"b": 0.0}


def test_entry_numbers(spark):
    lines = ["[12] x", " ( 3 ) y", "4. z", "5) z", "6 z", "[7]x", "", "99999999999999999999. z"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", C.entry_number(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [12, 3, 4, 5, None, None, None, None]


def test_whole_check_keeps_claims_once(spark):
    """What is written and sent for each check has no claim in it, and steps that nothing reads again are gone."""
    from pathlib import Path

    from quillspark import config
    from quillspark.plans import doubles
    from quillspark.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    bib = "References\n[1] Smith A. (2001) Study of one. 10.1/a\n[2] Smith A. (2002) Study of two. 10.1/b"
    pages = spark.createDataFrame([(d, 1, "One holds [1, 2]. Two holds (Smith et al., 2002). None [9].") for d in "mn"] + [(d, 2, bib) for d in "mn"], "doc_id string, page int, text string")
    sources = spark.createDataFrame([("r/10.1_a.pdf", "text " * 100), ("r/10.1_b.pdf", "word " * 100)], "path string, text string")
    files = sources.select("path", F.col("path").alias("path_ord"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("title"))
    out = pipeline.check(pages, spark.createDataFrame([], schemas.BLOCK), files, sources, config.Settings(), pipeline.Parts(doubles.RuleModel, doubles.counted, "judge", "references"))
    new = {p.name.rsplit("-", 1)[0]: p for p in set(folder.iterdir()) - before if p.name.startswith("check-")}
    assert sorted(new) == ["check-answers", "check-citations", "check-resolved", "check-snippets"]
    assert "claim" not in spark.read.parquet(f"file:{new['check-resolved']}").columns
    assert spark.read.parquet(f"file:{new['check-citations']}").count() == 6
    got = sorted((r.doc_id, r.claim, r.ref_key, r.source_path or "") for r in out.collect())
    own = [("None.", "9", ""), ("One holds.", "1", "r/10.1_a.pdf"), ("One holds.", "2", "r/10.1_b.pdf"), ("Two holds.", "Smith 2002", "r/10.1_b.pdf")]
    assert got == [(d, *x) for d in "mn" for x in own]


def test_whole_check_reads_passages_once(spark):
    """Passages meet their claim where they are written; who asks only for their number doesn't read them. They stand by rank."""
    from quillspark import config
    from quillspark.plans import doubles

    pages = spark.createDataFrame([("m", 1, "One holds [1]. Two holds (Smith et al., 2001).\nReferences\n[1] Smith A. (2001) Study of one. 10.1/a")], "doc_id string, page int, text string")
    sources = spark.createDataFrame([("r/10.1_a.pdf", "".join(f"part {i} " + "eanz"[i % 4] * 3 for i in range(200)))], "path string, text string")
    files = sources.select("path", F.col("path").alias("path_ord"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("title"))
    out = pipeline.check(pages, spark.createDataFrame([], schemas.BLOCK), files, sources, config.Settings(chunk_chars=60, passages_per_claim=4), pipeline.Parts(doubles.RuleModel, doubles.counted, "judge", "references"))
    few = out.select("check_id", "n_passages")._jdf.queryExecution().sparkPlan().toString()
    assert "n_passages:int" in few and "snippets:array" not in few
    rows = out.collect()
    assert [r.n_passages for r in rows] == [len(r.snippets) for r in rows] == [4, 4]
    text = sources.first().text
    chunks = [text[i : i + 60] for i in range(0, len(text) - 1, 53)]

    def counts(x):
        v = [len(x), *[x.count(c) for c in "ean "]]
        return [y / sum(z * z for z in v) ** 0.5 for y in v]

    for r in rows:
        likest = sorted(range(len(chunks)), key=lambda i: (-round(sum(a * b for a, b in zip(counts(r.claim), counts(chunks[i]), strict=True)), 6), i))[:4]
        assert r.snippets == [chunks[i] for i in likest]
