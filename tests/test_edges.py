"""Sources, sinks, settings, the stream and the whole check."""

import json

import pytest
from pyspark.sql import functions as F
from quillspark import config
from quillspark.plans import pipeline
from quillspark.sources import readers, schemas, sinks
from quillspark.streaming import overrides


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# x\nQUILLSPARK_VERIFY_MODEL='ollama/a'\nQUILLSPARK_EVIDENCE_K=4\nOTHER=1\n")
    s = config.load({"QUILLSPARK_EVIDENCE_K": "7"}, str(env))
    assert (s.verify_model, s.evidence_k, s.chunk_chars) == ("ollama/a", 7, 1500)
    config.assert_local_only(s)
    for wrong in ({"LLM_PROVIDER": "cloud"}, {"VERIFY_MODEL": "gpt"}, {"EMBEDDING_MODEL": "remote/x"}, {"OLLAMA_API_BASE": ""}, {"OLLAMA_API_BASE": "https://api.example.com"}):
        with pytest.raises(config.ConfidentialityError):
            config.assert_local_only(config.load({"QUILLSPARK_" + k: v for k, v in wrong.items()}, None))


def test_pdf_folder_and_decoder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF good")
    (tmp_path / "sub" / "b.PDF").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = readers.pdf_folder(spark, str(tmp_path))
    assert files.count() == 2 and "content" not in readers.pdf_folder(spark, str(tmp_path), False).columns

    def decode(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        spans = [{"text": "Body text of 10.1234/abc.", "size": 10}]
        return [{"text": "10.1234/abc. A title line of this file\nx", "height": 800.0, "title": "", "blocks": [{"bbox": [0, 100, 9, 120], "lines": [{"spans": spans}]}, {"lines": None}, {"bbox": [0] * 4, "lines": [{"spans": [{"text": "12"}]}]}]}]

    pages = readers.pdf_pages(files, decode).collect()
    assert sorted((r.path[-5:], r.page, r.error) for r in pages) == [("a.pdf"[-5:], 1, None), ("b.PDF"[-5:], None, "ValueError: not a PDF")]
    assert [(r.text, r.ord) for r in readers.pdf_blocks(files, decode).collect()] == [("Body text of 10.1234/abc.", 0)]
    (meta,) = readers.file_metadata(readers.pdf_pages(files, decode).where("error IS NULL")).collect()
    assert (meta.doi, meta.title) == ("10.1234/abc.", "10.1234/abc. A title line of this file")
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        readers.pymupdf_decoder(b"%PDF")


def test_text_pages(spark):
    got = readers.text_pages(spark.createDataFrame([("d", "one\ftwo")], "doc_id string, text string")).collect()
    assert [(r.page, r.text) for r in got] == [(1, "one"), (2, "two")]


def test_report_round_trip(spark, tmp_path):
    old = {"manuscript": "m.pdf", "coverage": {"supported": 1}, "checks": [{"ref_key": "1", "resolution": "resolved", "citation": {"id": "c0001", "claim": "é", "ref_keys": ["1"]}}]}
    (tmp_path / "r.json").write_text(json.dumps(old, indent=2, ensure_ascii=False))
    reports = readers.report(spark, str(tmp_path / "r.json"))
    (row,) = readers.checks_of(reports).collect()
    assert (row.verdict, row.reviewed, row.citation.claim, row.check_ord) == ("unchecked", False, "é", 0)
    sinks.write_json(reports, str(tmp_path / "out"))
    again = spark.read.schema(schemas.REPORT).json(str(tmp_path / "out")).first()
    assert again.coverage == {"supported": 1} and again.checks[0].citation.claim == "é"
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.report(spark, str(tmp_path / "bad.json")).collect()


def test_markdown(spark, tmp_path):
    rows = [("m", 1, "supported", "Fine", "2", None, "", " seen ", ""), ("m", 2, "unsupported", "Bad", "1", "refs/a.pdf", "why", None, "look")]
    df = spark.createDataFrame(rows, "manuscript string, ord int, status string, claim string, ref_key string, source_path string, rationale string, snippet string, note string")
    (doc,) = sinks.citations_markdown(df).collect()
    want = "# Citation check — m\n\nCoverage: supported=1, unsupported=1\n\n## [unsupported] Bad\n- cites **[1]** → a.pdf\n- why\n- note: look\n\n## [supported] Fine\n- cites **[2]** → 2\n- source: “seen”\n"
    assert doc.markdown == want
    sinks.write_markdown(sinks.citations_markdown(df), str(tmp_path / "md"))
    rows = [("m", 1, "k1", "T", None, "fetched", "", "refs/k1.pdf"), ("m", 2, "k2", None, None, "paywalled", "", None), ("m", 3, "k3", "", "10.1/x", "error", "locate failed", None)]
    df = spark.createDataFrame(rows, "manuscript string, ord int, ref_key string, title string, doi string, status string, detail string, pdf_path string")
    lines = sinks.acquisition_markdown(df).first().markdown.split("\n")
    assert [x for x in lines if x.startswith(("-", "##"))] == ["## To supply manually (drop into the refs folder)", "- [error] **k3** — 10.1/x — locate failed", "- [paywalled] **k2** — (no metadata)", "## Fetched", "- [fetched] **k1** → refs/k1.pdf"]


def test_override_stream(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([("a", 1, "supported", False, None, "n")], schemas.OVERRIDE).write.parquet(base + "/in")
    run = lambda: overrides.start(spark.readStream.schema(schemas.OVERRIDE).parquet(base + "/in"), base + "/log", base + "/state", base + "/cp").awaitTermination(120)
    run()
    spark.createDataFrame([("a", 2, None, True, None, ""), ("b", 3, "partially", False, None, "")], schemas.OVERRIDE).write.mode("append").parquet(base + "/in")
    run()
    got = {r.check_id: (r.human_override, r.reviewed) for r in overrides.state(spark, base + "/state").collect()}
    assert got == {"a": (None, True), "b": ("partially", True)}


class Double:
    """Stands in for a model: reads one reference per line, and judges by a word of the claim."""

    def complete(self, system, user):
        if system == "refs":
            lines = [x for x in user.split("\n") if x.strip()]
            return "```json\n" + json.dumps([{"key": x[1 : x.index("]")], "title": x.split("] ")[1], "doi": "10.1/" + x[1 : x.index("]")], "authors": ["A"], "year": 2000} for x in lines]) + "\n```"
        return json.dumps({"verdict": "supported" if "rivers" in user.lower() else "unsupported", "confidence": 0.5})


def embed(df, column):
    return df.withColumn("vector", F.array(F.length(column).cast("double"), F.lit(1.0)))


def test_whole_check(spark):
    pages = spark.createDataFrame([("m", 1, "Rivers run deep [1]. Paths are steep [2]. Nothing known [7].\nReferences\n[1] On rivers\n[2] On paths\n[3] Unused")], "doc_id string, page int, text string")
    blocks = spark.createDataFrame([], schemas.BLOCK)
    files = spark.createDataFrame([("r/10.1_1.pdf", None, None)], "path string, doi string, title string").withColumn("path_ord", F.col("path"))
    sources = spark.createDataFrame([("r/10.1_1.pdf", "All rivers are deep. " * 200)], "path string, text string")
    parts = pipeline.Parts(Double, embed, "judge", "refs")
    got = {r.ref_key: (r.bucket, r.claim) for r in pipeline.check(pages, blocks, files, sources, config.Settings(), parts).collect()}
    assert got == {"1": ("supported", "Rivers run deep."), "2": ("no_pdf", "Paths are steep."), "7": ("unresolved_marker", "Nothing known.")}
    with pytest.raises(config.ConfidentialityError):
        pipeline.check(pages, blocks, files, sources, config.Settings(verify_model="cloud/x"), parts)
