"""Declared schemas. Order is part of the model, so every list carries its ordinal."""

from __future__ import annotations

REFERENCE = "key string, ref_ord long, raw string, title string, doi string, authors array<string>, year int"
CITATION = "doc_id string, id string, claim string, ref_keys array<string>, section string, page int, kind string"
PASSAGE = "rank int, paper_id string, snippet string, page int, score double, rcs_summary string"
CHECK = (
    "citation: struct<id: string, claim: string, ref_keys: array<string>, section: string, manuscript_page: int, kind: string>, ref_key: string, key_ord: int, "
    "reference: struct<key: string, raw: string, title: string, doi: string, authors: array<string>, year: int>, source_pdf: string, resolution: string, "
    "passages: array<struct<id: string, paper_id: string, snippet: string, page: int, score: double, rcs_summary: string>>, "
    "verdict: string, rationale: string, confidence: double, human_override: string, reviewed: boolean, note: string"
)
REPORT = f"manuscript string, checks array<struct<{CHECK}>>, coverage map<string, int>"
BLOCK = "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, page_height double"
LOOKUP = "key string, status string, pdf_url string, source string, doi string, oa_status string"
OVERRIDE = "check_id string, seq long, verdict string, clear boolean, reviewed boolean, note string"
