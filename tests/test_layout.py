import pytest
from pyspark.sql import functions as F
from quillspark.operators import layout
from quillspark.sources import readers, schemas


def block(text, page=1, ord=0, x0=50, y0=100, x1=500, y1=120, size=10.0, bold=False, height=792.0, doc="d"):
    return (doc, page, ord, text, float(x0), float(y0), float(x1), float(y1), size, bold, height)


def frame(spark, blocks):
    return spark.createDataFrame(blocks, schemas.BLOCK)


@pytest.mark.parametrize(
    ("text", "size", "bold", "body", "want"),
    [
        ("Figure 3. A cell", 10, False, 10, "caption"),
        ("Table 1 lists the primers.", 10, False, 10, "body"),
        ("2.6 Extra Trees", 10, False, 10, "heading"),
        ("5 Gy reduced viability [3]", 10, False, 10, "body"),
        ("Methods", 10, True, 10, "heading"),
        ("Methods", 12, False, 10, "heading"),
        ("Methods", 12, False, 0, "body"),
        ("DNA", 10, False, 10, "body"),
        ("RESULTS", 10, False, 10, "heading"),
        ("IN VITRO", 10, False, 10, "heading"),
        ("It ended well.", 14, True, 10, "body"),
        ("y = 1 + 2 ± 3", 10, False, 10, "equation"),
        ("E = 1 + 2 ± 3", 10, False, 10, "heading"),
        ("p < 0.05", 10, False, 10, "body"),
        ("two\nlines", 14, True, 10, "body"),
        ("  ", 10, True, 10, "body"),
    ],
)
def test_classify(spark, text, size, bold, body, want):
    df = spark.createDataFrame([(text, float(size), bold, float(body))], "t string, s double, b boolean, y double")
    assert df.select(layout.classify(F.col("t"), F.col("s"), F.col("b"), F.col("y"))).first()[0] == want


def test_body_size_prefers_text_then_the_first(spark):
    got = layout.body_size(frame(spark, [block("tiny", size=20.0), block("much more text here", ord=1, size=9.04), block("abc", doc="e", size=8.0), block("xyz", doc="e", ord=1, size=7.0), block(" ", doc="f")])).collect()
    assert {r.doc_id: r.body_size for r in got} == {"d": 9.0, "e": 8.0}


def test_drop_margins(spark):
    rows = [block("Journal 3", y0=5, y1=15), block("Journal 4", 2, y0=5, y1=15), block("Only once", 3, y0=5, y1=15), block("Page 3 of 9", 3, 1, y0=780, y1=790), block("xiv", 3, 2, y0=780, y1=790), block("12", 3, 3), block("12", 3, 4, y0=5, y1=15, height=0.0), block("Journal 3", 4, y0=5, y1=200)]
    assert sorted(r.text for r in layout.drop_margins(frame(spark, rows)).collect()) == ["12", "12", "Journal 3", "Only once"]


def order(spark, blocks):
    return [r.text for r in layout.ordered(frame(spark, blocks)).orderBy("place").collect()]


def test_two_columns_only_without_doubt(spark):
    two = [block("L1", x1=290, y0=10), block("R1", ord=1, x0=310, x1=550, y0=5), block("L2", ord=2, x1=290, y0=50), block("R2", ord=3, x0=310, x1=550, y0=60)]
    assert order(spark, two) == ["L1", "L2", "R1", "R2"]
    assert order(spark, [*two, block("Title", ord=4, x0=50, x1=550, y0=1)])[0] == "Title"
    assert order(spark, two[:3]) == ["R1", "L1", "L2"]
    indent = [block("a", y0=10), block("b", ord=1, x0=80, y0=20), block("c", ord=2, x0=60, y0=30), block("d", ord=3, x0=90, y0=40)]
    assert order(spark, indent) == ["a", "b", "c", "d"]


def test_clean_pages(spark):
    rows = [
        block("1 Introduction", 1, 0, y0=70, y1=80, bold=True), block("First part.", 1, 1, y0=100), block("Second part.", 1, 2, y0=130), block("Figure 1. Not this.", 1, 3, y0=160), block("Third part.", 1, 4, y0=190),
        block("CONCLUSIONS HERE", 2, 0, y0=100), block("Fourth.", 3, 0, y0=100), block("References\n[1] A", 3, 1, y0=130), block("After.", 3, 2, y0=160), block("Later.", 4, 0, y0=100),
    ]
    got = [(r.page, r.seg_ord, r.text) for r in layout.clean_pages(frame(spark, rows)).orderBy("page", "seg_ord").collect()]
    assert got == [(1, 0, "First part. Second part."), (1, 1, "Third part."), (3, 0, "Fourth.")]
    assert layout.clean_pages(frame(spark, rows).limit(0)).count() == 0


def test_malformed_blocks():
    good = {"bbox": [1, 2, 3, 4, 5], "lines": [{"spans": [{"text": "ab", "size": 9, "flags": 16}, {"text": "c", "size": None}]}, {"spans": None}]}
    assert readers.block_of(good, 2, 800.0) == {"page": 2, "text": "abc", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "size": 9.0, "bold": True, "page_height": 800.0}
    bad = [None, {}, {"lines": None}, {"lines": [{"spans": []}], "bbox": [1, 2, 3, 4]}, {**good, "bbox": None}, {**good, "bbox": [1]}, {"bbox": [0] * 4, "lines": [{"spans": [{"text": "  "}]}]}]
    assert [readers.block_of(b, 1, 1.0) for b in bad] == [None] * len(bad)
    bold = {"bbox": [0] * 4, "lines": [{"spans": [{"text": "x", "font": "Times-Bold", "flags": None, "size": None}]}]}
    assert readers.block_of(bold, 1, 1.0)["bold"] and readers.block_of(bold, 1, 1.0)["size"] == 0.0
