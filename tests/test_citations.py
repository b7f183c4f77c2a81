import pytest
from pyspark.sql import functions as F
from quillspark.functions import citations as C
from quillspark.operators import bibliography, mining


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("As shown [3, 5] before", [["3", "5"]]),
        ("wide [2–4] and [ 7 - 8 , 10 ]", [["2", "3", "4"], ["7", "8", "10"]]),
        ("reversed [5-3], too wide [1-101], just fits [1-100]", [[str(i) for i in range(1, 101)]]),
        ("(Smith et al., 2020; Jones and Lee, 2019b) then [1]", [["Smith 2020", "Jones 2019"], ["1"]]),
        ("first [2] then (Garcia 1999)", [["2"], ["Garcia 1999"]]),
        ("(see [4] in 2010)", [["4"]]),
        ("(Doe [4], 2010)", [["Doe 2010"], ["4"]]),
        ("no key (n = 2000) and (2020)", []),
        ("", []),
        (None, []),
    ],
)
def test_find_markers(spark, text, want):
    got = one(spark, text, C.find_markers)
    assert (got if got is None else [m["keys"] for m in got]) == want


def test_marker_places_count_code_points(spark):
    assert [m["pos"] for m in one(spark, "é😀 [1] x (Lee, 2001)", C.find_markers)] == [3, 9]


def test_strip_markers(spark):
    assert one(spark, "It  rose [3–5] , as known (Smith, 2020) . (n = 2000)", C.strip_markers) == "It rose, as known."


def test_strip_line_numbers(spark):
    assert one(spark, "12\nIn 2020 we [3]\n  7 \n12345\n1 2", C.strip_line_numbers) == "In 2020 we [3]\n12345\n1 2"


def test_split_sentences(spark):
    assert one(spark, "One is.  Two? (Three)! four. \n\"Five\" e.g. six", C.split_sentences) == ["One is.", "Two?", "(Three)! four.", '"Five" e.g. six']


def test_references(spark):
    text = "Body\nReferences\nold\nMore\n  BIBLIOGRAPHY :\n[1] A\n[2] B"
    assert one(spark, text, C.references_block).strip() == "[1] A\n[2] B"
    assert one(spark, text, C.before_references) == "Body\n"
    assert one(spark, "the references are here", C.references_block) == ""


@pytest.mark.parametrize(("line", "want"), [("[12] A", 12), ("(3) B", 3), ("4. C", 4), ("5) D", 5), ("6 E", None), ("[7]E", None), (" [ 8 ] F", 8)])
def test_entry_number(spark, line, want):
    assert one(spark, line, C.entry_number) == want


def test_numbered_entries_keep_wrapped_lines(spark):
    block = "\n".join(f"[{i}] Title {i}\nwrapped line\n" + ("2020. 10.1/x" if i == 4 else "more") for i in range(1, 9))
    got = one(spark, block, C.split_entries)
    assert len(got) == 8 and got[3] == "[4] Title 4\nwrapped line\n2020. 10.1/x"


def test_after_a_gap_nothing_opens(spark):
    assert one(spark, "pre\n[1] a\n[2] b\n[4] c\n[5] d", lambda t: C.entries_by_marker(F.split(t, "\n"))) == ["pre", "[1] a", "[2] b\n[4] c\n[5] d"]


def test_author_year_entries(spark):
    assert one(spark, "Smith 2020 A\n\nstray part\n\nLee 2019b B\n", C.split_entries) == ["Smith 2020 A\n\nstray part", "Lee 2019b B\n"]
    assert one(spark, "a\nb\n \nc 1", lambda t: C.entries_by_blank_line(F.split_part(t, F.lit("#"), F.lit(1)))) == ["a\nb\n\nc 1"]
    assert one(spark, "a\nb", C.entries_by_blank_line) is None
    assert one(spark, "a\n\n", C.split_entries) == ["a"]
    assert one(spark, " \n", C.split_entries) == []


def test_pack_chunks(spark):
    block = "\n".join(f"[{i}] {'x' * 50}" for i in range(1, 200))
    chunks = one(spark, block, lambda t: C.pack_chunks(t, 600))
    assert "\n".join(chunks) == block and max(map(len, chunks)) <= 600 and len(chunks) > 15
    big = "[1] a\n[2] " + "y" * 900 + "\n[3] c"
    assert one(spark, big, lambda t: C.pack_chunks(t, 600)) == ["[1] a", "[2] " + "y" * 900, "[3] c"]
    assert one(spark, "\n\nsmall\n", C.pack_chunks) == ["small"]
    assert one(spark, " ", C.pack_chunks) == []


def test_mining(spark):
    pages = spark.createDataFrame([("d", 1, "9\nAlpha holds [1]. Beta (Lee, 2001) and [2, 3]."), ("d", 2, "Gamma [4].\nReferences\n[9] no"), ("d", 3, "Late [5]."), ("e", 1, "None.")], "doc_id string, page int, text string")
    got = [(r.id, r.page, r.claim, r.ref_keys) for r in mining.mine_pages(pages).orderBy("doc_id", "id").collect()]
    assert got == [("c0001", 1, "Alpha holds.", ["1"]), ("c0002", 1, "Beta and.", ["Lee 2001"]), ("c0003", 1, "Beta and.", ["2", "3"]), ("c0004", 2, "Gamma.", ["4"])]
    checks = mining.explode_checks(mining.mine_pages(pages)).where("id = 'c0003'").orderBy("key_ord").collect()
    assert [(r.key_ord, r.ref_key) for r in checks] == [(0, "2"), (1, "3")]
    labels = spark.createDataFrame([("d", 1, "non_checkable"), ("d", 7, "non_checkable"), ("d", 0, "odd")], "doc_id string, i int, kind string")
    assert [r.kind for r in mining.tag_scope(mining.mine_pages(pages), labels).orderBy("id").collect()] == ["empirical", "non_checkable", "empirical", "empirical"]


def test_fallback_is_per_document(spark):
    cols = "doc_id string, page int, seg_ord int, text string"
    layout = mining.mine(spark.createDataFrame([("a", 3, 0, "From layout [1]."), ("b", 1, 0, "No marker.")], cols))
    plain = mining.mine(spark.createDataFrame([("a", 1, 0, "Plain [8]."), ("b", 1, 0, "Plain [9].")], cols))
    assert sorted((r.doc_id, r.page, r.ref_keys) for r in mining.with_fallback(layout, plain).collect()) == [("a", 3, ["1"]), ("b", 1, ["9"])]


def test_references_from_entries(spark):
    rows = [(1, " k1 ", "r" * 2000, "", None, ["A", "", None, *"bcdefghijklmnopqrstuvwxyz"], "2020a"), (2, "", "x", "t", "d", [], "1999"), (3, None, None, None, None, None, "n.d.")]
    df = spark.createDataFrame(rows, "ord int, " + bibliography.ENTRY)
    (got,) = bibliography.to_reference(df).collect()
    assert (got.key, len(got.raw), got.title, got.doi, len(got.authors), got.year) == ("k1", 1000, None, None, 20, 2020)


def test_dedupe_keeps_the_richest_in_first_place(spark):
    rows = [(1, "a", "T", None, [], None), (2, "b", None, None, [], 2000), (3, "a", "U", "d", [], None), (4, "a", None, "e", ["x"], None), (5, "b", None, None, [], 2001)]
    df = spark.createDataFrame(rows, "ord int, key string, title string, doi string, authors array<string>, year int")
    got = [(r.ord, r.key, r.title, r.doi, r.year) for r in bibliography.dedupe_richest(df).orderBy("ord").collect()]
    assert got == [(1, "a", "U", "d", None), (2, "b", None, None, 2000)]


def test_retry_steps(spark):
    rows = [(1, 200, None), (1, 503, None), (2, 503, None), (1, 404, None), (1, None, "timeout"), (1, None, "decode")]
    got = [r[0] for r in spark.createDataFrame(rows, "attempt int, status int, error string").select(bibliography.next_step(F.col("attempt"), F.col("status"), F.col("error"))).collect()]
    assert got == ["ok", "retry", "give_up", "give_up", "retry", "give_up"]


def test_page_of_name(spark):
    rows = [("Doe2020 pages 4-7",), ("Doe page 12",), ("Doe pp 3",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(C.page_of_name(F.col("t"))).collect()] == [4, 12, None, None]
