"""The registered queries of the engine: each applies one operator to whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import identifiers as I
from ..operators import acquire, audit, bibliography, display, index, judge, layout, mining, report, resolve, retrieve
from ..shared import discard, new_folder, written
from ..config import Settings
from ..sources import readers, schemas
from . import derive as D
from . import pipeline
from . import recipes as R
from .doubles import RuleModel, counted, json_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(x, by: str = "|"):
    return F.array_join(x, by)


# ---- markers, sentences, claims


def _key_counts(spark, sf) -> DataFrame:
    """ref_key, n: keys with the number of checks that name them. Texts are mined once; resolving works on the keys, which are few."""
    return D.checks(spark, sf).groupBy("ref_key").agg(F.count(F.lit(1)).alias("n"))


def _bucketed(found: DataFrame) -> DataFrame:
    return found.groupBy(judge.bucket(F.lit("unchecked"), F.col("resolution")).alias("bucket")).agg(F.sum("n").alias("n"))


@query
def coverage(spark, sf):
    """Citations of all documents by the bucket they end in."""
    return _bucketed(resolve.resolve(_key_counts(spark, sf), D.references(spark, sf), D.files(spark, sf), keys_once=True))


@query
def coverage_by_identifier(spark, sf):
    """The same without likeness of titles, which SQL can't express."""
    return _bucketed(resolve.resolve(_key_counts(spark, sf), D.references(spark, sf), D.files(spark, sf), titles=False, keys_once=True))


@query
def strip_line_numbers(spark, sf):
    return D.pages(spark, sf).select("doc_id", "page", F.md5(C.strip_line_numbers(F.col("text"))).alias("body"))


@query
def split_sentences(spark, sf):
    return D.sentences(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), "s")


@query
def numeric_markers(spark, sf):
    return D.marked(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), F.posexplode(C.numeric_markers(F.col("t"))).alias("g", "k")).select("doc_id", "i", F.col("g").cast("long").alias("g"), _joined(F.col("k")).alias("keys"))


@query
def authoryear_markers(spark, sf):
    return D.marked(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), F.explode(C.author_year_markers(F.col("t"))).alias("k")).select("doc_id", "i", _joined(F.col("k")).alias("keys"))


@query
def find_markers(spark, sf):
    found = D.marked(spark, sf).select("doc_id", "i", F.posexplode(C.find_markers(F.col("t"))).alias("g", "m"))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), F.col("g").cast("long").alias("g"), F.col("m.pos").cast("long").alias("pos"), _joined(F.col("m.keys")).alias("keys"))


@query
def strip_markers(spark, sf):
    return D.marked(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), C.strip_markers(F.col("t")).alias("claim"))


def _cited(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "id", F.col("page").cast("long").alias("page"), "claim", _joined(F.col("ref_keys")).alias("keys"))


@query
def mine_citations(spark, sf):
    return _cited(mining.mine_pages(D.pages(spark, sf)))


@query
def mine_segments(spark, sf):
    return _cited(mining.mine(layout.clean_pages(D.blocks(spark, sf))))


@query
def layout_fallback(spark, sf):
    """Plain text stands in where layout gives no citation."""
    mined = mining.with_fallback(mining.mine(layout.clean_pages(D.blocks(spark, sf))), mining.mine_pages(D.pages(spark, sf)))
    return mined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("citations"), F.min("id").alias("first_id"), F.sum(F.size("ref_keys")).alias("keys"))


@query
def scope_tag(spark, sf):
    labels = D.table(spark, sf, "labels").selectExpr("doc_id", "CAST(quality + 2 * toxic AS INT) AS i", "CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'non_checkable' END AS kind")
    return mining.tag_scope(mining.mine_pages(D.pages(spark, sf)), labels).select("doc_id", "id", "kind")


@query
def explode_checks(spark, sf):
    return mining.explode_checks(mining.mine_pages(D.pages(spark, sf))).select("doc_id", "id", F.col("key_ord").cast("long").alias("key_ord"), "ref_key")


@query
def page_number_from_name(spark, sf):
    return D.table(spark, sf, "events").select("event_id", C.page_of_name(F.expr("concat(event_type, CASE event_id % 4 WHEN 0 THEN ' pages ' WHEN 1 THEN ' page ' WHEN 2 THEN ' pp. ' ELSE ' pages' END, user_id, '-9')")).alias("page"))


# ---- bibliography


@query
def references_block(spark, sf):
    return D.pages(spark, sf).select("doc_id", "page", F.trim(F.replace(C.references_block(F.col("text")), F.lit("\n"), F.lit(" "))).alias("block"))


@query
def marker_number(spark, sf):
    line = F.explode(F.split("block", "\n")).alias("line")
    return D.blocks_of_entries(spark, sf).select("doc_id", line).groupBy("doc_id").agg(F.sum(C.entry_number(F.col("line"))).alias("total"), F.count(C.entry_number(F.col("line"))).alias("n"))


def _solid(block):
    return F.filter(F.split(block, "\n"), lambda x: ~C.blank(x))


@query
def looks_numbered(spark, sf):
    return D.blocks_of_entries(spark, sf).select("doc_id", C.looks_numbered(_solid(F.col("block"))).alias("numbered"))


def _entries(df: DataFrame, entries) -> DataFrame:
    return df.select("doc_id", F.size(entries).cast("long").alias("n"), F.md5(F.array_join(entries, "\x01")).alias("entries"))


@query
def entries_by_marker(spark, sf):
    return _entries(D.blocks_of_entries(spark, sf), C.entries_by_marker(F.split("block", "\n")))


@query
def entries_by_blankline(spark, sf):
    return _entries(D.blocks_of_entries(spark, sf).where(C.entries_by_blank_line(F.col("block")).isNotNull()), C.entries_by_blank_line(F.col("block")))


@query
def split_entries(spark, sf):
    return _entries(D.blocks_of_entries(spark, sf), C.split_entries(F.col("block")))


@query
def pack_chunks(spark, sf):
    """With a budget of 1000 characters, so that many blocks need several chunks."""
    return _entries(D.blocks_of_entries(spark, sf), C.pack_chunks(F.col("block"), 1000))


def _raw_entries(spark, sf) -> DataFrame:
    entry = "CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE concat(' ', p_partkey % 700) END AS key", "concat(p_name, ' raw') AS raw", f"CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {R.REF_TITLE} END AS title", f"{R.REF_DOI} AS doi"
    return D.table(spark, sf, "part").selectExpr("p_partkey AS ord", *entry, f"CASE WHEN p_partkey % 4 = 0 THEN array() ELSE array({R.REF_AUTHOR}, '', p_brand) END AS authors", "CASE p_partkey % 5 WHEN 0 THEN 'n.d.' WHEN 1 THEN NULL ELSE concat(1990 + p_partkey % 30, 'a') END AS year")


@query
def to_reference(spark, sf):
    return bibliography.to_reference(_raw_entries(spark, sf)).select("ord", "key", "raw", "title", "doi", _joined(F.col("authors")).alias("authors"), "year")


@query
def dedupe_richest(spark, sf):
    return bibliography.dedupe_richest(bibliography.to_reference(_raw_entries(spark, sf))).select("ord", "key", "title", "doi", "year")


@query
def retry_policy(spark, sf):
    events = D.table(spark, sf, "events").selectExpr("event_id", "event_id % 3 AS attempt", f"CAST({R.pick('user_id', ('200', '404', '429', '503', '401', '500'))} AS INT) AS status", "CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'decode' ELSE NULL END AS error")
    return events.select("event_id", bibliography.next_step(F.col("attempt"), F.col("status"), F.col("error")).alias("step"))


# ---- layout


@query
def body_size(spark, sf):
    return layout.body_size(D.blocks(spark, sf))


@query
def drop_margins(spark, sf):
    return layout.drop_margins(D.blocks(spark, sf)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"))


@query
def norm_repeat(spark, sf):
    return D.blocks(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), layout.norm_repeat(F.col("text")).alias("norm"))


@query
def is_page_number(spark, sf):
    return D.blocks(spark, sf).where(layout.is_page_number(F.col("text"))).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")


@query
def classify_block(spark, sf):
    return D.blocks(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), layout.classify(F.col("text"), F.col("size"), F.col("bold"), F.lit(10.0)).alias("kind"))


@query
def order_by_column(spark, sf):
    return layout.ordered(D.blocks(spark, sf)).select("doc_id", "page", F.col("ord").cast("long").alias("ord"), F.col("place").cast("long").alias("place"))


def _segments(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page", F.col("seg_ord").cast("long").alias("seg_ord"), "text")


@query
def page_segments(spark, sf):
    return _segments(layout.segments(layout.ordered(D.blocks(spark, sf)).withColumn("body_size", F.lit(10.0))))


@query
def clean_pages(spark, sf):
    return _segments(layout.clean_pages(D.blocks(spark, sf)))


# ---- resolution


@query
def join_ref_by_key(spark, sf):
    """Of references that share a key, the last counts."""
    refs = resolve.last_by_key(D.references(spark, sf)).select(F.col("key").alias("ref_key"), "title", "year")
    return _key_counts(spark, sf).join(refs, "ref_key", "left").select("ref_key", "title", "year", F.col("n").alias("checks"))


@query
def join_ref_author_year(spark, sf):
    return resolve.references_of_keys(_key_counts(spark, sf), D.references(spark, sf)).select("ref_key", "found_key", F.col("n").alias("checks"))


@query
def unresolved_marker(spark, sf):
    """Counts of a document's keys are written, as they are read for the keys and for the result."""
    counts = written(D.checks(spark, sf).groupBy("doc_id", "ref_key").agg(F.count(F.lit(1)).alias("n")), "keys-of-documents")
    found = resolve.find_references(counts, D.references(spark, sf))
    return found.groupBy("doc_id").agg(F.sum("n").alias("checks"), F.sum(F.when(F.col("found_key").isNull(), F.col("n")).otherwise(0)).alias("unresolved"))


@query
def join_doi_exact(spark, sf):
    return resolve.by_doi(D.references(spark, sf), D.files(spark, sf))


@query
def join_doi_slug_prefix(spark, sf):
    return resolve.by_slug(D.references(spark, sf), D.files(spark, sf))


@query
def match_files(spark, sf):
    """Every reference's file: by DOI, by name, or by title."""
    return resolve.match_files(D.references(spark, sf), D.files(spark, sf))


@query
def match_by_identifier(spark, sf):
    """The same by DOI and name alone, which SQL can express."""
    return resolve.match_files(D.references(spark, sf), D.files(spark, sf), titles=False)


@query
def join_title_fuzzy(spark, sf):
    """Titles of all references against those of all files."""
    refs = D.references(spark, sf)
    gated = resolve.by_title(refs, D.files(spark, sf))
    return refs.select("key").join(gated, "key", "left").select("key", "path", F.coalesce("status", F.lit("no_pdf")).alias("resolution"))


@query
def top2_margin(spark, sf):
    """The gate on given scores."""
    scores = D.table(spark, sf, "events").selectExpr("concat(user_id, '') AS key", "event_id AS path_ord", "concat('f', event_id) AS path", "CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 - CASE WHEN event_id % 40 = 0 THEN 0 ELSE 0.3 END AS score")
    return resolve.gate(scores)


@query
def passage_lookup(spark, sf):
    """Passages of checks, found by check and rank."""
    held = D.audit_checks(spark, sf).where("snippet IS NOT NULL").select("check_id", F.array("snippet", F.concat("snippet", F.lit("more"))).alias("passages"))
    flat = held.select("check_id", F.posexplode("passages").alias("rank", "snippet"))
    asked = D.table(spark, sf, "events").selectExpr("event_id AS check_id", "CAST(event_id % 2 AS INT) AS rank")
    return asked.join(flat, ["check_id", "rank"]).select("check_id", F.col("rank").cast("long").alias("rank"), "snippet")


@query
def source_file_fallback(spark, sf):
    """The file of that name in the folder if there is one, else the stored path."""
    there = D.table(spark, sf, "part").selectExpr("concat('f', p_partkey % 25, '.pdf') AS name").distinct()
    rows = D.audit_checks(spark, sf).where("source_path IS NOT NULL").withColumn("name", F.element_at(F.split("source_path", "/"), -1))
    return rows.join(there.withColumn("here", F.lit(True)), "name", "left").select("check_id", F.when(F.col("here"), F.concat(F.lit("folder/"), "name")).otherwise(F.col("source_path")).alias("path"))


# ---- retrieval and judging


@query
def chunk_text(spark, sf):
    return retrieve.chunks(D.table(spark, sf, "documents")).select(F.col("source_id").alias("doc_id"), F.col("chunk_ord").cast("long").alias("chunk_ord"), F.md5("chunk").alias("chunk"))


@query
def source_index(spark, sf):
    """Chunks of the sources that are cited, once each."""
    cited = D.checks(spark, sf).selectExpr("try_cast(ref_key AS BIGINT) AS source_id").where("source_id IS NOT NULL").distinct()
    return retrieve.chunks(D.table(spark, sf, "documents")).join(cited, "source_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query
def topk_in_source(spark, sf):
    """Every vector as a claim, against the stored index of its label's; the index is built once and serves two batches of claims."""
    vectors = D.table(spark, sf, "embeddings")
    claims = vectors.select(F.col("vec_id").alias("claim_id"), F.col("label").alias("source_id"), F.col("embedding").alias("vector"))
    held = vectors.select(F.col("label").alias("source_id"), F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("vector"))
    stored = index.build_index(held, new_folder(spark, "passage-index"))
    top = index.top_in_source(claims.where("claim_id % 2 = 0"), stored, 4).unionByName(index.top_in_source(claims.where("claim_id % 2 = 1"), stored, 4)).where("claim_id <> chunk_ord")
    return top.select("claim_id", "chunk_ord", "score", F.col("rank").cast("long").alias("rank"))


@query
def evidence_mapping(spark, sf):
    contexts = D.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE concat('key', user_id) END AS dockey", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('Doe', user_id, ' pages ', event_id % 30, '-40') END AS name",
        "props AS text", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) END AS score", "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'summary' END AS context",
    )
    return retrieve.evidence(contexts).select("event_id", "paper_id", "page", "snippet", "score", "rcs_summary")


@query
def parse_verdict(spark, sf):
    raw = D.table(spark, sf, "events").selectExpr("event_id", f"{R.RAW_VERDICT} AS raw")
    return judge.parse_verdicts(raw).drop("raw")


class _Echo:
    """A test double, not a judge: what it answers depends on the claim's length."""

    def complete(self, system: str, user: str) -> str:
        return '{"verdict": "%s", "rationale": "echo", "confidence": 0.5}' % judge.VERDICTS[len(user) % 4]


@query
def judge_claims(spark, sf):
    """Benchmark items as claims with a stand-in for the model; items without a passage never reach it."""
    claims = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("check_id"), F.col("text").alias("claim"), F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("text", 1, 40))).alias("snippets"))
    said = judge.parse_verdicts(judge.judge(claims, _Echo, "Judge the claim.")).select("check_id", "verdict", "rationale", "confidence")
    both = claims.select(F.col("check_id").cast("string").alias("check_id"), F.size("snippets").alias("n")).join(said, "check_id", "left")
    none = F.col("n") == 0
    return both.select("check_id", F.when(none, "not_found").otherwise(F.col("verdict")).alias("verdict"), F.when(none, judge.NO_PASSAGE).otherwise(F.col("rationale")).alias("rationale"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"))


#: Few passages and small bibliography chunks, so that there is something to choose from and several chunks each.
CHECK_SETTINGS = Settings(passages_per_claim=3, bibliography_budget=1000, chunk_chars=400)


def _parts() -> pipeline.Parts:
    return pipeline.Parts(RuleModel, counted, "judge", "references")


@query
def parse_references(spark, sf):
    """The bibliography of every manuscript, by a stand-in for the model."""
    refs = pipeline.parse_references(D.manuscripts(spark, sf), _parts(), CHECK_SETTINGS.bibliography_budget)
    return refs.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "title", "doi", _joined(F.col("authors")).alias("authors"), "year")


@query
def whole_check(spark, sf):
    """Every check of every manuscript from its pages to its bucket, with stand-ins for the model and the embedding."""
    sources = D.cited_sources(spark, sf)
    blocks = spark.createDataFrame([], schemas.BLOCK)
    pages = written(D.manuscripts(spark, sf), "manuscripts")
    out = pipeline.check(pages, blocks, sources.select("path", "path_ord", "doi", "title"), sources.select("path", "text", "error"), CHECK_SETTINGS, _parts())
    discard(pages)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "id", F.col("key_ord").cast("long").alias("key_ord"), "ref_key", "source_path", "bucket", F.col("n_passages").cast("long").alias("passages"), "confidence")


@query
def check_pipeline(spark, sf):
    """Where checks end, given what each step said."""
    rows = D.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 9 = 0 THEN 'non_checkable' ELSE 'empirical' END AS kind", f"{R.pick('event_id', ('resolved', 'resolved', 'resolved', 'no_pdf', 'ambiguous', 'unresolved_marker'))} AS resolution", "event_id % 6 < 3 AND event_id % 17 <> 0 AS has_path",
        "event_id % 13 = 0 AS read_failed", "CAST(event_id % 4 AS INT) AS n", f"{R.pick('user_id', ('supported', 'partially', 'overstated', 'unsupported'))} AS said",
    )
    verdict, outcome = judge.settle(F.col("kind"), F.col("resolution"), F.col("has_path"), F.col("read_failed"), F.col("n"), F.col("said"))
    done = rows.select(verdict.alias("verdict"), outcome.alias("resolution"))
    return audit.coverage(done.withColumn("bucket", judge.bucket(F.col("verdict"), F.col("resolution"))))


def _passages(spark, sf) -> DataFrame:
    docs = D.table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.selectExpr("doc_id AS passage_id", "doc_id AS source_id", "CASE doc_id % 3 WHEN 0 THEN substring(text, 40, 120) WHEN 1 THEN concat('Not there. ', substring(text, 60, 90)) ELSE concat('zq ', substring(text, 1, 20)) END AS snippet", "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE NULL END AS page")


@query
def highlight_spans(spark, sf):
    """The first 1500 characters of a document are page 1, the rest page 2."""
    docs = D.table(spark, sf, "documents")
    pages = docs.selectExpr("doc_id AS source_id", "1 AS page", "substring(text, 1, 1500) AS text").unionByName(docs.selectExpr("doc_id AS source_id", "2 AS page", "substring(text, 1501, length(text)) AS text"))
    return retrieve.highlights(_passages(spark, sf), pages).groupBy("passage_id", "page").agg(F.count(F.lit(1)).alias("spans"), F.sum("start").alias("starts"), F.sum("length").alias("lengths"))


@query
def render_target_page(spark, sf):
    e = D.table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 20 AS INT) END AS hit", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 40 - 4 AS INT) END AS asked", "CAST(1 + event_id % 12 AS INT) AS pages")
    return e.select("event_id", retrieve.target_page(F.col("hit"), F.col("asked"), F.col("pages")).alias("page"))


# ---- acquisition


def _lookups(spark, sf) -> DataFrame:
    a = D.acquisitions(spark, sf)
    by_doi = F.when(F.col("unpaywall").isNotNull(), acquire.unpaywall(F.col("http_status"), F.col("unpaywall")))
    by_title = F.when(F.col("openalex").isNotNull(), acquire.openalex(F.col("openalex")))
    return a.select("key", "doi", "title", "download_ok", "present", by_doi.alias("by_doi"), by_title.alias("by_title")).withColumn("found", acquire.locate(F.col("by_doi"), F.col("by_title")))


def _acquired(spark, sf) -> DataFrame:
    """Answers are read once and written: files, lookups and downloads are all parts of their rows."""
    rows = written(_lookups(spark, sf).select("key", "doi", "present", "download_ok", "found"), "lookups")
    files = rows.where("present").select(I.pdf_name(F.col("doi"), F.col("key")).alias("name"), F.lit(True).alias("valid"))
    downloads = rows.where("found.pdf_url IS NOT NULL").select(F.col("found.pdf_url").alias("url"), F.col("download_ok").alias("ok")).distinct()
    return acquire.classify(rows.select("key", "doi"), files, rows.select("key", "found.status", "found.pdf_url"), downloads)


@query
def oa_response(spark, sf):
    return _lookups(spark, sf).select("key", F.col("by_doi.status").alias("unpaywall"), F.col("by_title.status").alias("openalex"), F.col("found.status").alias("status"), F.col("found.pdf_url").alias("pdf_url"))


@query
def classify_acquisition(spark, sf):
    return _acquired(spark, sf).select("ref_key", "status", "source_url", "detail")


@query
def lookup_cache(spark, sf):
    """How often three runs ask for each key: half of the keys on the first day, all of them a week later and once more the day after; one lookup in nine fails."""
    path = new_folder(spark, "answers")
    rows = written(_lookups(spark, sf).select("key", F.split("key", " ")[1].cast("long").alias("n"), "found.status", "found.pdf_url"), "lookups")
    answer = lambda due: due.join(rows, "key").select("key", F.when(F.col("n") % 9 != 0, F.col("status")).alias("status"), "pdf_url")
    for day, wanted in (("2024-01-01", rows.where("n % 2 = 0")), ("2024-01-08", rows), ("2024-01-09", rows)):
        acquire.ask_and_keep(wanted, answer, path, F.lit(day).cast("date"))
    return spark.read.parquet(path).groupBy("key").agg(F.count(F.lit(1)).alias("asked"))


@query
def existing_files(spark, sf):
    """Wanted names that are there, whatever their case, and hold a PDF."""
    a = D.acquisitions(spark, sf).select("key", I.pdf_name(F.col("doi"), F.col("key")).alias("name"), "present", "download_ok")
    there = a.where("present AND download_ok").select(F.lower(F.upper("name")).alias("there"))
    return a.join(there, F.lower("name") == F.col("there"), "left_semi").select("key", "name")


@query
def pdf_names(spark, sf):
    return D.acquisitions(spark, sf).select("key", I.pdf_name(F.col("doi"), F.col("key")).alias("name"))


@query
def acquisition_summary(spark, sf):
    return acquire.summary(_acquired(spark, sf))


@query
def missing_count(spark, sf):
    return _acquired(spark, sf).agg(F.count_if(F.col("status").isin("paywalled", "not_found", "error")).alias("missing"))


@query
def acquisition_order(spark, sf):
    a = _acquired(spark, sf)
    place = F.row_number().over(W.partitionBy("status").orderBy("ref_key"))
    return a.select("ref_key", "status", audit.rank(F.col("status"), audit.ACQUISITION_ORDER).cast("long").alias("rank"), audit.rank(F.col("status"), audit.ACQUISITION_ORDER[:3], 9).cast("long").alias("api_rank"), place.cast("long").alias("place"))


@query
def acquisition_manifest(spark, sf):
    a = _acquired(spark, sf).join(D.acquisitions(spark, sf).select(F.col("key").alias("ref_key"), "title", "doi").hint("merge"), "ref_key").withColumn("pdf_path", F.concat(F.lit("refs/"), "name")).withColumn("ord", F.col("ref_key"))
    return report.acquisition_lines(a).select("section", F.col("rank").cast("long").alias("rank"), "ord", "line")


# ---- audit and reports


@query
def display_status(spark, sf):
    e = D.table(spark, sf, "events").selectExpr("event_id", f"CASE WHEN event_id % 4 = 0 THEN {R.pick('user_id', R.OVERRIDES)} WHEN event_id % 4 = 1 THEN '' ELSE NULL END AS o", f"{R.pick('event_id', ('unchecked', 'supported', 'unsupported'))} AS v", f"{R.pick('user_id', ('resolved', 'no_pdf'))} AS r")
    return e.select("event_id", audit.display_status(F.col("o"), F.col("v"), F.col("r")).alias("status"))


@query
def override_fold(spark, sf):
    return audit.fold_overrides(D.overrides(spark, sf))


@query
def problems_first(spark, sf):
    """Place of each check in its manuscript's list, problems first."""
    c = D.audit_checks(spark, sf).withColumn("rank", audit.rank(F.col("status")))
    place = F.row_number().over(W.partitionBy("manuscript").orderBy("rank", "check_id"))
    return c.select("manuscript", "check_id", F.col("rank").cast("long").alias("rank"), place.cast("long").alias("place"))


@query
def manuscript_order(spark, sf):
    """By page, then id; checks without a page last."""
    c = D.audit_checks(spark, sf).withColumn("page", F.expr("CASE WHEN check_id % 6 = 0 THEN NULL ELSE CAST(check_id % 17 AS INT) END"))
    place = F.row_number().over(W.partitionBy("manuscript").orderBy(F.col("page").asc_nulls_last(), "check_id"))
    return c.select("manuscript", "check_id", place.cast("long").alias("place"))


@query
def queue_search(spark, sf):
    found = audit.queue(D.audit_checks(spark, sf), preset="problems", section="Results", text="Claim 4")
    return found.select("check_id", "status")


@query
def queue_unreviewed(spark, sf):
    return audit.queue(D.audit_checks(spark, sf), preset="unreviewed", statuses=("ambiguous", "no_pdf")).select("check_id", "status")


@query
def status_counts(spark, sf):
    return audit.status_counts(D.audit_checks(spark, sf)).select("status", "n", F.col("rank").cast("long").alias("rank"))


@query
def coverage_share(spark, sf):
    return audit.shares(audit.coverage(D.audit_checks(spark, sf).withColumn("bucket", F.col("status")))).select("bucket", "n", "share", F.col("rank").cast("long").alias("rank"))


@query
def reviewed_progress(spark, sf):
    return audit.progress(D.audit_checks(spark, sf))


@query
def distinct_sections(spark, sf):
    return D.audit_checks(spark, sf).where("section <> ''").select("section").distinct()


@query
def next_unreviewed(spark, sf):
    return audit.neighbours(D.audit_checks(spark, sf), "manuscript", "check_id").select("check_id", "previous", "following", "next_unreviewed")


@query
def row_view(spark, sf):
    """What the audit list shows of a check."""
    c = D.audit_checks(spark, sf).withColumn("passages", F.when(F.col("snippet").isNotNull(), F.array(F.struct(F.concat(F.lit("p"), "check_id").alias("id"), F.lit(3).alias("page")))).otherwise(F.array().cast("array<struct<id:string,page:int>>")))
    first = F.get("passages", F.lit(0))
    return c.select("check_id", "status", "claim", "reviewed", first["id"].alias("passage_id"), first["page"].alias("passage_page"), F.size("passages").cast("long").alias("passages"))


@query
def citations_report(spark, sf):
    c = D.audit_checks(spark, sf).withColumn("ord", F.col("check_id"))
    return report.citation_lines(c).select(F.col("rank").cast("long").alias("rank"), "ord", "lines")


# ---- scalars and guard


@query
def norm_doi(spark, sf):
    return D.files(spark, sf).where("doi IS NOT NULL").select("path", I.norm_doi(F.col("doi")).alias("doi"), I.slug(I.norm_doi(F.col("doi"))).alias("slug"))


@query
def first_doi(spark, sf):
    """DOI and title found in a file's text."""
    rows = D.table(spark, sf, "documents").selectExpr("doc_id", "concat('see doi 10.', 1000 + doc_id % 9000, '/x', doc_id, chr(10), coalesce(text, '')) AS text", "CASE doc_id % 4 WHEN 0 THEN 'Microsoft Word - draft' WHEN 1 THEN ' A fine long title ' WHEN 2 THEN 'short' ELSE NULL END AS title")
    return rows.select("doc_id", I.first_doi(F.col("text")).alias("doi"), I.document_title(F.col("title"), F.col("text")).alias("title"))


@query
def safe_id(spark, sf):
    return D.table(spark, sf, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN '..' WHEN 1 THEN url WHEN 2 THEN concat('a.b_', page_id) ELSE '.' END AS name").select("page_id", I.is_safe_id(F.col("name")).alias("safe"))


@query
def local_host(spark, sf):
    rows = D.table(spark, sf, "pages").selectExpr("page_id", f"{R.ADDRESS} AS base")
    return rows.select("page_id", "base", I.url_host(F.col("base")).alias("host"), I.is_local_host(F.col("base")).alias("is_local"))


@query
def local_model(spark, sf):
    rows = D.table(spark, sf, "events").selectExpr("event_id", f"{R.pick('event_id', ('ollama/qwen', 'ST-mini', 'gpt', 'anthropic', 'xollama/a'))} AS model")
    return rows.select("event_id", I.is_local_model(F.col("model")).alias("is_local"))


@query
def pdf_magic(spark, sf):
    """Downloads that are held to be PDFs: their first bytes and size."""
    rows = D.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN concat('%PDF-1.7', text) ELSE text END AS text", "n_chars * 20000 AS size")
    return rows.where(acquire.is_pdf(F.encode("text", "UTF-8"), F.col("size"))).select("doc_id")


# ---- files: written from the tables, and read as a folder of them


def _through_files(spark, sf, docs: DataFrame, label: str, read: Callable[[str], DataFrame]) -> DataFrame:
    return D.through_files(docs, D.table(spark, sf, "documents").count(), label, read)


@query
def text_scan(spark, sf):
    """Pages of folders of text files; a file's pages are parted by form feeds."""
    docs = D.table(spark, sf, "documents").where("text IS NOT NULL").selectExpr("doc_id", "concat(substr(text, 1, 1000), chr(12), substr(text, 1001)) AS text")

    def read(path: str) -> DataFrame:
        files = readers.text_folder(spark, path).select(D.document_of(F.col("path")).alias("doc_id"), "text")
        return readers.text_pages(files).select("doc_id", F.col("page").cast("long").alias("page"), F.md5("text").alias("text"))

    return _through_files(spark, sf, docs, "text-files", read)


@query
def layout_scan(spark, sf):
    """Layout blocks of folders of files, by a decoder that stands in for that of PDFs; one document in eleven can't be decoded."""
    docs = D.page_dicts(spark, sf).withColumn("text", F.when(F.col("doc_id") % 11 == 10, F.substring("text", F.lit(1), F.length("text") - 3)).otherwise(F.col("text")))

    def read(path: str) -> DataFrame:
        found = readers.pdf_blocks(readers.pdf_folder(spark, path, names="*.txt"), json_pages)
        return found.select(D.document_of(F.col("doc_id")).alias("doc_id"), F.col("page").cast("long").alias("page"), "x0", "y0", "x1", "size", "bold", F.md5("text").alias("text"))

    return _through_files(spark, sf, docs, "layout-files", read)


@query
def refs_folder(spark, sf):
    """Files of folders that are PDFs by their first bytes and small enough; larger ones aren't opened."""
    docs = D.table(spark, sf, "documents").where("text IS NOT NULL").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN concat('%PDF-1.7', text) ELSE text END AS text")
    return _through_files(spark, sf, docs, "refs-files", lambda path: readers.bounded_pdfs(spark, path, 2000, "*.txt").select(D.document_of(F.col("path")).alias("doc_id"), "length"))


@query
def report_round_trip(spark, sf):
    """Reports of all manuscripts written as nested JSON and read back by one schema; one line in nine is cut off, and told apart."""
    checks = D.audit_checks(spark, sf)
    citation = F.struct(F.concat(F.lit("c"), "check_id").alias("id"), "claim", F.array("ref_key").alias("ref_keys"), "section", F.lit(1).alias("manuscript_page"), F.lit("empirical").alias("kind"))
    passages = F.when(F.col("snippet").isNotNull(), F.array(F.struct(F.concat(F.lit("p"), "check_id").alias("id"), "snippet", F.lit(0.5).alias("score"))))
    row = F.struct("check_id", citation.alias("citation"), "ref_key", F.col("source_path").alias("source_pdf"), passages.alias("passages"), F.col("status").alias("verdict"), "rationale", "reviewed", "note")
    nested = checks.groupBy(F.col("manuscript").cast("string").alias("manuscript")).agg(F.array_sort(F.collect_list(row)).alias("checks"), F.count(F.lit(1)).cast("int").alias("n"))
    reports = nested.select("manuscript", "checks", F.create_map(F.lit("checks"), "n").alias("coverage"))
    path = new_folder(spark, "reports")
    line = F.to_json(F.struct(*reports.columns))
    reports.select(F.when(F.col("manuscript").cast("long") % 9 == 4, F.left(line, F.length(line) - 5)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.report_lines(spark, path)
    c = readers.checks_of(good)
    read = c.groupBy("manuscript").agg(F.count(F.lit(1)).alias("checks"), F.count_if("reviewed").alias("reviewed"), F.sum(F.length("citation.claim")).cast("long").alias("chars"), F.count("source_pdf").alias("sources"), F.sum(F.coalesce(F.size("passages"), F.lit(0))).cast("long").alias("passages"))
    unread = bad.select(F.regexp_extract("line", '"manuscript":"([^"]*)"', 1).alias("manuscript"), *[F.lit(None).cast("long").alias(x) for x in ("checks", "reviewed", "chars", "sources", "passages")])
    return read.unionByName(unread).select(F.col("manuscript").cast("long").alias("manuscript"), "checks", "reviewed", "chars", "sources", "passages", F.col("checks").isNotNull().alias("readable"))


# ---- what a reviewer is shown


@query
def passage_text(spark, sf):
    """Documents as flowing text; every space of their words is a line end after a hyphen, in some."""
    rows = D.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e ', 'e-\n ') ELSE text END AS text")
    return rows.select("doc_id", F.md5(display.flowing(F.col("text"))).alias("text"))


@query
def highlight_colour(spark, sf):
    return D.audit_checks(spark, sf).select("check_id", "status", F.array_join(F.transform(display.colour(F.col("status")), lambda x: F.format_string("%.2f", x)), " ").alias("colour"))


@query
def reference_card(spark, sf):
    refs = _raw_entries(spark, sf).selectExpr("ord", "title", "raw", "filter(authors, a -> a <> '') AS authors", "try_cast(year AS int) AS year")
    card = display.reference_line(F.col("title"), F.when(F.col("ord") % 6 == 0, F.lit("")).otherwise(F.col("raw")), F.col("authors"), F.col("year"))
    return refs.select("ord", card.alias("c")).select("ord", "c.title", "c.line")


@query
def passage_neighbours(spark, sf):
    rows = D.table(spark, sf, "events").selectExpr("event_id", "CAST(event_id % 5 AS INT) AS n", "CAST(user_id % 5 AS INT) AS i").where("i < greatest(n, 1)")
    moves = display.passage_neighbours(F.col("i"), F.slice(F.array(*map(F.lit, range(5))), F.lit(1), F.col("n")))
    return rows.select("event_id", moves.alias("m")).select("event_id", F.col("m.previous").cast("long").alias("previous"), F.col("m.following").cast("long").alias("following"))


def _headed(spark, sf) -> DataFrame:
    """Checks whose claims are documents' words, in four languages."""
    return D.table(spark, sf, "documents").where("text IS NOT NULL").selectExpr("doc_id AS check_id", "lang", f"{R.pick('doc_id', R.STATUSES)} AS status", "regexp_replace(substr(text, 1, 60), '[^\\\\p{L} ]', '') AS claim")


@query
def reading_order(spark, sf):
    """Problems first, then by letters as readers order them."""
    return display.in_reading_order(_headed(spark, sf), "lang", "claim").select("check_id", "lang", "place")


@query
def search_any_case(spark, sf):
    return display.holding(_headed(spark, sf), "claim", "Ä").select("check_id")
