"""How citation inputs are derived from the driver's tables, which hold none.

Each recipe is an expression that Spark and DuckDB read alike, so that both sides of a comparison start from the same rows.
"""

from __future__ import annotations

SURNAMES = ("Smith", "Jones", "Garcia", "Chen", "Okafor", "Novak", "Silva", "Meyer", "Dubois", "Rossi")
OVERRIDES = ("supported", "partially", "overstated", "unsupported", "not_found", "not_a_claim", "unchecked", "bogus")
STATUSES = ("unsupported", "overstated", "not_found", "partially", "supported", "ambiguous", "no_pdf", "unresolved_marker", "unreadable_source", "not_a_claim", "unchecked", "strange")


def pick(n: str, values: tuple[str, ...]) -> str:
    """The value at n modulo their number."""
    return f"CASE CAST({n} AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_N = "((7 * doc_id + 3 * i) % 60)"
_PERSON = pick(f"{_N}", SURNAMES)
_OTHER = pick(f"{_N} + 3", SURNAMES)

#: A sentence s, number i of document doc_id, with a marker before its full stop: single, range (some reversed or too wide), list, authors, none.
MARKED = f"""concat(regexp_replace(s, '[.]+$', ''), CASE CAST(doc_id + i AS BIGINT) % 5
  WHEN 0 THEN concat(' [', {_N}, ']')
  WHEN 1 THEN concat(' [', {_N}, '–', {_N} + CASE WHEN i % 11 = 0 THEN 120 ELSE (i % 4) - 1 END, ']')
  WHEN 2 THEN concat(' [', {_N}, ', ', {_N} + 7, ' - ', {_N} + 9, ']')
  WHEN 3 THEN concat(' (', {_PERSON}, ' et al., ', 1990 + {_N} % 30, '; ', {_OTHER}, ', ', 1990 + ({_N} + 5) % 30, 'b)')
  ELSE ' (n = 2000)' END, '.')"""

#: Page of a sentence; what stands before and after a page's sentences.
PAGE = "CAST(floor(i / 20) AS BIGINT) + 1"
PAGE_TOP = "concat(page * 7 % 9999, chr(10))"
PAGE_END = "CASE WHEN doc_id % 3 = 0 AND page = 2 THEN concat(chr(10), 'References', chr(10), '[1] Alpha 2001', chr(10), 'Beta') ELSE '' END"

#: Bibliography from part: number, title, year, first author, DOI (some missing, some with a double underscore).
REF_KEY = "concat(p_partkey, '')"
REF_TITLE = "concat(p_name, ' ', p_type, ' ', p_brand)"
REF_YEAR = "CAST(1990 + p_partkey % 30 AS INT)"
REF_AUTHOR = f"concat({pick('p_partkey', SURNAMES)}, ' A.')"
REF_DOI = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('10.', 1000 + p_size, '/p.', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '__x' ELSE '' END) END"
#: Files: one part in four has none; names by DOI slug, or a plain name with the DOI, a variant title, or nothing known inside.
FILE_DOI = f"CASE WHEN p_partkey % 4 = 1 AND p_partkey % 7 <> 0 THEN concat('https://doi.org/', upper({REF_DOI}), '.') ELSE NULL END"
FILE_TITLE = f"CASE WHEN p_partkey % 4 IN (1, 2) THEN concat(upper({REF_TITLE}), ' v2') ELSE NULL END"

#: Layout blocks from the lines of documents (doc_id, ord, line): running heads, page numbers, captions, headings, mathematics, markers.
BLOCK_PAGE = "CAST(floor(ord / 20) AS BIGINT) + 1"
BLOCK_TEXT = """CASE WHEN doc_id % 4 = 0 AND ord = 33 THEN 'References'
  ELSE CASE CAST(ord % 20 AS BIGINT) WHEN 0 THEN concat('Journal of Tests ', doc_id % 7) WHEN 19 THEN concat('Page ', CAST(floor(ord / 20) AS BIGINT) + 1, ' of 9')
  WHEN 5 THEN concat('Figure ', ord, '. ', line) WHEN 7 THEN '2.1 Methods' WHEN 9 THEN 'x = 1 + 2 ± 3' WHEN 11 THEN 'RESULTS AND DATA'
  WHEN 14 THEN concat(line, ' [3]') WHEN 16 THEN '' ELSE line END END"""
BLOCK_X0 = "CASE WHEN doc_id % 2 = 0 OR ord % 20 < 9 THEN 50.0 ELSE 310.0 END"
BLOCK_X1 = "CASE WHEN doc_id % 2 = 0 THEN 550.0 WHEN ord % 20 < 9 THEN 290.0 ELSE 550.0 END"
BLOCK_Y0 = "CAST(ord % 20 * 40 AS DOUBLE)"
BLOCK_SIZE = "CASE WHEN ord % 20 = 13 THEN 14.0 ELSE 10.0 + (length(line) % 2) * 0.5 END"
BLOCK_BOLD = "ord % 20 = 15"

#: Overrides from events: one per event, some void, some clearing.
OVERRIDE = {
    "check_id": "user_id",
    "seq": "event_id",
    "verdict": f"CASE WHEN event_id % 9 = 8 THEN NULL ELSE {pick('event_id % 9', OVERRIDES)} END",
    "clear": "event_id % 11 = 0",
    "reviewed": "CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "note": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('note ', event_id % 5) END",
}
#: Model answers from events: good, fenced, broken, wrong kind, unknown verdict, confidence as text, out of range, with a tail.
RAW_VERDICT = """CASE CAST(event_id AS BIGINT) % 8
  WHEN 0 THEN concat('{"verdict": "supported", "rationale": "as stated ', event_id, '", "confidence": 0.5}')
  WHEN 1 THEN concat('Here: ```json', chr(10), '{"verdict": "partially", "rationale": "in part", "confidence": 0.25}', chr(10), '```')
  WHEN 2 THEN concat('no answer ', event_type)
  WHEN 3 THEN '["supported"]'
  WHEN 4 THEN '{"verdict": "certain", "rationale": null, "confidence": 0.75}'
  WHEN 5 THEN '{"verdict": "overstated", "rationale": "too strong", "confidence": "0.8"}'
  WHEN 6 THEN '{"verdict": "unsupported", "confidence": 7}'
  ELSE '{"verdict": "supported"} and more' END"""
#: Checks with statuses, sections and review marks from events.
CHECK = {
    "check_id": "event_id",
    "manuscript": "user_id",
    "status": pick("event_id * 5 + user_id", STATUSES),
    "reviewed": "event_id % 3 = 0",
    "section": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Methods' ELSE 'Results' END",
    "claim": "concat('Claim ', event_id % 97, ' on ', event_type)",
    "ref_key": "concat(event_id % 60, '')",
    "title": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Title ', event_id % 13) END",
    "rationale": "CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('because ', event_id % 8) END",
    "snippet": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat(' passage ', event_id % 19, ' ') END",
    "note": "CASE WHEN event_id % 7 = 0 THEN 'look again' ELSE '' END",
    "source_path": "CASE WHEN event_id % 3 = 1 THEN NULL ELSE concat('refs/sub/f', event_id % 40, '.pdf') END",
}
#: References to acquire from orders, with the answers of both lookups.
ACQ = {
    "key": "concat('k ', o_orderkey)",
    "doi": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('https://doi.org/10.5000/O.', o_orderkey) END",
    "title": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Order ', o_orderkey) END",
    "http_status": "CASE WHEN o_orderkey % 6 = 0 THEN 404 ELSE 200 END",
    "unpaywall": """CASE CAST(o_orderkey AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('{"is_oa": true, "best_oa_location": {"url_for_pdf": "https://x.example/', o_orderkey, '.pdf"}}')
      WHEN 2 THEN '{"is_oa": false}' WHEN 3 THEN '<html>busy</html>' ELSE '{"is_oa": true, "best_oa_location": {"url": "https://landing.example"}}' END""",
    "openalex": """CASE CAST(o_orderkey AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"results": []}'
      WHEN 2 THEN concat('{"results": [{"open_access": {"is_oa": true, "oa_url": "https://y.example/', o_orderkey, '.PDF"}}]}')
      ELSE '{"results": [{"open_access": {"is_oa": true, "oa_url": "https://y.example/page"}}]}' END""",
    "download_ok": "o_orderkey % 3 <> 0",
    "present": "o_orderkey % 10 = 7",
}
#: Addresses from pages, with the ways to look local without being it.
ADDRESS = """CASE CAST(page_id AS BIGINT) % 14 WHEN 0 THEN 'http://127.0.0.1:11434' WHEN 1 THEN concat('http://user:pw@public', page_id, '.example.com/x')
  WHEN 2 THEN 'http://[::1]:80/' WHEN 3 THEN 'http://[2001:db8::1]/' WHEN 4 THEN '10.evil.example' WHEN 5 THEN 'http://192.168.1.5' WHEN 6 THEN 'box'
  WHEN 7 THEN '' WHEN 8 THEN 'http://172.20.1.1' WHEN 9 THEN 'http://100.70.1.1' WHEN 10 THEN '100.200.1.1' WHEN 11 THEN 'Printer.LOCAL:631' WHEN 12 THEN '172.32.0.1' ELSE url END"""


def columns(recipe: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in recipe.items()]

#: The whole check: entry k of document d's bibliography names source (7 d + 13 k) modulo 500, by a DOI; a source is the document of that number.
ENTRIES = 60
CITED = "(7 * doc_id + 13 * k) % 500"
BIB_LINE = "concat('[', k, '] ', " + pick("k", SURNAMES) + f", ' A. (', 1990 + k % 30, ') Study of matter ', {CITED}, '. 10.1234/s.', {CITED})"
#: One source in four has no file, and one file in ten can't be read.
SOURCE_FILE = "doc_id < 500 AND doc_id % 4 <> 3"
SOURCE_PATH = "concat('refs/10.1234_s.', doc_id, '__x.pdf')"
SOURCE_ERROR = "CASE WHEN doc_id % 10 = 9 THEN 'ValueError: no text layer' ELSE NULL END"
#: Entries that the stand-in for a model gives no readable answer for.
UNREAD_ENTRY = "k % 17 = 5"
#: What the stand-in for an embedding counts in a text.
COUNTED = ("e", "a", "n", " ")
