"""DuckDB SQL that gives what the registered queries give, on the same tables."""

from __future__ import annotations

from ..functions.citations import AUTHOR_YEAR, NUMERIC, SURNAME_YEAR
from ..operators import acquire, audit, display, judge
from . import recipes as R


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


NUM, AY, SY = quoted(NUMERIC), quoted(AUTHOR_YEAR), quoted(SURNAME_YEAR)
EITHER = quoted(f"{NUMERIC}|{AUTHOR_YEAR}")
HEADING = quoted(r"(?im)^\s*(?:references|bibliography|works cited|literature cited)\s*:?\s*$")
BLANK = r"regexp_full_match({0}, '\s*')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def cut(x: str) -> str:
    """Sentences of a text: RE2 has no look-around, so a sentinel goes where a sentence ends."""
    flat = strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")
    return rf"""[trim(p) FOR p IN string_split(regexp_replace({flat}, '([.!?])\s+(["''(\[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) IF trim(p) <> '']"""


def number_keys(inside: str) -> str:
    a, b = (rf"TRY_CAST(regexp_extract(p, '^\s*(\d+)\s*[–-]\s*(\d+)\s*$', {g}) AS BIGINT)" for g in (1, 2))
    return rf"""flatten([CASE WHEN {b} >= {a} AND {b} - {a} < 100 THEN [CAST(n AS VARCHAR) FOR n IN range({a}, {b} + 1)]
      WHEN regexp_full_match(trim(p), '\d+') THEN [trim(p)] ELSE CAST([] AS VARCHAR[]) END FOR p IN string_split({inside}, ',')])"""


def author_keys(inside: str) -> str:
    return f"[regexp_extract(p, {SY}, 1) || ' ' || regexp_extract(p, {SY}, 2) FOR p IN string_split({inside}, ';') IF regexp_matches(p, {SY})]"


def marker_keys(m: str) -> str:
    return f"CASE WHEN starts_with({m}, '[') THEN {number_keys(f'regexp_extract({m}, {NUM}, 1)')} ELSE {author_keys(f'regexp_extract({m}, {AY}, 1)')} END"


def bare(x: str) -> str:
    gone = f"regexp_replace(regexp_replace({x}, {NUM}, '', 'g'), {AY}, '', 'g')"
    return strip(rf"regexp_replace(regexp_replace({gone}, '\s+([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g')")


def rows(source: str, keep: str, array: str, value: str, at: str) -> str:
    """One row for each element of an array, with its index from 0."""
    return f"SELECT {keep}, unnest({array}) AS {value}, generate_subscripts({array}, 1) - 1 AS {at} FROM {source}"


def rank(x: str, order: tuple[str, ...] = audit.ORDER, unknown: int = 99) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + f" ELSE {unknown} END"


def among(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


SENT = f"sent AS (SELECT doc_id, s, i FROM ({rows('documents', 'doc_id', cut('text'), 's', 'i')}))"
MARKED = f"{SENT}, marked AS (SELECT doc_id, i, {R.MARKED} AS t FROM sent)"
PAGES = f"""{MARKED}, grouped AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY i) AS body FROM (SELECT doc_id, {R.PAGE} AS page, i, t FROM marked) GROUP BY ALL),
pages_of AS (SELECT doc_id, page, concat({R.PAGE_TOP}, body, {R.PAGE_END}) AS text FROM grouped)"""
NO_NUMBERS = r"array_to_string([l FOR l IN string_split({0}, chr(10)) IF NOT regexp_full_match(l, '\s*\d{{1,4}}\s*')], chr(10))"


def groups(source: str, keep: str, text: str) -> str:
    """Markers of a text that give keys: m, its number among them g, keys."""
    found = rows(source, f"{keep}, {text} AS whole", f"regexp_extract_all({text}, {EITHER})", "m", "g0")
    return f"SELECT *, row_number() OVER (PARTITION BY {keep} ORDER BY g0) - 1 AS g FROM (SELECT *, {marker_keys('m')} AS keys FROM ({found})) WHERE len(keys) > 0"


GROUPS = f"{MARKED}, grp AS ({groups('marked', 'doc_id, i', 't')})"
CHECKS = f"{GROUPS}, chk AS (SELECT doc_id, i, g, ref_key, key_ord FROM ({rows('grp', 'doc_id, i, g', 'keys', 'ref_key', 'key_ord')}))"


def mined(parts: str) -> str:
    """Citations of parts (doc_id, page, seg_ord, text)."""
    sentences = rows(parts, "doc_id, page, seg_ord", cut(NO_NUMBERS.format("text")), "sentence", "sent_ord")
    return f"""SELECT *, 'c' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, seg_ord, sent_ord, g) AS VARCHAR), 4, '0') AS id, {bare('whole')} AS claim
      FROM ({groups(f'({sentences})', 'doc_id, page, seg_ord, sent_ord', 'sentence')})"""


BODY = f"""body AS (SELECT doc_id, page, 0 AS seg_ord, regexp_split_to_array(text, {HEADING})[1] AS text FROM (
  SELECT *, min(CASE WHEN regexp_matches(text, {HEADING}) THEN page END) OVER (PARTITION BY doc_id) AS last FROM pages_of) WHERE last IS NULL OR page <= last)"""
MINED = f"{PAGES}, {BODY}, cit AS ({mined('body')})"

BLOCKS = f"""lines AS ({rows('documents', 'doc_id', 'string_split(text, chr(10))', 'line', 'ord')}),
blk AS (SELECT doc_id, {R.BLOCK_PAGE} AS page, ord, {R.BLOCK_TEXT} AS text, CAST({R.BLOCK_X0} AS DOUBLE) AS x0, {R.BLOCK_Y0} AS y0, CAST({R.BLOCK_X1} AS DOUBLE) AS x1,
  {R.BLOCK_Y0} + 10 AS y1, CAST({R.BLOCK_SIZE} AS DOUBLE) AS size, {R.BLOCK_BOLD} AS bold, 800.0::DOUBLE AS page_height FROM lines)"""
NORM = r"array_to_string([CASE WHEN regexp_full_match(w, '\d+') THEN '#' ELSE w END FOR w IN string_split(lower({0}), ' ')], ' ')".format(strip("text"))
PAGENO = rf"regexp_matches({strip('text')}, '(?i)^(?:\d{{1,4}}|[ivxlcdm]+|(?:page\s+)?\d{{1,4}}(?:\s+of\s+\d{{1,4}})?)$')"
MARGIN = "((y0 + y1) / 2 < 0.08 * page_height OR (y0 + y1) / 2 > 0.92 * page_height)"


def body_size(source: str) -> str:
    return f"""SELECT doc_id, body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) AS r FROM (
      SELECT doc_id, round(size, 1) AS body_size, sum(length({strip('text')})) AS chars, min(page * 1048576 + ord) AS first FROM {source} WHERE {strip('text')} <> '' GROUP BY ALL)) WHERE r = 1"""


def kept(source: str) -> str:
    return f"""SELECT * EXCLUDE (norm, margin) FROM (SELECT *, {NORM} AS norm, {MARGIN} AND {strip('text')} <> '' AS margin FROM {source}) b
      WHERE NOT (margin AND ({PAGENO} OR (doc_id, norm) IN (SELECT (doc_id, norm) FROM (SELECT doc_id, {NORM} AS norm, page FROM {source} WHERE {MARGIN} AND {strip('text')} <> '') GROUP BY doc_id, norm HAVING count(DISTINCT page) > 1)))"""


def kind(body: str) -> str:
    t = strip("text")
    letters = rf"length(regexp_replace({t}, '[^\p{{L}}]', '', 'g'))"
    return rf"""CASE WHEN {t} = '' OR regexp_matches(text, {EITHER}) THEN 'body'
      WHEN regexp_matches({t}, '(?i)^\s*(?:figure|fig|table|tbl|scheme)\s*\d+\s*[.:]') THEN 'caption'
      WHEN length({t}) <= 100 AND NOT contains({t}, chr(10)) AND NOT regexp_matches({t}, '[.!?]$') AND (regexp_matches({t}, '^\d+(?:\.\d+)*\.?\s+[A-Z]') OR bold OR ({body} > 0 AND size > {body} * 1.15)
        OR ({letters} > 0 AND upper({t}) = {t} AND (regexp_matches({t}, '\S\s+\S') OR {letters} >= 6))) THEN 'heading'
      WHEN length({t}) <= 100 AND NOT contains({t}, chr(10)) AND regexp_matches({t}, '[=∑∫√±×÷≈≤≥∝]') AND {letters} / length({t}) < 0.5 THEN 'equation' ELSE 'body' END"""


def placed(source: str) -> str:
    p = "PARTITION BY doc_id, page"
    return f"""SELECT * EXCLUDE (cx, before, gutter, gap, two), row_number() OVER ({p} ORDER BY CASE WHEN coalesce(two, false) AND cx >= gutter THEN 1 ELSE 0 END, y0, x0, ord) AS place FROM (
      SELECT *, gap > 0.15 * (max(x1) OVER ({p}) - min(x0) OVER ({p})) AND sum(CASE WHEN cx < gutter THEN 1 ELSE 0 END) OVER ({p}) >= 2 AND sum(CASE WHEN cx >= gutter THEN 1 ELSE 0 END) OVER ({p}) >= 2
        AND max(CASE WHEN cx < gutter THEN x1 END) OVER ({p}) <= gutter + 1 AND min(CASE WHEN cx >= gutter THEN x0 END) OVER ({p}) >= gutter - 1
        AND max(CASE WHEN x0 < gutter AND x1 > gutter THEN 1 ELSE 0 END) OVER ({p}) = 0 AS two
      FROM (SELECT *, max(cx - before) OVER ({p}) AS gap, first_value((cx + before) / 2) OVER ({p} ORDER BY cx - before DESC NULLS LAST, cx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gutter
        FROM (SELECT *, (x0 + x1) / 2 AS cx, lag((x0 + x1) / 2) OVER ({p} ORDER BY (x0 + x1) / 2, ord) AS before FROM {source})))"""


def segments(source: str, body: str) -> str:
    return f"""SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY island) - 1 AS seg_ord, text FROM (
      SELECT doc_id, page, island, string_agg({strip('text')}, ' ' ORDER BY place) AS text FROM (
        SELECT *, sum(CASE WHEN kind <> 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY place) AS island FROM (SELECT *, {kind(body)} AS kind FROM {source}))
      WHERE kind = 'body' AND {strip('text')} <> '' GROUP BY ALL)"""


CLEAN = f"""{BLOCKS}, kpt AS ({kept('blk')}), plc AS ({placed('kpt')}),
pre AS (SELECT * FROM (SELECT *, max(CASE WHEN regexp_matches(text, {HEADING}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, place) AS past FROM plc) WHERE past = 0),
siz AS ({body_size('(SELECT * REPLACE (place AS ord) FROM pre)')}), prs AS (SELECT pre.*, coalesce(body_size, 0) AS body_size FROM pre LEFT JOIN siz USING (doc_id)), seg AS ({segments('prs', 'body_size')})"""

REFS = f"refs AS (SELECT {R.REF_KEY} AS key, p_partkey AS ref_ord, {R.REF_TITLE} AS title, {R.REF_DOI} AS doi, {R.REF_AUTHOR} AS author, {R.REF_YEAR} AS year FROM part)"


def norm_doi(x: str) -> str:
    return strip(f"replace(replace(replace(rtrim(lower({strip(x)}), '.'), 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', '')")


def slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'ref')"


def pdf_name(doi: str, key: str) -> str:
    tail = f"{slug(key)} || '-' || substr(sha1({key}), 1, 8) || '.pdf'"
    return f"CASE WHEN coalesce({doi}, '') <> '' THEN {slug(norm_doi(doi))} || '__' || {tail} ELSE {tail} END"


FILES = f"""fil AS (SELECT CASE WHEN p_partkey % 4 = 0 AND rdoi IS NOT NULL THEN 'refs/' || {pdf_name('rdoi', 'key')} ELSE 'refs/f' || key || '.pdf' END AS path, doi, title
  FROM (SELECT p_partkey, {R.REF_KEY} AS key, {R.REF_DOI} AS rdoi, {R.FILE_DOI} AS doi, {R.FILE_TITLE} AS title FROM part) WHERE p_partkey % 5 <> 4)"""
BY_DOI = f"bydoi AS (SELECT r.key, min(f.path) AS path FROM refs r JOIN fil f ON {norm_doi('r.doi')} = {norm_doi('f.doi')} GROUP BY r.key)"
STEM = r"regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\.pdf$', '')"
#: Every prefix of a stem that a double underscore follows, found by looking at each place.
BY_SLUG = f"""stem AS (SELECT path, {STEM} AS stem FROM fil), cuts AS (SELECT path, stem AS s FROM stem UNION SELECT path, left(stem, i - 1) FROM (SELECT path, stem, unnest(range(1, length(stem) + 1)) AS i FROM stem) WHERE substr(stem, i, 2) = '__'),
byslug AS (SELECT r.key, min(c.path) AS path FROM refs r JOIN cuts c ON {slug(norm_doi('r.doi'))} = c.s WHERE r.doi IS NOT NULL GROUP BY r.key)"""
MATCH = "mat AS (SELECT r.key, coalesce(d.path, s.path) AS path, CASE WHEN coalesce(d.path, s.path) IS NULL THEN 'no_pdf' ELSE 'resolved' END AS resolution FROM refs r LEFT JOIN bydoi d USING (key) LEFT JOIN byslug s USING (key))"
AYKEY = r"'^(.+?)\s+((?:19|20)\d{2})$'"
FOUND = f"""keys AS (SELECT DISTINCT ref_key FROM chk),
byauthor AS (SELECT k.ref_key, arg_min(r.key, r.ref_ord) AS key FROM keys k JOIN refs r ON r.year = TRY_CAST(regexp_extract(k.ref_key, {AYKEY}, 2) AS INT) AND contains(lower(r.author), lower(regexp_extract(k.ref_key, {AYKEY}, 1)))
  WHERE regexp_matches(k.ref_key, {AYKEY}) AND k.ref_key NOT IN (SELECT key FROM refs) GROUP BY k.ref_key),
fnd AS (SELECT c.*, coalesce(r.key, a.key) AS found_key FROM chk c LEFT JOIN refs r ON c.ref_key = r.key LEFT JOIN byauthor a ON c.ref_key = a.ref_key)"""

ENTRY_NUMBER = r"TRY_CAST(regexp_extract({0}, '^\s*[\[(]?\s*(\d+)', 1) AS BIGINT)"
IS_ENTRY = r"regexp_matches({0}, '^\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|\d+[.)])\s+')"
ENTRY_LINES = f"""doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
bib AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN array_to_string(flatten([['[' || i || '] ' || l[i], '2020. wrapped'] FOR i IN range(1, len(l) + 1)]), chr(10))
  WHEN doc_id % 3 = 1 THEN array_to_string([l[i] || CASE WHEN (i - 1) % 3 = 2 THEN '' ELSE ' (' || (2000 + (i - 1) % 20) || ')' END || chr(10) FOR i IN range(1, len(l) + 1)], chr(10))
  ELSE array_to_string(l, chr(10)) END AS block FROM doc_lines),
bl AS ({rows('bib', 'doc_id', 'string_split(block, chr(10))', 'line', 'k')}), num AS (SELECT *, CASE WHEN {IS_ENTRY.format('line')} THEN {ENTRY_NUMBER.format('line')} END AS n FROM bl)"""
NUMBERED = """numbered AS (SELECT b.doc_id, coalesce(c >= 3 AND up >= 0.7 * (c - 1), false) AS numbered FROM bib b LEFT JOIN (
  SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE n > before) AS up FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM num WHERE n IS NOT NULL) GROUP BY doc_id) USING (doc_id))"""
#: The fold over lines as a recursion: a line opens an entry if its number follows the last accepted one.
BY_MARKER = """walk AS (SELECT doc_id, 0 AS k, n AS last, 0 AS e FROM num WHERE k = 0
  UNION ALL SELECT w.doc_id, m.k, CASE WHEN m.n IS NOT NULL AND (w.last IS NULL OR m.n = w.last + 1) THEN m.n ELSE w.last END, w.e + CASE WHEN m.n IS NOT NULL AND (w.last IS NULL OR m.n = w.last + 1) THEN 1 ELSE 0 END
  FROM walk w JOIN num m ON m.doc_id = w.doc_id AND m.k = w.k + 1),
bymarker AS (SELECT doc_id, e, string_agg(line, chr(10) ORDER BY k) AS entry FROM walk JOIN num USING (doc_id, k) GROUP BY doc_id, e)"""
BLANK_LINES = r"regexp_split_to_array(block, '\n\s*\n')"
BY_BLANK = rf"""part_of AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k0) AS k FROM ({rows('bib', 'doc_id', BLANK_LINES, 'p', 'k0')}) WHERE NOT {BLANK.format('p')}),
island AS (SELECT *, sum(CASE WHEN k = 1 OR regexp_matches(p, '\b(?:19|20)\d{{2}}[a-z]?\b') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS e, count(*) OVER (PARTITION BY doc_id) AS parts FROM part_of),
byblank AS (SELECT doc_id, e, string_agg(p, chr(10) || chr(10) ORDER BY k) AS entry FROM island WHERE parts > 1 GROUP BY doc_id, e)"""
SPLIT = f"""{ENTRY_LINES}, {NUMBERED}, {BY_MARKER}, {BY_BLANK},
ent AS (SELECT m.doc_id, m.e, m.entry FROM bymarker m JOIN numbered USING (doc_id) WHERE numbered AND NOT {BLANK.format('m.entry')}
  UNION ALL SELECT b.doc_id, b.e, b.entry FROM byblank b JOIN numbered USING (doc_id) WHERE NOT numbered
  UNION ALL SELECT l.doc_id, l.k, l.line FROM bl l JOIN numbered USING (doc_id) WHERE NOT numbered AND NOT {BLANK.format('l.line')} AND l.doc_id NOT IN (SELECT doc_id FROM byblank))"""


def entries(source: str, base: str = "") -> str:
    got = f"SELECT doc_id, count(*) AS n, md5(string_agg(entry, chr(1) ORDER BY e)) AS entries FROM {source} GROUP BY doc_id"
    return got if not base else f"SELECT b.doc_id, coalesce(g.n, 0) AS n, coalesce(g.entries, md5('')) AS entries FROM {base} b LEFT JOIN ({got}) g USING (doc_id)"


CHECK_ROWS = "chks AS (SELECT " + ", ".join(R.columns(R.CHECK)) + " FROM events)"
ACQ_ROWS = "acq AS (SELECT " + ", ".join(R.columns(R.ACQ)) + " FROM orders)"
LOOKUPS = f"""{ACQ_ROWS}, look AS (SELECT *, CASE WHEN unpaywall IS NULL THEN NULL WHEN http_status = 404 OR NOT json_valid(unpaywall) THEN 'unresolved'
    WHEN coalesce(json_extract_string(CASE WHEN json_valid(unpaywall) THEN unpaywall END, '$.is_oa'), 'false') <> 'true' OR u_url IS NULL THEN 'closed' ELSE 'oa' END AS u,
  CASE WHEN openalex IS NULL THEN NULL WHEN json_extract(openalex, '$.results[0]') IS NULL THEN 'unresolved' WHEN coalesce(json_extract_string(openalex, '$.results[0].open_access.is_oa'), 'false') <> 'true' OR a_url IS NULL THEN 'closed' ELSE 'oa' END AS a
  FROM (SELECT *, nullif(json_extract_string(CASE WHEN json_valid(unpaywall) THEN unpaywall END, '$.best_oa_location.url_for_pdf'), '') AS u_url,
    coalesce(nullif(json_extract_string(openalex, '$.results[0].best_oa_location.pdf_url'), ''), CASE WHEN lower(json_extract_string(openalex, '$.results[0].open_access.oa_url')) LIKE '%.pdf' THEN json_extract_string(openalex, '$.results[0].open_access.oa_url') END) AS a_url FROM acq)),
loc AS (SELECT *, CASE WHEN u <> 'unresolved' THEN u ELSE coalesce(a, 'unresolved') END AS found, CASE WHEN u <> 'unresolved' THEN CASE WHEN u = 'oa' THEN u_url END WHEN a = 'oa' THEN a_url END AS url, {pdf_name('doi', 'key')} AS name FROM look)"""
ACQUIRED = f"""{LOOKUPS}, got AS (SELECT *, CASE WHEN present THEN 'already_present' WHEN found = 'unresolved' THEN 'not_found' WHEN found = 'closed' THEN 'paywalled' WHEN url IS NOT NULL AND download_ok THEN 'fetched' ELSE 'error' END AS status FROM loc)"""
GOT_DETAIL = f"CASE WHEN status <> 'error' THEN '' ELSE {quoted(acquire.DOWNLOAD_FAILED)} END"
LINE_HEAD = "'- [' || status || '] **' || key || '**'"
OVERRIDE_ROWS = "ov AS (SELECT * FROM (SELECT " + ", ".join(R.columns(R.OVERRIDE)) + f" FROM events) WHERE clear OR verdict IS NULL OR verdict IN {among(audit.OVERRIDES)})"


def folded(value: str, when: str) -> str:
    """The value of the last event that says something about it, null included."""
    return f"(SELECT {value} FROM ov o WHERE o.check_id = ids.check_id AND {when} ORDER BY seq DESC LIMIT 1)"


SETS = "(NOT clear AND verdict IS NOT NULL)"
CHUNKS = "chunk AS (SELECT doc_id, start // 1350 AS chunk_ord, substr(text, start + 1, 1500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1350)) AS start FROM documents WHERE length(text) > 0))"
RAW = f"raw AS (SELECT event_id, {R.RAW_VERDICT} AS raw FROM events), js AS (SELECT *, CASE WHEN contains(raw, '```') THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(.+?)```', 1) ELSE raw END AS j FROM raw)"
FRAGMENTS = rf"""[{strip('f')} FOR f IN regexp_split_to_array(regexp_replace(snippet, '([.;:])\s+', '\1' || chr(10), 'g'), '\n+') IF length({strip('f')}) >= 30]"""

HOST_PARTS = r"""hst AS (SELECT page_id, base, lower(regexp_replace(regexp_extract(CASE WHEN contains(base, '://') THEN base ELSE 'http://' || base END,
  '^[^:/?#]+://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]+)(?::[0-9]*)?(?:[/?#]|$)', 1), '^\[|\]$', '', 'g')) AS host FROM (SELECT page_id, """ + R.ADDRESS + r""" AS base FROM pages)),
oct AS (SELECT *, [TRY_CAST(o AS INT) FOR o IN string_split(host, '.')] AS o FROM hst)"""

BIB = f"""bib AS (SELECT doc_id, k, CAST(k AS VARCHAR) AS key, {R.pick('k', R.SURNAMES)} AS surname, 1990 + k % 30 AS year, {R.CITED} AS cited FROM documents, range({R.ENTRIES}) r(k) WHERE NOT ({R.UNREAD_ENTRY}))"""


def counts(x: str) -> str:
    return f"[length({x})::DOUBLE, " + ", ".join(f"(length({x}) - length(replace({x}, {quoted(c)}, '')))::DOUBLE" for c in R.COUNTED) + "]"


#: The longest question's parts besides claim and passages; 400 characters in a passage, 350 from one to the next, three passages.
WHOLE_CHECK = f"""WITH {MINED}, {BIB},
chk AS ({rows('cit', 'doc_id, id, claim', 'keys', 'ref_key', 'key_ord')}),
byauthor AS (SELECT c.doc_id, c.ref_key, min(b.k) AS k FROM (SELECT DISTINCT doc_id, ref_key FROM chk) c JOIN bib b ON b.doc_id = c.doc_id AND b.year = TRY_CAST(regexp_extract(c.ref_key, {AYKEY}, 2) AS INT) AND contains(lower(b.surname || ' A.'), lower(regexp_extract(c.ref_key, {AYKEY}, 1)))
  WHERE regexp_matches(c.ref_key, {AYKEY}) GROUP BY ALL),
fnd AS (SELECT c.*, coalesce(b.cited, a.cited) AS cited FROM chk c LEFT JOIN bib b ON b.doc_id = c.doc_id AND b.key = c.ref_key LEFT JOIN byauthor y ON y.doc_id = c.doc_id AND y.ref_key = c.ref_key LEFT JOIN bib a ON a.doc_id = y.doc_id AND a.k = y.k),
src AS (SELECT doc_id AS cited, {R.SOURCE_PATH} AS path, {R.SOURCE_ERROR} AS error, CASE WHEN {R.SOURCE_ERROR} IS NULL THEN text END AS text FROM documents WHERE {R.SOURCE_FILE}),
psg AS (SELECT cited, start // 350 AS o, substr(text, start + 1, 400) AS chunk FROM (SELECT *, unnest(range(0, greatest(length(text), 1), 350)) AS start FROM src WHERE length(text) > 0)),
vec AS (SELECT cited, o, length(chunk) AS n, {counts('chunk')} AS v FROM psg),
pair AS (SELECT DISTINCT claim, cited FROM fnd WHERE cited IS NOT NULL),
top AS (SELECT claim, cited, count(*) AS passages, sum(n) AS chars FROM (
  SELECT p.claim, p.cited, v.n, row_number() OVER (PARTITION BY p.claim, p.cited ORDER BY round(coalesce(list_dot_product({counts('p.claim')}, v.v) / nullif(sqrt(list_dot_product({counts('p.claim')}, {counts('p.claim')}) * list_dot_product(v.v, v.v)), 0), 0), 6) DESC, o) AS r FROM pair p JOIN vec v USING (cited)) WHERE r <= 3 GROUP BY ALL)
SELECT f.doc_id, f.id, CAST(f.key_ord AS BIGINT) AS key_ord, f.ref_key, s.path AS source_path,
  CASE WHEN f.cited IS NULL THEN 'unresolved_marker' WHEN s.path IS NULL THEN 'no_pdf' WHEN s.text IS NULL THEN 'unreadable_source' WHEN t.passages IS NULL THEN 'not_found'
    ELSE {R.pick(f"({len(''.join(judge.ASKED))} + length(f.claim) + t.chars + 3 * t.passages - 1)", judge.VERDICTS)} END AS bucket,
  CAST(coalesce(t.passages, 0) AS BIGINT) AS passages, CASE WHEN t.passages IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM fnd f LEFT JOIN src s USING (cited) LEFT JOIN top t ON t.cited = f.cited AND t.claim = f.claim"""

HEADED = f"headed AS (SELECT doc_id AS check_id, lang, {R.pick('doc_id', R.STATUSES)} AS status, regexp_replace(substr(text, 1, 60), '[^\\p{{L}} ]', '', 'g') AS claim FROM documents WHERE text IS NOT NULL)"

ORACLES: dict[str, str] = {
    "parse_references": f"WITH {BIB} SELECT doc_id, key, 'Study of matter ' || cited AS title, '10.1234/s.' || cited AS doi, surname || ' A.' AS authors, CAST(year AS INT) AS year FROM bib",
    "whole_check": WHOLE_CHECK,
    "lookup_cache": f"""WITH {LOOKUPS}, a AS (SELECT key, CASE WHEN o_orderkey % 9 <> 0 THEN found END AS status, o_orderkey FROM loc JOIN (SELECT o_orderkey, {R.ACQ['key']} AS key FROM orders) USING (key))
        SELECT key, 1 + CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN status IS NULL THEN 2 WHEN status = 'unresolved' THEN 1 ELSE 0 END ELSE CASE WHEN status IS NULL THEN 1 ELSE 0 END END AS asked FROM a""",
    "passage_text": f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e ', 'e-' || chr(10) || ' ') ELSE text END, ''), {quoted('([A-Za-z])-' + display.GAP + '([A-Za-z])')}, '\\1-\\2', 'g'), {quoted(display.GAP)}, ' ', 'g'), ' ')) AS text FROM documents""",
    "highlight_colour": f"WITH {CHECK_ROWS} SELECT check_id, status, CASE status " + " ".join(f"WHEN '{k}' THEN '{' '.join(f'{x:.2f}' for x in v)}'" for k, v in display.COLOURS.items()) + " END AS colour FROM chks",
    "reference_card": f"""SELECT p_partkey AS ord, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN {R.REF_TITLE} END, CASE WHEN p_partkey % 6 <> 0 THEN p_name || ' raw' END, '—') AS title,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {R.REF_AUTHOR} || ' et al.' END AS line FROM part""",
    "passage_neighbours": "SELECT event_id, CASE WHEN n < 2 THEN i ELSE greatest(0, least(i - 1, n - 1)) END AS previous, CASE WHEN n < 2 THEN i ELSE greatest(0, least(i + 1, n - 1)) END AS following FROM (SELECT event_id, event_id % 5 AS n, user_id % 5 AS i FROM events) WHERE i < greatest(n, 1)",
    "reading_order": f"WITH {HEADED} SELECT check_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {rank('status')}, claim COLLATE en, check_id) AS place FROM headed",
    "search_any_case": f"WITH {HEADED} SELECT check_id FROM headed WHERE contains(lower(claim), 'ä')",
    "text_scan": f"SELECT doc_id, CAST(p + 1 AS BIGINT) AS page, md5(text) AS text FROM ({rows('(SELECT doc_id, substr(text, 1, 1000) || chr(12) || substr(text, 1001) || chr(10) AS t FROM documents WHERE text IS NOT NULL)', 'doc_id', 'string_split(t, chr(12))', 'text', 'p')})",
    "layout_scan": f"WITH {BLOCKS} SELECT doc_id, page, x0, y0, x1, size, bold, md5({NO_NUMBERS.format(strip('text'))}) AS text FROM blk WHERE {strip(NO_NUMBERS.format(strip('text')))} <> '' AND doc_id % 11 <> 10",
    "refs_folder": "SELECT doc_id, CAST(octet_length(encode(text)) + 8 + 1 AS BIGINT) AS length FROM documents WHERE doc_id % 3 = 0 AND octet_length(encode(text)) + 8 + 1 <= 2000",
    "report_round_trip": f"""WITH {CHECK_ROWS} SELECT manuscript, CASE WHEN ok THEN checks END AS checks, CASE WHEN ok THEN reviewed END AS reviewed, CASE WHEN ok THEN chars END AS chars, CASE WHEN ok THEN sources END AS sources, CASE WHEN ok THEN passages END AS passages, ok AS readable
      FROM (SELECT manuscript, manuscript % 9 <> 4 AS ok, count(*) AS checks, count(*) FILTER (WHERE reviewed) AS reviewed, CAST(sum(length(claim)) AS BIGINT) AS chars, count(source_path) AS sources, count(snippet) AS passages FROM chks GROUP BY manuscript)""",
    "coverage_by_identifier": f"WITH {CHECKS}, {REFS}, {FILES}, {BY_DOI}, {BY_SLUG}, {MATCH}, {FOUND} SELECT CASE WHEN found_key IS NULL THEN 'unresolved_marker' ELSE resolution END AS bucket, count(*) AS n FROM fnd LEFT JOIN mat ON found_key = mat.key GROUP BY 1",
    "strip_line_numbers": f"WITH {PAGES} SELECT doc_id, page, md5({NO_NUMBERS.format('text')}) AS body FROM pages_of",
    "split_sentences": f"WITH {SENT} SELECT doc_id, CAST(i AS BIGINT) AS i, s FROM sent",
    "numeric_markers": f"WITH {MARKED}, m AS ({rows('marked', 'doc_id, i', f'regexp_extract_all(t, {NUM}, 1)', 'm', 'g')}) SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(g AS BIGINT) AS g, array_to_string({number_keys('m')}, '|') AS keys FROM m",
    "authoryear_markers": f"WITH {MARKED}, m AS ({rows('marked', 'doc_id, i', f'regexp_extract_all(t, {AY}, 1)', 'm', 'g')}) SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string({author_keys('m')}, '|') AS keys FROM m",
    "find_markers": f"WITH {GROUPS} SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(g AS BIGINT) AS g, CAST(strpos(whole, m) - 1 AS BIGINT) AS pos, array_to_string(keys, '|') AS keys FROM grp",
    "strip_markers": f"WITH {MARKED} SELECT doc_id, CAST(i AS BIGINT) AS i, {bare('t')} AS claim FROM marked",
    "mine_citations": f"WITH {MINED} SELECT doc_id, id, page, claim, array_to_string(keys, '|') AS keys FROM cit",
    "mine_segments": f"WITH {CLEAN}, cit AS ({mined('seg')}) SELECT doc_id, id, page, claim, array_to_string(keys, '|') AS keys FROM cit",
    "layout_fallback": f"""WITH {CLEAN}, lay AS ({mined('seg')}), {PAGES}, {BODY}, plain AS ({mined('body')}),
        both_of AS (SELECT doc_id, id, keys FROM lay UNION ALL SELECT doc_id, id, keys FROM plain WHERE doc_id NOT IN (SELECT doc_id FROM lay))
        SELECT doc_id, count(*) AS citations, min(id) AS first_id, CAST(sum(len(keys)) AS BIGINT) AS keys FROM both_of GROUP BY doc_id""",
    "scope_tag": f"""WITH {MINED}, lab AS (SELECT DISTINCT doc_id, quality + 2 * toxic AS i FROM labels WHERE doc_id % 5 <> 0)
        SELECT c.doc_id, c.id, CASE WHEN l.i IS NULL THEN 'empirical' ELSE 'non_checkable' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS n FROM cit) c LEFT JOIN lab l ON l.doc_id = c.doc_id AND l.i = c.n""",
    "explode_checks": f"WITH {MINED} SELECT doc_id, id, CAST(key_ord AS BIGINT) AS key_ord, ref_key FROM ({rows('cit', 'doc_id, id', 'keys', 'ref_key', 'key_ord')})",
    "page_number_from_name": "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN CAST(user_id AS INT) END AS page FROM events",
    "references_block": f"WITH {PAGES} SELECT doc_id, page, CASE WHEN regexp_matches(text, {HEADING}) THEN trim(replace(regexp_split_to_array(text, {HEADING})[-1], chr(10), ' ')) ELSE '' END AS block FROM pages_of",
    "marker_number": f"WITH {ENTRY_LINES} SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(n) AS n FROM num GROUP BY doc_id",
    "looks_numbered": f"WITH {ENTRY_LINES}, {NUMBERED} SELECT doc_id, numbered FROM numbered",
    "entries_by_marker": f"WITH RECURSIVE {ENTRY_LINES}, {BY_MARKER} {entries('(SELECT * FROM bymarker WHERE NOT ' + BLANK.format('entry') + ')', 'bib')}",
    "entries_by_blankline": f"WITH {ENTRY_LINES}, {BY_BLANK} {entries('byblank')}",
    "split_entries": f"WITH RECURSIVE {SPLIT} {entries('ent', 'bib')}",
    "pack_chunks": f"""WITH RECURSIVE {SPLIT}, ordered AS (SELECT doc_id, entry, row_number() OVER (PARTITION BY doc_id ORDER BY e) AS k FROM ent JOIN bib USING (doc_id) WHERE length(block) > 1000),
        packing AS (SELECT doc_id, k, length(entry) + 1 AS size, 0 AS c FROM ordered WHERE k = 1 UNION ALL
          SELECT o.doc_id, o.k, CASE WHEN p.size + length(o.entry) + 1 > 1000 THEN 0 ELSE p.size END + length(o.entry) + 1, p.c + CASE WHEN p.size + length(o.entry) + 1 > 1000 THEN 1 ELSE 0 END FROM packing p JOIN ordered o ON o.doc_id = p.doc_id AND o.k = p.k + 1),
        chk AS (SELECT o.doc_id, c AS e, string_agg(entry, chr(10) ORDER BY o.k) AS entry FROM packing p JOIN ordered o ON o.doc_id = p.doc_id AND o.k = p.k GROUP BY o.doc_id, c
          UNION ALL SELECT doc_id, 0, regexp_replace(block, '^\\n+|\\n+$', '', 'g') FROM bib WHERE length(block) <= 1000 AND NOT {BLANK.format('block')})
        {entries('chk', 'bib')}""",
    "to_reference": f"""SELECT p_partkey AS ord, CAST(p_partkey % 700 AS VARCHAR) AS key, p_name || ' raw' AS raw, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE {R.REF_TITLE} END AS title, {R.REF_DOI} AS doi,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {R.REF_AUTHOR} || '|' || p_brand END AS authors, CASE WHEN p_partkey % 5 IN (0, 1) THEN NULL ELSE {R.REF_YEAR} END AS year FROM part WHERE p_partkey % 11 <> 0""",
    "dedupe_richest": f"""WITH r AS (SELECT p_partkey AS ord, CAST(p_partkey % 700 AS VARCHAR) AS key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE {R.REF_TITLE} END AS title, {R.REF_DOI} AS doi, p_partkey % 4 <> 0 AS has_authors,
        CASE WHEN p_partkey % 5 IN (0, 1) THEN NULL ELSE {R.REF_YEAR} END AS year FROM part WHERE p_partkey % 11 <> 0)
        SELECT first AS ord, key, title, doi, year FROM (SELECT *, min(ord) OVER (PARTITION BY key) AS first,
          row_number() OVER (PARTITION BY key ORDER BY CASE WHEN title IS NULL THEN 0 ELSE 1 END + CASE WHEN doi IS NULL THEN 0 ELSE 1 END + CASE WHEN has_authors THEN 1 ELSE 0 END + CASE WHEN year IS NULL THEN 0 ELSE 1 END DESC, ord) AS k FROM r) WHERE k = 1""",
    "retry_policy": f"""WITH e AS (SELECT event_id, event_id % 3 AS attempt, CAST({R.pick('user_id', ('200', '404', '429', '503', '401', '500'))} AS INT) AS status, CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'decode' END AS error FROM events)
        SELECT event_id, CASE WHEN error IS NULL AND status < 400 THEN 'ok' WHEN (coalesce(error, '') IN ('timeout', 'transport') OR status IN (429, 500, 502, 503, 504)) AND attempt < 2 THEN 'retry' ELSE 'give_up' END AS step FROM e""",
    "body_size": f"WITH {BLOCKS} {body_size('blk')}",
    "drop_margins": f"WITH {BLOCKS} SELECT doc_id, page, count(*) AS n, CAST(sum(ord) AS BIGINT) AS ords FROM ({kept('blk')}) GROUP BY doc_id, page",
    "norm_repeat": f"WITH {BLOCKS} SELECT doc_id, ord, {NORM} AS norm FROM blk",
    "is_page_number": f"WITH {BLOCKS} SELECT doc_id, ord, text FROM blk WHERE {PAGENO}",
    "classify_block": f"WITH {BLOCKS} SELECT doc_id, ord, {kind('10.0')} AS kind FROM blk",
    "order_by_column": f"WITH {BLOCKS} SELECT doc_id, page, ord, place FROM ({placed('blk')})",
    "page_segments": f"WITH {BLOCKS}, plc AS ({placed('blk')}) {segments('plc', '10.0')}",
    "clean_pages": f"WITH {CLEAN} SELECT doc_id, page, seg_ord, text FROM seg",
    "join_ref_by_key": f"WITH {CHECKS}, {REFS} SELECT c.ref_key, title, year, count(*) AS checks FROM chk c LEFT JOIN refs r ON c.ref_key = r.key GROUP BY ALL",
    "join_ref_author_year": f"WITH {CHECKS}, {REFS}, {FOUND} SELECT ref_key, found_key, count(*) AS checks FROM fnd GROUP BY ALL",
    "unresolved_marker": f"WITH {CHECKS}, {REFS}, {FOUND} SELECT doc_id, count(*) AS checks, count(*) FILTER (WHERE found_key IS NULL) AS unresolved FROM fnd GROUP BY doc_id",
    "join_doi_exact": f"WITH {REFS}, {FILES}, {BY_DOI} SELECT key, path FROM bydoi",
    "join_doi_slug_prefix": f"WITH {REFS}, {FILES}, {BY_SLUG} SELECT key, path FROM byslug",
    "match_by_identifier": f"WITH {REFS}, {FILES}, {BY_DOI}, {BY_SLUG}, {MATCH} SELECT * FROM mat",
    "top2_margin": """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, (event_id * 37 % 1000)::DOUBLE / 1000 - CASE WHEN event_id % 40 = 0 THEN 0 ELSE 0.3::DOUBLE END AS score FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, event_id) AS k FROM s WHERE score >= 0.62),
        t AS (SELECT a.key, a.event_id, coalesce(a.score - b.score < 0.08, false) AS close FROM r a LEFT JOIN r b ON a.key = b.key AND b.k = 2 WHERE a.k = 1)
        SELECT key, CASE WHEN close THEN NULL ELSE 'f' || event_id END AS path, CASE WHEN close THEN 'ambiguous' ELSE 'resolved' END AS status FROM t""",
    "passage_lookup": f"WITH {CHECK_ROWS} SELECT check_id, check_id % 2 AS rank, CASE WHEN check_id % 2 = 0 THEN snippet ELSE snippet || 'more' END AS snippet FROM chks WHERE snippet IS NOT NULL",
    "source_file_fallback": f"WITH {CHECK_ROWS} SELECT check_id, CASE WHEN regexp_extract(source_path, '[^/]*$') IN (SELECT 'f' || p_partkey % 25 || '.pdf' FROM part) THEN 'folder/' || regexp_extract(source_path, '[^/]*$') ELSE source_path END AS path FROM chks WHERE source_path IS NOT NULL",
    "chunk_text": f"WITH {CHUNKS} SELECT doc_id, chunk_ord, md5(chunk) AS chunk FROM chunk",
    "source_index": f"WITH {CHUNKS}, {CHECKS} SELECT doc_id AS source_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM chunk WHERE doc_id IN (SELECT TRY_CAST(ref_key AS BIGINT) FROM chk WHERE TRY_CAST(ref_key AS BIGINT) IS NOT NULL) GROUP BY doc_id",
    "topk_in_source": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT a.vec_id AS claim_id, b.vec_id AS chunk_ord, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS score FROM v a JOIN v b ON a.label = b.label),
        r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, chunk_ord) AS rank FROM s)
        SELECT * FROM r WHERE rank <= 4 AND claim_id <> chunk_ord""",
    "evidence_mapping": """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'key' || user_id WHEN event_id % 5 = 0 THEN '' ELSE 'Doe' || user_id END AS paper_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 30 AS INT) END AS page, props AS snippet,
        CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE (event_id % 10)::DOUBLE END AS score, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'summary' END AS rcs_summary FROM events""",
    "parse_verdict": f"""WITH {RAW}, p AS (SELECT *, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN json_type(j) END AS kind, CASE WHEN json_valid(j) THEN j END AS d FROM js)
        SELECT event_id, CASE WHEN kind = 'OBJECT' AND json_extract_string(d, '$.verdict') IN {among(judge.VERDICTS)} THEN json_extract_string(d, '$.verdict') ELSE 'unsupported' END AS verdict,
        CASE WHEN NOT ok THEN left(raw, 200) WHEN kind = 'OBJECT' THEN coalesce(left(json_extract_string(d, '$.rationale'), 300), '') ELSE '' END AS rationale,
        CASE WHEN kind = 'OBJECT' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(json_extract_string(d, '$.confidence') AS DOUBLE), 0.0::DOUBLE))) ELSE 0.0::DOUBLE END AS confidence FROM p""",
    "judge_claims": f"""WITH c AS (SELECT CAST(item_id AS VARCHAR) AS check_id, item_id % 3 = 0 AS bare, {len(''.join(judge.ASKED)) + 2} + length(text) + length(substr(text, 1, 40)) AS n FROM benchmark)
        SELECT check_id, CASE WHEN bare THEN 'not_found' ELSE {R.pick('n', judge.VERDICTS)} END AS verdict, CASE WHEN bare THEN {quoted(judge.NO_PASSAGE)} ELSE 'echo' END AS rationale, CASE WHEN bare THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM c""",
    "check_pipeline": f"""WITH e AS (SELECT event_id % 9 = 0 AS away, {R.pick('event_id', ('resolved', 'resolved', 'resolved', 'no_pdf', 'ambiguous', 'unresolved_marker'))} AS resolution, event_id % 6 < 3 AND event_id % 17 <> 0 AS has_path, event_id % 13 = 0 AS failed, event_id % 4 AS n,
        {R.pick('user_id', ('supported', 'partially', 'overstated', 'unsupported'))} AS said FROM events)
        SELECT CASE WHEN away THEN 'not_a_claim' WHEN resolution <> 'resolved' OR NOT has_path THEN resolution WHEN failed THEN 'unreadable_source' WHEN n = 0 THEN 'not_found' ELSE said END AS bucket, count(*) AS n FROM e GROUP BY 1""",
    "highlight_spans": f"""WITH pg AS (SELECT doc_id, 1 AS page, substr(text, 1, 1500) AS text FROM documents UNION ALL SELECT doc_id, 2, substr(text, 1501) FROM documents),
        ps AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 40, 120) WHEN 1 THEN 'Not there. ' || substr(text, 60, 90) ELSE 'zq ' || substr(text, 1, 20) END AS snippet, CASE WHEN doc_id % 2 = 0 THEN 1 END AS asked FROM documents WHERE text IS NOT NULL),
        b AS (SELECT ps.doc_id, page, text, snippet, asked IS NULL OR asked = page AS here FROM ps JOIN pg USING (doc_id)),
        f AS (SELECT DISTINCT doc_id, page, text, here, unnest({FRAGMENTS}[1:20]) AS f FROM b),
        asked_for AS (SELECT doc_id, page, text, 0 AS tier, snippet AS f FROM b WHERE here UNION ALL SELECT doc_id, page, text, CASE WHEN here THEN 1 ELSE 2 END, f FROM f),
        cut AS (SELECT doc_id, page, tier, f, string_split(text, f) AS p FROM asked_for WHERE f <> '' AND contains(text, f)),
        a AS (SELECT doc_id, page, tier, length(f) AS length, CAST(list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * length(f) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(p))) AS i FROM cut)),
        g AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS best FROM a)
        SELECT doc_id AS passage_id, page, count(*) AS spans, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(length) AS BIGINT) AS lengths FROM g WHERE tier = best GROUP BY ALL""",
    "render_target_page": """SELECT event_id, CAST(least(greatest(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 20 END, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 40 - 4 END, 1), 1), 1 + event_id % 12) AS INT) AS page FROM events""",
    "oa_response": f"WITH {LOOKUPS} SELECT key, u AS unpaywall, a AS openalex, found AS status, url AS pdf_url FROM loc",
    "classify_acquisition": f"WITH {ACQUIRED} SELECT key AS ref_key, status, CASE WHEN found = 'oa' AND NOT present THEN url END AS source_url, {GOT_DETAIL} AS detail FROM got",
    "existing_files": f"WITH {LOOKUPS} SELECT key, name FROM loc WHERE present AND download_ok",
    "pdf_names": f"WITH {ACQ_ROWS} SELECT key, {pdf_name('doi', 'key')} AS name FROM acq",
    "acquisition_summary": f"WITH {ACQUIRED} SELECT status, count(*) AS n FROM got GROUP BY status",
    "missing_count": f"WITH {ACQUIRED} SELECT count(*) AS missing FROM got WHERE status IN ('paywalled', 'not_found', 'error')",
    "acquisition_order": f"WITH {ACQUIRED} SELECT key AS ref_key, status, CAST({rank('status', audit.ACQUISITION_ORDER)} AS BIGINT) AS rank, CAST({rank('status', audit.ACQUISITION_ORDER[:3], 9)} AS BIGINT) AS api_rank, row_number() OVER (PARTITION BY status ORDER BY key) AS place FROM got",
    "acquisition_manifest": f"""WITH {ACQUIRED}, m AS (SELECT *, status IN ('error', 'not_found', 'paywalled') AS missing FROM got)
        SELECT CASE WHEN missing THEN 'supply' ELSE 'fetched' END AS section, CAST({rank('status', audit.ACQUISITION_ORDER)} AS BIGINT) AS rank, key AS ord,
        CASE WHEN missing THEN {LINE_HEAD} || ' — ' || coalesce(nullif(title, ''), nullif(doi, ''), '(no metadata)') || CASE WHEN status = 'error' THEN ' — download failed' ELSE '' END ELSE {LINE_HEAD} || ' → refs/' || name END AS line FROM m""",
    "display_status": f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {R.pick('user_id', R.OVERRIDES)} WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'resolved' ELSE 'no_pdf' END ELSE {R.pick('event_id', ('unchecked', 'supported', 'unsupported'))} END AS status FROM events""",
    "override_fold": f"""WITH {OVERRIDE_ROWS}, ids AS (SELECT DISTINCT check_id FROM ov)
        SELECT check_id, {folded(f'CASE WHEN {SETS} THEN verdict END', f'(clear OR {SETS})')} AS human_override, coalesce({folded('coalesce(reviewed, true)', f'(reviewed IS NOT NULL OR {SETS})')}, false) AS reviewed, {folded("coalesce(note, '')", 'true')} AS note FROM ids""",
    "problems_first": f"WITH {CHECK_ROWS} SELECT manuscript, check_id, CAST({rank('status')} AS BIGINT) AS rank, row_number() OVER (PARTITION BY manuscript ORDER BY {rank('status')}, check_id) AS place FROM chks",
    "manuscript_order": f"WITH {CHECK_ROWS} SELECT manuscript, check_id, row_number() OVER (PARTITION BY manuscript ORDER BY CASE WHEN check_id % 6 = 0 THEN NULL ELSE check_id % 17 END NULLS LAST, check_id) AS place FROM chks",
    "queue_search": f"WITH {CHECK_ROWS} SELECT check_id, status FROM chks WHERE status IN {among(audit.PROBLEMS)} AND section = 'Results' AND contains(lower(concat_ws(' ', claim, ref_key, title)), 'claim 4')",
    "queue_unreviewed": f"WITH {CHECK_ROWS} SELECT check_id, status FROM chks WHERE NOT reviewed AND status IN ('ambiguous', 'no_pdf')",
    "status_counts": f"WITH {CHECK_ROWS} SELECT status, count(*) AS n, CAST({rank('status')} AS BIGINT) AS rank FROM chks GROUP BY status",
    "coverage_share": f"WITH {CHECK_ROWS} SELECT status AS bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM chks), 2) AS share, CAST({rank('status')} AS BIGINT) AS rank FROM chks GROUP BY status",
    "reviewed_progress": f"WITH {CHECK_ROWS} SELECT count(*) FILTER (WHERE reviewed) AS reviewed, count(*) AS total, CAST(round(100.0 * count(*) FILTER (WHERE reviewed) / count(*)) AS BIGINT) AS percent FROM chks",
    "distinct_sections": f"WITH {CHECK_ROWS} SELECT DISTINCT section FROM chks WHERE section <> ''",
    "next_unreviewed": f"""WITH {CHECK_ROWS} SELECT check_id, coalesce(lag(check_id) OVER w, check_id) AS previous, coalesce(lead(check_id) OVER w, check_id) AS following,
        coalesce(min(CASE WHEN NOT reviewed THEN check_id END) OVER (PARTITION BY manuscript ORDER BY check_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN NOT reviewed THEN check_id END) OVER (PARTITION BY manuscript ORDER BY check_id ROWS UNBOUNDED PRECEDING)) AS next_unreviewed
        FROM chks WINDOW w AS (PARTITION BY manuscript ORDER BY check_id)""",
    "row_view": f"WITH {CHECK_ROWS} SELECT check_id, status, claim, reviewed, CASE WHEN snippet IS NOT NULL THEN 'p' || check_id END AS passage_id, CASE WHEN snippet IS NOT NULL THEN 3 END AS passage_page, CASE WHEN snippet IS NOT NULL THEN 1::BIGINT ELSE 0::BIGINT END AS passages FROM chks",
    "citations_report": f"""WITH {CHECK_ROWS} SELECT CAST({rank('status')} AS BIGINT) AS rank, check_id AS ord, '## [' || status || '] ' || claim || chr(10) || '- cites **[' || ref_key || ']** → ' || coalesce(regexp_extract(source_path, '[^/]*$'), ref_key) || chr(10)
        || CASE WHEN rationale <> '' THEN '- ' || rationale || chr(10) ELSE '' END || CASE WHEN snippet IS NOT NULL THEN '- source: “' || left(trim(snippet), 300) || '”' || chr(10) ELSE '' END || CASE WHEN note <> '' THEN '- note: ' || note || chr(10) ELSE '' END AS lines FROM chks""",
    "norm_doi": f"WITH {FILES} SELECT path, {norm_doi('doi')} AS doi, {slug(norm_doi('doi'))} AS slug FROM fil WHERE doi IS NOT NULL",
    "first_doi": f"""WITH d AS (SELECT doc_id, 'see doi 10.' || (1000 + doc_id % 9000) || '/x' || doc_id || chr(10) || coalesce(text, '') AS text FROM documents)
        SELECT doc_id, '10.' || (1000 + doc_id % 9000) || '/x' || doc_id AS doi, CASE WHEN doc_id % 4 = 1 THEN 'A fine long title' ELSE [{strip('l')} FOR l IN string_split(text, chr(10)) IF length({strip('l')}) >= 20][1] END AS title FROM d""",
    "safe_id": "SELECT page_id, page_id % 4 = 2 OR (page_id % 4 = 1 AND regexp_full_match(url, '[A-Za-z0-9._-]+')) AS safe FROM pages",
    "local_host": rf"""WITH {HOST_PARTS} SELECT page_id, base, host, CASE WHEN host = '' THEN false WHEN contains(host, ':') THEN host = '::1' OR regexp_matches(host, '^(fe[89ab][0-9a-f]|f[cd][0-9a-f]{{2}}):')
        WHEN regexp_full_match(host, '(\d{{1,3}}\.){{3}}\d{{1,3}}') THEN greatest(o[1], o[2], o[3], o[4]) <= 255 AND (o[1] IN (10, 127) OR host = '0.0.0.0' OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127))
        ELSE host = 'localhost' OR host LIKE '%.local' OR NOT contains(host, '.') END AS is_local FROM oct""",
    "local_model": "SELECT event_id, event_id % 5 IN (0, 1) AS is_local FROM events",
    "pdf_magic": "SELECT doc_id FROM documents WHERE n_chars * 20000 <= 50000000 AND (doc_id % 3 = 0 AND text IS NOT NULL OR starts_with(text, '%PDF'))",
}
