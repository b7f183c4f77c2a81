"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import disclosure, licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH hosts AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)', 1), '^www\.', ''), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'gsi'),
      '[\r\n\t ]+', ' ', 'g'),
      '</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'gi'),
      '<[^>]*>', '', 'g') AS raw
  FROM pages),
texts AS (
  SELECT page_id, host, [trim(x, ' ') FOR x IN string_split(
    replace(replace(replace(replace(replace(replace(raw, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10))
    IF trim(x, ' ') <> ''] AS lines
  FROM hosts),
each_line AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM texts),
seen AS (SELECT host, line, count(DISTINCT page_id) AS n FROM each_line GROUP BY ALL),
totals AS (SELECT host, count(*) AS pages FROM texts GROUP BY ALL),
gone AS (SELECT s.host, s.line FROM seen s JOIN totals t ON s.host IS NOT DISTINCT FROM t.host WHERE s.n >= 2 AND s.n > 0.1 * t.pages),
kept AS (
  SELECT e.page_id, count(*) AS n_lines, count(g.line) AS n_dropped, coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE g.line IS NULL), '') AS text
  FROM each_line e LEFT JOIN gone g ON e.host IS NOT DISTINCT FROM g.host AND e.line = g.line GROUP BY ALL)
SELECT t.page_id, t.host, coalesce(k.n_lines, 1)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (page_id)
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '~' || coalesce(text, ''))), 1, 12))::BIGINT AS turn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / w AS r FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(most) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(w) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, CASE WHEN level >= r THEN most ELSE (SELECT max(level) FROM l WHERE level < r) * w END AS target FROM l),
q AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
shots AS (SELECT doc_id, size, (e.e * source_size + done)::DOUBLE / target AS t FROM q, (VALUES (0), (1), (2)) e(e) WHERE size > 0 AND target > 0),
run AS (SELECT t, sum(sum(size)) OVER (ORDER BY t) AS so_far FROM shots GROUP BY t),
cut AS (SELECT max(t) AS cut FROM run WHERE so_far <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN size > 0 AND target > 0 THEN (SELECT count(*) FROM (VALUES (0), (1), (2)) e(e) WHERE (e.e * source_size + done)::DOUBLE / target <= (SELECT cut FROM cut)) ELSE 0 END)::BIGINT AS taken
FROM q
"""



def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def doubled(words: str) -> str:
    """A rule's words for a text in which every word has a space of its own on either side: RE2 has no look-ahead."""
    return " " + words.replace(" ?", "\x01").replace(" ", "  ").replace("\x01", "(?:  )?") + " "


def spaces(pieces: str) -> str:
    return f"(length(array_to_string({pieces}, '')) - length(replace(array_to_string({pieces}, ''), ' ', '')))"


def located(source: str, keep: str) -> str:
    """Word places of matches, from pieces p and matches m of a split."""
    return f"""SELECT {keep}, ({spaces('p[1:i]')} + {spaces('m[1:i - 1]')}) // 2 AS first, ({spaces('p[1:i]')} + {spaces('m[1:i]')}) // 2 AS last
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {source})"""


RULES = ", ".join(f"({quoted(label)}, {quoted(keyword)}, {quoted(licenses.keywords(label, keyword)[-1])}, {quoted(doubled(pattern))}, {level})" for label, keyword, pattern, level in licenses.rules())
PHRASES = ", ".join(f"({quoted(label)}, {quoted(doubled(phrase))})" for phrase, label in licenses.BASE)
OP4 = rf"""
WITH n AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS w FROM documents),
t AS (SELECT doc_id, ' ' || w || ' ' AS single, ' ' || replace(w, ' ', '  ') || ' ' AS t, CASE WHEN w = '' THEN 0 ELSE length(w) - length(replace(w, ' ', '')) + 1 END AS n_words FROM n),
rules(label, keyword, also, pattern, level) AS (VALUES {RULES}), phrases(label, pattern) AS (VALUES {PHRASES}),
hit AS (SELECT doc_id, label, level, regexp_split_to_array(t, pattern) AS p, regexp_extract_all(t, pattern) AS m FROM t JOIN rules ON (contains(single, keyword) OR contains(single, also)) WHERE regexp_matches(t, pattern)),
det AS ({located('hit', 'doc_id, label, level')}),
alone AS (SELECT * FROM (SELECT *, max(last) OVER (PARTITION BY doc_id, level ORDER BY first, last DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM det) WHERE before IS NULL OR last > before),
k1 AS (SELECT doc_id, label, level, first, last FROM alone WHERE level = 1),
k2 AS (SELECT * FROM k1 UNION ALL SELECT doc_id, label, level, first, last FROM alone a WHERE level = 2 AND NOT EXISTS (SELECT 1 FROM k1 b WHERE b.doc_id = a.doc_id AND b.first <= a.first AND b.last >= a.last)),
k3 AS (SELECT * FROM k2 UNION ALL SELECT doc_id, label, level, first, last FROM alone a WHERE level = 3 AND NOT EXISTS (SELECT 1 FROM k2 b WHERE b.doc_id = a.doc_id AND b.first <= a.first AND b.last >= a.last)),
bh AS (SELECT doc_id, label, regexp_split_to_array(t, pattern) AS p, regexp_extract_all(t, pattern) AS m FROM t JOIN phrases ON regexp_matches(t, pattern)),
base AS ({located('bh', 'doc_id, label')}),
b AS (SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY doc_id),
a AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, min(level) AS best FROM (SELECT doc_id, label, level FROM k3 UNION ALL SELECT doc_id, label, 1 FROM base) GROUP BY doc_id)
SELECT t.doc_id, t.n_words::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE a.best WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


def lengths(pieces: str) -> str:
    return f"length(array_to_string({pieces}, ''))"


#: The contract's patterns as they are; RE2 runs in linear time.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "secret": disclosure.SECRET}


def places(source: str, keep: str, text: str, pattern: str) -> str:
    """found, s, e: matches of a pattern with their places in code points."""
    cut = f"SELECT {keep}, regexp_split_to_array({text}, {pattern}) AS p, regexp_extract_all({text}, {pattern}) AS m FROM {source} WHERE regexp_matches({text}, {pattern})"
    return f"SELECT {keep}, m[i] AS found, {lengths('p[1:i]')} + {lengths('m[1:i - 1]')} AS s, {lengths('p[1:i]')} + {lengths('m[1:i]')} AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({cut}))"


DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
LUHN = f"""list_sum([CASE WHEN (length(d) - k) % 2 = 0 THEN substr(d, k, 1)::INT ELSE substr(d, k, 1)::INT * 2 - CASE WHEN substr(d, k, 1)::INT > 4 THEN 9 ELSE 0 END END FOR k IN range(1, length(d) + 1)]) % 10 = 0"""
VALID = f"""CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len([o FOR o IN string_split(found, '.') IF length(ltrim(o, '0')) > 3 OR coalesce(TRY_CAST(o AS DOUBLE), 999) > 255]) = 0
  WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND {LUHN} WHEN 'secret' THEN regexp_matches(found, '[0-9]|PRIVATE KEY') ELSE length(d) BETWEEN 9 AND 15 END"""
TERM = quoted(disclosure.TERM)
FOUND = " UNION ALL ".join(f"SELECT doc_id, text, {quoted(k)} AS kind, {i} AS kind_no, found, s, e FROM ({places('docs', 'doc_id, text', 'text', quoted(v))})" for i, (k, v) in enumerate(PLAIN.items()))
OP8 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
span AS (SELECT *, CASE WHEN kind = 'email' THEN kind || lower(found) WHEN kind = 'secret' THEN kind || found ELSE kind || regexp_replace(found, '[^0-9.]', '', 'g') END AS entity FROM (SELECT *, {DIGITS} AS d FROM ({FOUND})) WHERE {VALID}),
base AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_no, s) FILTER (WHERE kind <> 'secret') AS base_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_no, s) AS spans, count(*) FILTER (WHERE kind = 'secret') AS n_secret, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
  count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone FROM span GROUP BY doc_id),
side AS (
  SELECT doc_id, entity, s - length(l) AS off, l AS part FROM (SELECT *, CASE WHEN s > {disclosure.REACH} THEN regexp_replace(substr(text, s - {disclosure.REACH} + 1, {disclosure.REACH}), '^\\S*', '') ELSE substr(text, 1, s) END AS l FROM span)
  UNION ALL SELECT doc_id, entity, e AS off, CASE WHEN length(text) > e + {disclosure.REACH} THEN regexp_replace(substr(text, e + 1, {disclosure.REACH}), '\\S*$', '') ELSE substr(text, e + 1, {disclosure.REACH}) END FROM span),
near_all AS (SELECT doc_id, entity, lower(found) AS term, off + s AS s, off + e AS e FROM ({places('side', 'doc_id, entity, off', 'part', TERM)})),
near_by AS (SELECT * FROM near_all w WHERE NOT EXISTS (SELECT 1 FROM span b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
pairs AS (SELECT entity, term, count(*) AS n_te FROM near_by GROUP BY ALL),
ent AS (SELECT entity, count(*) AS n_e FROM span GROUP BY entity),
every_term AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {TERM})) AS term FROM docs) GROUP BY term),
inside AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(found), {TERM})) AS term FROM span) GROUP BY term),
total AS (SELECT sum(length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS n FROM docs),
flagged AS (SELECT p.entity, p.term FROM pairs p JOIN ent USING (entity) JOIN every_term v USING (term) LEFT JOIN inside i USING (term), total t
  WHERE log2(n_te * t.n / (greatest(v.n - coalesce(i.n, 0), n_te) * n_e)) / log2(t.n / n_e) >= {disclosure.GENERALISE_AT}),
more AS (SELECT doc_id, string_agg('term:' || s || ':' || e, ',' ORDER BY s, e) AS spans, count(*) AS n_term FROM (SELECT DISTINCT w.doc_id, w.s, w.e FROM near_by w JOIN flagged USING (entity, term)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(b.base_spans, '')) AS base_sha256, coalesce(concat_ws(',', b.spans, m.spans), '') AS spans, coalesce(n_secret, 0)::BIGINT AS n_secret, coalesce(n_term, 0)::BIGINT AS n_term
FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id)
"""

OP5 = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i : i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM b WHERE octet_length(b) >= 400)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 399 AS hi FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM again)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM (SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, NULL FROM b)),
kept AS (SELECT g.doc_id, string_agg(hex(b[g.after + 1 : g.lo - 1]), '' ORDER BY g.lo) AS x FROM gaps g JOIN b USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM b JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo + 1) AS removed, count(*) AS spans FROM runs GROUP BY doc_id) r USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) c USING (doc_id)
"""

OP10 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM o),
again AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
marked AS (
  SELECT p.doc_id, p.i, p.word, max(a.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM pos p LEFT JOIN again a ON p.doc_id = a.doc_id AND p.i = a.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, 1 AS m, unnest(w) AS p FROM w
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w WHERE len(w) > 2),
f AS (SELECT lang, m, p, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, m, p, a, string_split(p, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT lang, m, p, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM c
  UNION ALL SELECT lang, m, p, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE m = 3),
scored AS (
  SELECT u.lang, u.m, u.p, u.a, x.a AS l, y.a AS r, (1000000::HUGEINT * u.a * u.a) // (x.a * y.a) AS score, u.k
  FROM cuts u JOIN f x ON u.lang = x.lang AND u.first = x.p JOIN f y ON u.lang = y.lang AND u.rest = y.p),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, w[1] || ' ' || w[2] AS p, a FROM c WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE m = 3),
free AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = low.lang AND i.p = low.p AND low.m = 2 AND 100 * i.a >= 50 * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM free)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

OP12 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
links AS (SELECT x, count(*) AS n FROM l GROUP BY x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(links.n, 0)::BIGINT AS n_links, coalesce(low.y, e.vec_id) AS component_id, e.vec_id = coalesce(low.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN links ON links.x = e.vec_id LEFT JOIN low ON low.x = e.vec_id
"""

ORACLES: dict[str, str] = {
    "op1_site_line_dedup": OP1,
    "op3_weighted_fair_mix": OP3,
    "op4_license_signatures": OP4,
    "op5_suffix_array_dedup": OP5,
    "op8_disclosure_sanitiser": OP8,
    "op9_jaccard_rtree_join": OP9,
    "op10_substring_dedup": OP10,
    "op11_phrase_collocations": OP11,
    "op12_near_vectors": OP12,
}
