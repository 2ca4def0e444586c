"""DuckDB SQL for the queries that SQL can express: plain versions, without filters, sketches or exchanges of blocks."""

from __future__ import annotations

from .licenses import BREAK, PHRASES, TEMPLATES, block_words, needed
from .quality import BOILERPLATE, BOILERPLATE_WORDS, SYMBOLS, WINDOW
from .substring import SIZE
from .warc import BASE32, EPOCH, LAST

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def substring_sql(size: int = SIZE) -> str:
    """op3: every window is compared with every other, as a string."""
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), win AS MATERIALIZED (
  SELECT rid, doc_id, p, array_to_string(ws[p:p + {size - 1}], ' ') AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {size} + 2)) AS p FROM d)
), low AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g
), gone AS (
  SELECT rid, list(DISTINCT q) AS qs FROM (
    SELECT rid, unnest(range(p, p + {size})) AS q FROM win JOIN low USING (g) WHERE first_doc < doc_id) GROUP BY rid
), kept AS (
  SELECT d.rid, string_agg(w, ' ' ORDER BY q) AS words
  FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM d) AS d
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid, unnest(qs) AS q FROM gone) AS g WHERE g.rid = d.rid AND g.q = d.q)
  GROUP BY d.rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""


def near_sql(percent: int = 80) -> str:
    """op4: all pairs of distinct sets that share a shingle, then the smallest id that can be reached."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS sh FROM d
), class AS MATERIALIZED (SELECT sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh
), item AS MATERIALIZED (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM class
), link AS MATERIALIZED (
  SELECT a.rep AS u, b.rep AS v FROM item AS a JOIN item AS b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (SELECT u, v FROM link UNION ALL SELECT v, u FROM link
), reach AS (SELECT rep AS u, rep AS v FROM class UNION SELECT r.u, b.v FROM reach AS r JOIN both_ways AS b ON r.v = b.u
), label AS (SELECT u AS rep, min(v) AS component FROM reach GROUP BY u)
SELECT doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN class ON s.sh = class.sh LEFT JOIN label USING (rep)"""


def quality_sql(min_words: int = 20, max_repeat_pct: int = 30, min_left: float = 0.5, window: int = WINDOW) -> str:
    """op7: the line rules with the default limits, and windows compared as strings."""
    symbols = lambda x: f"length(regexp_replace({x}, '[^{SYMBOLS}]', '', 'g'))"
    spaces = "(len(string_split(x, ' ')))"
    times = lambda x, what: f"((strlen({x}) - strlen(replace({x}, '{what}', ''))) / {len(what.encode())})"
    phrase = " + ".join(f"{BOILERPLATE_WORDS} * {times('lower(x)', p)}" for p in BOILERPLATE)
    links = "(" + " + ".join(times("x", p) for p in ("http://", "https://", "www.")) + ")"
    menu = "(" + " + ".join(times("x", p) for p in (" > ", " » ", " · ", " • ")) + ")"
    bars = "(length(x) - length(replace(x, '|', '')))"
    shouts = "((length(x) - length(replace(x, '!!', ''))) / 2)"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), win AS MATERIALIZED (
  SELECT rid, p, array_to_string(ws[p:p + {window - 1}], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {window} + 2)) AS p FROM d)
), twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1
), rep AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT rid, unnest(range(p, p + {window})) AS q FROM win JOIN twice USING (rid, g)) GROUP BY rid
), line AS MATERIALIZED (
  SELECT rid, x,
    {symbols("x")} > 0.1::DOUBLE * length(x) OR ({bars} >= 2 AND {bars} > 0.2::DOUBLE * {spaces})
    OR ({spaces} >= 3 AND {shouts} > 0.3::DOUBLE * {spaces})
    OR ({links} >= 2 AND {links} >= 0.5::DOUBLE * {spaces}) OR ({menu} >= 3 AND {menu} > 0.2::DOUBLE * {spaces})
    OR ({phrase}) >= {spaces}
    OR ({spaces} >= 10 AND len(list_distinct(string_split(x, ' '))) < 0.4::DOUBLE * {spaces}) AS bad,
    regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g') AS solid
  FROM (SELECT rid, unnest(string_split(body, chr(10))) AS x FROM d)
), lines AS (
  SELECT rid, count(*) FILTER (solid <> '') - count(DISTINCT x) FILTER (solid <> '') AS n_dup_lines,
    count(*) FILTER (bad) AS n_bad, coalesce(sum(length(solid)) FILTER (NOT bad), 0) AS left_chars
  FROM line GROUP BY rid
), facts AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {symbols("body")}::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_bad, left_chars
  FROM d JOIN lines USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_bad = 0 OR left_chars >= {min_left}::DOUBLE * word_chars) AS kept
FROM (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_pct} * n_words AS base_failed FROM facts)"""


def license_sql(threshold: float = 0.9) -> str:
    """op10: every phrase at every word; every template in the block from each word of each text that holds tokens enough at all."""
    phrases = " UNION ALL ".join(f"SELECT {_list(p.split())} AS pw, '{label}' AS label" for p, label in PHRASES)
    templates = " UNION ALL ".join(f"SELECT {_list(sorted(set(t.split())))} AS tokens, '{name}' AS label, {needed(t, threshold)} AS need, {block_words(t)} AS words" for name, t in TEMPLATES)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BREAK[1:]}') AS ws FROM documents
), phrase AS ({phrases}), template AS ({templates}
), place AS MATERIALIZED (
  SELECT rid, label, p - 1 AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM d), phrase
  WHERE ws[p] = pw[1] AND ws[p:p + len(pw) - 1] = pw
), base AS (SELECT rid, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM place GROUP BY rid
), able AS MATERIALIZED (SELECT rid, ws, template.* FROM d, template WHERE len(list_intersect(tokens, ws)) >= need
), share AS (SELECT rid, label, len(tokens) AS n, need, len(list_intersect(tokens, ws[p:p + words - 1])) AS common FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM able)
), hit AS MATERIALIZED (SELECT rid, label, max(common / n::DOUBLE) AS share FROM share WHERE common >= need GROUP BY rid, label
), label AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS best
  FROM (SELECT rid, label, share FROM hit UNION ALL SELECT rid, label, 1.0 FROM place) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN label USING (rid)"""


def captures_sql() -> str:
    """op5: revisits by the first page of equal payloads, and places by one sort of all captures."""
    letters = " || ".join(
        f"substr('{BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
    )
    return f"""
WITH p AS MATERIALIZED (
  SELECT page_id, coalesce(html, '') AS html, split_part(regexp_replace(coalesce(url, ''), '^.*?://', ''), '#', 1) AS rest FROM pages
), q AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first, split_part(rest, '/', 1) AS host,
    substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM p
), r AS (
  SELECT page_id, payload_bytes, {letters} AS payload_digest, first,
    array_to_string(list_reverse(string_split(regexp_replace(split_part(lower(host), ':', 1), '^www[.]', ''), '.')), ',') || ')' || lower(path) AS urlkey,
    strftime(make_timestamp(({EPOCH} + page_id % {LAST}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM q
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, urlkey, captured, row_number() OVER (ORDER BY urlkey, captured, page_id) - 1 AS place
FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_window_dedup": substring_sql(),
        "op4_minhash_near": near_sql(),
        "op5_warc_captures": captures_sql(),
        "op7_line_quality": quality_sql(),
        "op10_license_scan": license_sql(),
    }
