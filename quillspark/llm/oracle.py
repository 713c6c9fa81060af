"""DuckDB forms of the operators' queries that plain SQL can express on whole tables."""

from __future__ import annotations

from quillspark.llm.decontamination import ORACLE_SQL as CONTAINED
from quillspark.llm.license_scan import ORACLE_SQL as LICENSES
from quillspark.llm.merkle import ORACLE_SQL as MERKLE
from quillspark.llm.spelling import ORACLE_SQL as SPELLING

WORDS = r"[w FOR w IN regexp_split_to_array({}, '[\x20\x09-\x0D]+') IF w <> '']"
SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(SMALL)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT reach.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, r, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
cut AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i FROM g JOIN f USING (g) WHERE first < doc_id), (SELECT unnest(range(13)) AS k)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN cut USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

#: Windows of 50 bytes as 100 hexadecimal digits.
SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p - 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
edge AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, s, min(p) AS a, max(p) + 49 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM edge) GROUP BY doc_id, s),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS body FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE body || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

ORACLE_SQL = {"op3_decontamination": CONTAINED, "op4_warc": WARC, "op5_jaccard_join": JACCARD, "op6_suffix_automaton": SUBSTRINGS, "op9_suffix_array": SUFFIXES, "op11_spelling_variants": SPELLING, "op12_license_scan": LICENSES, "op13_merkle_manifest": MERKLE}
