"""SQL for a second engine: the queries that plain SQL can answer."""

from __future__ import annotations

from . import url_filter
from .common import LOWER, UPPER


def _words(table: str, columns: str, pattern: str) -> str:
    """Rows of a table numbered, with the words of their lower-cased texts."""
    return f"""SELECT row_number() OVER () AS r, {columns},
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS words
  FROM {table}"""


#: words of the benchmark's rule, and words between white space
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""WITH docs AS (
  {_words("documents", "doc_id", PLAIN)}),
items AS (
  {_words("benchmark", "item_id", PLAIN)}),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
         array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS phrase
  FROM items, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS u(i) WHERE len(words) > 0),
places AS (
  SELECT r, i, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM docs, (SELECT DISTINCT size FROM windows), unnest(range(1, len(words) - size + 2)) AS u(i)),
found AS (SELECT r, i, size, item_id FROM places JOIN windows USING (size, phrase)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS u(p) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE docs AS (
  {_words("documents", "doc_id", SPACED)}),
shingles AS (
  SELECT DISTINCT r, hash(array_to_string(words[i : i + 4], ' ')) AS s
  FROM docs, unnest(range(1, greatest(len(words) - 5, 0) + 2)) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (
  SELECT a.r AS x, b.r AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON a.r = p.x JOIN sizes b ON b.r = p.y
  WHERE 100 * common >= 85 * (a.n + b.n - common)),
directed AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT r, r AS other FROM docs UNION SELECT reach.r, d.y FROM reach JOIN directed d ON d.x = reach.other),
least_id AS (
  SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.other GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id,
       doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN least_id USING (r) LEFT JOIN sizes USING (r)"""

ORACLES: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op5_url_filter": url_filter.oracle_sql(),
    "op6_near_duplicates": NEAR_DUPLICATES,
}
