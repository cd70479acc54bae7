"""SQL that states the same as some of the queries."""

_SQUASH = "replace(replace(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')".format
_FIELD = r"^[^\p{L}\p{N}]*([\p{L}\p{N}][^:=|\t→>]*?)(?:->|=>|[:=|\t→]|[ \x{a0}][-–—~][ \x{a0}])(.*)$"

_P3_GROUPS = rf"""
WITH t AS (
  SELECT row_id, text, {_SQUASH("text")} AS base,
    list_filter(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS ls,
    CASE WHEN regexp_full_match(text, '(?s)\s*\{{.*\}}\s*') AND json_valid(text) THEN text END AS j
  FROM dataset_rows WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')
), f AS (
  SELECT row_id, base, CASE
    WHEN j IS NOT NULL THEN list_sort(list_transform(json_keys(j), lambda k: {_SQUASH("k")} || chr(31) || {_SQUASH("coalesce(j ->> k, '')")}))
    WHEN len(list_filter(ls, lambda x: NOT regexp_matches(x, '{_FIELD}'))) = 0
      THEN list_sort(list_transform(ls, lambda x: {_SQUASH(f"regexp_extract(x, '{_FIELD}', 1)")} || chr(31) || {_SQUASH(f"regexp_extract(x, '{_FIELD}', 2)")}))
    END AS fields
  FROM t
), r AS (SELECT row_id, base, array_to_string(fields, chr(30)) AS rec FROM f
), l AS (SELECT row_id, coalesce(min(rec) OVER (PARTITION BY base), base) AS grp FROM r
), g AS (SELECT row_id, min(row_id) OVER (PARTITION BY grp) AS first_row_id FROM l)
"""

_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: All spans of 200 characters that stand in several documents.
_SPANS = """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200
), s AS (SELECT doc_id, i - 1 AS pos, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)
), k AS (SELECT h, min(doc_id) AS first FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)
), m AS (SELECT doc_id, pos, h, first FROM s JOIN k USING (h)"""
_PASSAGES = (
    _SPANS
    + """), e AS (SELECT md5(text) AS t, min(doc_id) AS rep FROM d GROUP BY 1 HAVING count(*) > 1
), c AS (SELECT doc_id, length(text) AS n, rep FROM d JOIN e ON md5(text) = t
), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g
), p AS (
  SELECT doc_id, CAST(min(pos) AS INT) AS from_char, CAST(max(pos) + 200 AS INT) AS to_char, min(first) AS first_doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM c) GROUP BY doc_id, run
  UNION ALL SELECT doc_id, 0, CAST(n AS INT), rep FROM c)"""
)

ORACLES: dict[str, str] = {
    "p8_found": _SPANS + "), t AS (SELECT DISTINCT h, doc_id FROM m) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p8_passages": _PASSAGES + " SELECT * FROM p",
    "p8_shares": _PASSAGES
    + """, n AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars FROM documents), q AS (SELECT doc_id, sum(to_char - from_char) AS covered FROM p GROUP BY 1)
SELECT doc_id, n_chars, CAST(coalesce(covered, 0) AS BIGINT) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(covered, 0) / n_chars ELSE 0.0 END AS share FROM n LEFT JOIN q USING (doc_id)""",
    "p1_found": rf"""
WITH s AS (
  SELECT source_id, min(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')) AS site
  FROM page_results WHERE url <> '' GROUP BY 1
), l AS (
  SELECT row_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM dataset_rows JOIN s ON s.source_id = 'dataset:' || dataset_id || ':' || row_index WHERE site <> ''
), n AS (
  SELECT row_id, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{_SPACE}', ' ', 'g')) AS k
  FROM l WHERE regexp_matches(line, '\p{{L}}')
), c AS (SELECT site, k FROM n GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 6)
SELECT row_id, line_no FROM n JOIN c USING (site, k)""",
    "p3_found": _P3_GROUPS + "SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id",
    "p3_records": _P3_GROUPS
    + r"""SELECT first_row_id AS record_id, count(*) AS copies FROM g GROUP BY 1
UNION ALL SELECT row_id, 1 FROM dataset_rows WHERE text IS NULL OR NOT regexp_matches(text, '[\p{L}\p{N}]')""",
}
