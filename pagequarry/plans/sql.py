"""SQL that states the same as the queries, for DuckDB. Patterns are those of ``functions.text``."""

from __future__ import annotations

from pagequarry.functions import text as t
from pagequarry.operators import report, scoring
from pagequarry.schema import COMPONENTS

_TRIM = "regexp_replace({0}, '^" + t.WS + "+|" + t.WS + "+$', '', 'g')"
_CLEAN = "array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '" + t.LB + "'), lambda x: trim(regexp_replace(x, '" + t.WS + "+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


def _trim(c: str) -> str:
    return _TRIM.replace("{0}", c)


def _clean(c: str) -> str:
    return _CLEAN.replace("{0}", c)


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _words(c: str) -> str:
    return _count(c, t.WORD)


def _paragraphs(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{t.BLANK_LINE}'), lambda x: regexp_matches(x, '{t.NOT_WS}')))"


def _strip(c: str) -> str:
    for pattern, by in ((t.MD_IMAGE, r"\1"), (t.MD_LINK, r"\1"), ("(?m)" + t.MD_MARK, ""), ("(?m)" + t.MD_FENCE_LINE, "")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


_FIELDS = ("markdown", "cleantext", "text", "content", "html")
_CHOICE = (
    "SELECT *, CASE "
    + " ".join(f"WHEN length({_trim(f)}) >= 40 THEN '{f}'" for f in _FIELDS)
    + " "
    + " ".join(f"WHEN length({_trim(f)}) > 0 THEN '{f}'" for f in _FIELDS)
    + " END AS field FROM dataset_rows"
)
_CONTENT = "CASE field " + " ".join(f"WHEN '{f}' THEN {f}" for f in _FIELDS) + " END"
_SIGN = r"(?i)<(?:!doctype|html|body|main|article|div|p|h[1-6]|script|style|nav|table|section|ul|ol)(?:[\t-\r\x{1c}-\x{20}\x{85}\x{a0}]|>)"
_LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, row_index ORDER BY ingested_at DESC, row_id DESC) AS rn FROM dataset_rows) WHERE rn = 1"

_AUDITED = """SELECT * REPLACE (coalesce(word_count, 0) AS word_count, coalesce(internal_link_count, 0) AS internal_link_count, coalesce(code_block_count, 0) AS code_block_count,
  coalesce(paragraph_count, 0) AS paragraph_count, coalesce(heading_count, 0) AS heading_count, coalesce(list_count, 0) AS list_count, coalesce(table_count, 0) AS table_count,
  coalesce(heading_hierarchy_anomalies, 0) AS heading_hierarchy_anomalies, coalesce(estimated_tokens, 0) AS estimated_tokens, coalesce(boilerplate_ratio, 0.0) AS boilerplate_ratio,
  coalesce(content_status, 'ok') AS content_status, coalesce(duplicate_status, 'not_checked') AS duplicate_status, coalesce(title, '') AS title)
FROM page_results WHERE status = 'audited'"""
_PROFILE = """CASE WHEN contains(lower(title), 'faq') OR contains(lower(title), 'frequently asked') THEN 'faq'
  WHEN word_count < 150 AND internal_link_count >= 15 THEN 'navigation_or_index' WHEN word_count < 80 THEN 'short_content'
  WHEN code_block_count > 0 OR contains(url, '/docs/') OR contains(url, '/tutorial/') THEN 'documentation'
  WHEN paragraph_count >= 2 AND heading_count > 0 THEN 'article' ELSE 'unknown' END"""
_HOLLOW = "content_status IN ('empty', 'likely_requires_javascript')"
_PARTS = {
    "content": f"least(30 * least(1.0, ln(1 + word_count) / ln(601)), CASE WHEN {_HOLLOW} THEN 3.0 ELSE 30.0 END)",
    "structure": "(CASE WHEN title <> '' THEN 4.0 ELSE 0.0 END) + 6 * least(heading_count / 3.0, 1.0) + 6 * least(paragraph_count / 4.0, 1.0) + 4 * least((list_count + table_count + code_block_count) / 2.0, 1.0) - least(heading_hierarchy_anomalies, 2)",
    "cleanliness": f"least(15 * (1 - greatest(0.0, boilerplate_ratio - 0.25) / 0.75), CASE WHEN {_HOLLOW} THEN 5.0 ELSE 1e9 END)",
    "uniqueness": "CASE duplicate_status WHEN 'unique' THEN 15.0 WHEN 'near_duplicate' THEN 5.0 WHEN 'not_checked' THEN 7.5 ELSE 0.0 END",
    "metadata": "(CASE WHEN title <> '' THEN 4.0 ELSE 0.0 END) + (CASE WHEN has_meta_description THEN 2.0 ELSE 0.0 END) + (CASE WHEN has_canonical THEN 2.0 ELSE 0.0 END) + (CASE WHEN has_json_ld THEN 2.0 ELSE 0.0 END)",
    "accessibility": "CASE content_status WHEN 'ok' THEN 10.0 WHEN 'too_short' THEN 7.0 WHEN 'empty' THEN 2.0 WHEN 'likely_requires_javascript' THEN 2.0 ELSE 0.0 END",
}
_CENTS = {c: f"CAST(round(greatest(0.0, CAST({e} AS DOUBLE)) * 100) AS BIGINT)" for c, e in _PARTS.items()}
_SCORED_FROM_P = f"""q AS (SELECT *, {_PROFILE} AS prof, {" + ".join(_CENTS.values())} AS cents FROM p), s AS (
  SELECT *, CASE WHEN prof = 'navigation_or_index' OR content_status <> 'ok' OR duplicate_status IN ('exact_duplicate', 'near_duplicate') THEN 'low'
      WHEN word_count >= 200 AND heading_count >= 2 THEN 'high' WHEN word_count >= 60 THEN 'medium' ELSE 'low' END AS val,
    cents >= 7000 AND content_status = 'ok' AND word_count >= 60 AND duplicate_status IN ('unique', 'not_checked') AND prof <> 'navigation_or_index' AS rec
  FROM q)"""
_SCORED = f"WITH p AS ({_AUDITED}), {_SCORED_FROM_P}"
_JS = "content_status = 'likely_requires_javascript'"


def _listed(*items: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{words.replace(chr(39), chr(39) * 2)}' END" for test, words in items) + "], lambda x: x IS NOT NULL)"


_DUP = "duplicate_status IN ('exact_duplicate', 'near_duplicate')"
_RECS = _listed(
    (_DUP, scoring.EXCLUDE), ("boilerplate_ratio > 0.6", scoring.FOCUS), (_JS, scoring.BROWSER), (f"NOT ({_JS}) AND word_count < 60", scoring.REVIEW_SHORT),
    ("heading_count = 0 AND word_count >= 60", scoring.KEEP_HEADINGS), ("rec", scoring.INCLUDE),
)
_REASONS = _listed(("word_count >= 200", scoring.SUBSTANTIAL), ("heading_count >= 2", scoring.STRUCTURED), ("duplicate_status = 'unique'", scoring.UNIQUE))
_ISSUES = _listed(
    ("duplicate_status = 'not_checked'", scoring.UNVERIFIED), ("duplicate_status = 'exact_duplicate'", scoring.EXACT), ("duplicate_status = 'near_duplicate'", scoring.NEAR),
    ("boilerplate_ratio > 0.6", scoring.BOILERPLATE), (_JS, scoring.NEEDS_JS), (f"NOT ({_JS}) AND word_count < 60", scoring.LITTLE), ("heading_count = 0 AND word_count >= 60", scoring.NO_HEADINGS),
)

_MIME = "lower(trim(split_part(coalesce(mime, ''), ';', 1)))"
_MOVED = "status IN (301, 302, 303, 307, 308)"
_CODE = f"""CASE WHEN status IS NULL THEN 'network_error' WHEN {_MOVED} AND coalesce(redirect_location, '') = '' THEN 'invalid_redirect' WHEN status >= 500 THEN 'http_5xx'
  WHEN status >= 400 THEN 'http_' || status WHEN NOT ({_MOVED}) AND NOT status BETWEEN 200 AND 299 THEN 'http_unexpected'
  WHEN NOT ({_MOVED}) AND {_MIME} NOT IN ('text/html', 'application/xhtml+xml', 'text/plain', 'text/markdown') THEN 'unsupported_mime'
  WHEN NOT ({_MOVED}) AND coalesce(octet_length(body), 0) > 2000000 THEN 'too_large' END"""

_W = "status = 'audited' AND duplicate_status IN ('unique', 'not_checked') AND page_profile <> 'navigation_or_index'"


def _totals(by: str = "") -> str:
    n = lambda test: f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"
    total = lambda what, test: f"CAST(coalesce(sum({what}) FILTER (WHERE {test}), 0) AS BIGINT)"
    a = "status = 'audited'"
    columns = {
        "pages_processed": "count(*)", "pages_successfully_audited": n(a), "pages_failed": n("status = 'failed'"), "pages_skipped": n("status = 'skipped'"),
        "recommended_pages": n(f"{a} AND recommended_for_rag"), "low_value_pages": n(f"{a} AND rag_value = 'low'"), "unique_pages": n(f"{a} AND duplicate_status = 'unique'"),
        "exact_duplicates": n(f"{a} AND duplicate_status = 'exact_duplicate'"), "near_duplicates": n(f"{a} AND duplicate_status = 'near_duplicate'"),
        "duplicates_not_checked": n(f"{a} AND duplicate_status = 'not_checked'"), "likely_js_pages": n(f"{a} AND {_JS}"),
        "estimated_corpus_tokens": total("estimated_tokens", f"{a} AND recommended_for_rag"), "estimated_analyzed_tokens": total("estimated_tokens", a), "score_denominator": n(_W),
        "weighted_score_cents": total("CAST(round(rag_readiness_score * 100) AS BIGINT)", _W), "analyzed_score_cents": total("CAST(round(rag_readiness_score * 100) AS BIGINT)", a),
    }
    columns |= {f"{c}_cents": total(f"CAST(round(score_breakdown.{c} * 100) AS BIGINT)", _W) for c in COMPONENTS}
    return "SELECT " + (by + ", " if by else "") + ", ".join(f"{e} AS {k}" for k, e in columns.items()) + " FROM page_results" + (f" GROUP BY {by}" if by else "")


_TRACK = "(?:utm_.*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|_ga|_gl)"


def _normal(c: str) -> str:
    """A normalized address, of plain ASCII addresses without escapes in their query."""
    host = rf"regexp_replace(lower(regexp_extract({c}, '^(?i:https?)://([^/?#:]+)', 1)), '\.+$', '')"
    port = f"regexp_extract({c}, '^(?i:https?)://[^/?#:]+:([0-9]*)', 1)"
    scheme = f"lower(regexp_extract({c}, '^([a-zA-Z]+)://', 1))"
    path = f"regexp_extract({c}, '^(?i:https?)://[^/?#]+([^?#]*)', 1)"
    query = rf"regexp_extract({c}, '\?([^#]*)', 1)"
    kept = f"list_filter(string_split({query}, '&'), lambda x: contains(x, '=') AND NOT regexp_full_match(lower(split_part(x, '=', 1)), '{_TRACK}'))"
    # One value per key occurs here, so sorting by pair is sorting by key.
    joined = f"array_to_string(list_sort({kept}), '&')"
    explicit = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
    return rf"""CASE WHEN regexp_full_match({c}, '(?i:https?)://[^/?#:@\s]+(?::(?:80|443)?)?(?:[/?#][^\s]*)?') THEN {scheme} || '://' || {host} || {explicit} ||
      CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END END"""


ORACLES: dict[str, str] = {
    "source_rows": "SELECT 'dataset:' || dataset_id || ':' || row_index AS source_id, row_index, " + ", ".join(f"length({c}) AS {c}_chars" for c in (*_FIELDS, "title")) + " FROM dataset_rows",
    "row_limit": f"WITH j AS (SELECT dataset_id, max(max_pages) AS m FROM audit_jobs WHERE dataset_id IS NOT NULL GROUP BY 1) SELECT r.dataset_id, r.row_index FROM ({_LATEST}) r JOIN j USING (dataset_id) WHERE row_index < m",
    "redelivered_rows": f"SELECT row_id, dataset_id, row_index FROM ({_LATEST})",
    "job_problems": """SELECT job_id, CAST((NOT max_pages BETWEEN 1 AND 1000)::INT + (NOT max_depth BETWEEN 0 AND 10)::INT + (NOT max_concurrency BETWEEN 1 AND 8)::INT + (NOT request_timeout_secs BETWEEN 5 AND 60)::INT
  + (len(coalesce(include_patterns, [])) > 20 OR len(list_filter(coalesce(include_patterns, []), lambda x: x = '' OR length(x) > 200)) > 0)::INT
  + (len(coalesce(exclude_patterns, [])) > 20 OR len(list_filter(coalesce(exclude_patterns, []), lambda x: x = '' OR length(x) > 200)) > 0)::INT AS BIGINT) AS problems FROM audit_jobs""",
    "content_choice": f"SELECT row_id, field, length({_CONTENT}) AS chars, CASE WHEN field IS NULL THEN 'dataset_row_unusable' WHEN length({_CONTENT}) > 1000000 THEN 'too_large' END AS error_code FROM ({_CHOICE})",
    "html_sniff": f"SELECT row_id, field, field = 'html' OR regexp_matches({_CONTENT}, '{_SIGN}') AS is_html FROM ({_CHOICE}) WHERE field IS NOT NULL",
    "url_choice": f"SELECT row_id, coalesce({_normal('loadedurl')}, {_normal('url')}, {_normal('canonicalurl')}, '') AS page_url FROM dataset_rows",
    "titles": "SELECT row_id, substring(coalesce(title, ''), 1, 500) AS title FROM dataset_rows",
    "word_counts": f"SELECT doc_id, {_words('text')} AS words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "clean_documents": f"""WITH c AS (SELECT doc_id, {_clean('text')} AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(x) AS digest, length(x) AS chars, CASE WHEN x = '' THEN 'empty' WHEN {_words('x')} < 30 THEN 'too_short' ELSE 'ok' END AS content_status FROM c""",
    "paragraph_counts": f"SELECT doc_id, {_paragraphs('text')} AS paragraphs FROM documents WHERE text IS NOT NULL",
    "markdown_structure": f"""WITH m AS (SELECT row_id, markdown AS m, regexp_extract_all(markdown, '(?m){t.MD_HEADING}', 1) AS h, regexp_extract_all(markdown, '(?m){t.MD_HEADING}', 2) AS ht FROM dataset_rows WHERE markdown IS NOT NULL)
SELECT row_id, len(h) AS headings, {", ".join(f"len(list_filter(h, lambda x: length(x) = {k})) AS h{k}" for k in (1, 2, 3))}, substring(ht[1], 1, 500) AS heading_title,
  {_count('m', t.MD_LIST)} AS lists, {_count('m', '(?m)' + t.MD_TABLE)} AS tables, {_count('m', '(?m)' + t.MD_FENCE)} // 2 AS code_blocks FROM m""",
    "markdown_plain": f"WITH m AS (SELECT row_id, {_strip('markdown')} AS s FROM dataset_rows WHERE markdown IS NOT NULL) SELECT row_id, md5({_clean('s')}) AS digest, {_paragraphs('s')} AS paragraphs FROM m",
    "html_metadata": r"""SELECT row_id, length(html) AS raw_html_chars,
  trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title, regexp_matches(html, '<meta name="description" content="[^"]*[^"\s][^"]*"') AS has_meta_description,
  regexp_matches(html, '<script type="application/ld\+json"') AS has_json_ld FROM dataset_rows WHERE html <> ''""",
    "url_hosts": "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS results FROM page_results WHERE url <> '' GROUP BY 1",
    "glob_filter": """WITH p AS (SELECT url, split_part(source_id, ':', 2) AS dataset_id FROM page_results WHERE url <> '' AND source_type = 'dataset'),
j AS (SELECT job_id, dataset_id, coalesce(include_patterns, []) AS i, coalesce(exclude_patterns, []) AS e FROM audit_jobs WHERE dataset_id IS NOT NULL)
SELECT job_id, count(*) AS urls, count(*) FILTER (WHERE (len(i) = 0 OR len(list_filter(i, lambda x: url GLOB x)) > 0) AND len(list_filter(e, lambda x: url GLOB x)) = 0) AS selected FROM p JOIN j USING (dataset_id) GROUP BY 1""",
    "exact_duplicates": """WITH n AS (SELECT doc_id, sha256(text) AS raw, sha256(replace(lower(trim(regexp_replace(text, '[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}]+', ' ', 'g'))), 'ß', 'ss')) AS norm FROM documents WHERE text <> ''),
f AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(raw) OVER w AS first_raw FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id))
SELECT doc_id, first_id AS duplicate_of, CASE WHEN raw = first_raw THEN 'exact' ELSE 'normalized_exact' END AS duplicate_match FROM f WHERE doc_id <> first_id""".replace("\\\\", "\\"),
    "shingle_weights": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{t.WORD}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, count(*) AS shingles, CAST(sum(least(n, 3)) AS BIGINT) AS weight FROM c GROUP BY 1""",
    "page_profiles": f"SELECT result_id, {_PROFILE} AS profile FROM ({_AUDITED})",
    "score_components": "SELECT result_id, " + ", ".join(f"{e} AS {c}_cents" for c, e in _CENTS.items()) + f" FROM ({_AUDITED})",
    "rescored": _SCORED + " SELECT result_id, cents, CASE WHEN cents >= 8500 THEN 'excellent' WHEN cents >= 7000 THEN 'good' WHEN cents >= 5000 THEN 'mixed' ELSE 'poor' END AS rag_readiness_level, val AS rag_value, rec AS recommended_for_rag FROM s",
    "explanations": _SCORED + f" SELECT result_id, array_to_string({_REASONS}, '|') AS reasons, array_to_string({_ISSUES}, '|') AS issues, CASE WHEN len({_RECS}) = 0 THEN '{scoring.REVIEW_SCORE}' ELSE array_to_string({_RECS}, '|') END AS recommendations FROM s",
    "chunk_advice": f"""WITH p AS (SELECT *, {_PROFILE} AS prof, estimated_tokens AS k FROM ({_AUDITED})), c AS (SELECT result_id, k, CASE WHEN k = 0 THEN 1 WHEN k <= 256 THEN 2 WHEN prof = 'faq' THEN 3 WHEN k > 2000 AND heading_count >= 5 THEN 4 WHEN k <= 600 THEN 5 ELSE 6 END AS n FROM p)
SELECT result_id, CASE n WHEN 1 THEN 0 WHEN 2 THEN k WHEN 3 THEN 256 WHEN 4 THEN 768 WHEN 5 THEN 384 ELSE 512 END AS chunk_size, CAST(CASE n WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 32 WHEN 4 THEN 96 WHEN 5 THEN 48 ELSE 64 END AS BIGINT) AS chunk_overlap,
  CASE n WHEN 1 THEN '{scoring.CHUNK_NONE}' WHEN 2 THEN '{scoring.CHUNK_ONE}' WHEN 3 THEN '{scoring.CHUNK_FAQ}' WHEN 4 THEN '{scoring.CHUNK_HEADINGS}' WHEN 5 THEN '{scoring.CHUNK_SMALL}' ELSE '{scoring.CHUNK_SECTIONS}' END AS reason FROM c""",
    "response_outcomes": f"""WITH s AS (SELECT *, {_CODE} AS code FROM capture_snapshot)
SELECT capture_id, {_MIME} AS mime_type, CASE WHEN code IS NOT NULL THEN 'failed' WHEN {_MOVED} THEN 'redirect' ELSE 'document' END AS outcome, code AS error_code,
  CASE WHEN code = 'network_error' THEN 'HTTP transport failed.' WHEN code = 'invalid_redirect' THEN 'Redirect is missing Location.' WHEN code = 'http_unexpected' THEN 'Unexpected HTTP ' || status || '.' WHEN code = 'unsupported_mime' THEN 'Response content type is not supported.'
    WHEN code = 'too_large' THEN 'Response exceeds the body size limit.' WHEN code IS NOT NULL THEN 'HTTP ' || status || ' response.' END AS message FROM s""",
    "response_diagnostics": f"""WITH s AS (SELECT {_CODE} AS error_code FROM capture_snapshot)
SELECT CASE WHEN error_code IN ('unsupported_mime', 'too_large') THEN 'skipped' ELSE 'failed' END AS status, error_code, CASE WHEN error_code = 'unsupported_mime' THEN 'unsupported' ELSE 'unavailable' END AS content_status, count(*) AS responses
FROM s WHERE error_code IS NOT NULL GROUP BY ALL""",
    "report_totals": _totals(),
    "report_by_type": _totals("source_type, page_profile"),
    "report_median": "SELECT median(rag_readiness_score) AS median_analyzed_score FROM page_results WHERE status = 'audited'",
    "report_top_issues": f"SELECT issue, count(*) AS count FROM (SELECT unnest(list_distinct(issues)) AS issue FROM page_results) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {report.TOP_ISSUES}",
    "report_violations": f"SELECT pages_processed - pages_successfully_audited - pages_failed - pages_skipped AS unaccounted_pages, pages_successfully_audited - unique_pages - exact_duplicates - near_duplicates - duplicates_not_checked AS unaccounted_duplicates, greatest(recommended_pages - pages_successfully_audited, 0) AS excess_recommended FROM ({_totals()})",
    "recommended_rows": "SELECT row_id, 'dataset:' || dataset_id || ':' || row_index AS source_id FROM dataset_rows WHERE 'dataset:' || dataset_id || ':' || row_index IN (SELECT source_id FROM page_results WHERE recommended_for_rag AND status = 'audited')",
    "split_outputs": "SELECT CASE WHEN status = 'audited' THEN 'pages' ELSE 'diagnostics' END AS output, status, count(*) AS results FROM page_results GROUP BY ALL",
}
