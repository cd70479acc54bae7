"""SQL that reads HTML as the kernel does: tags one by one, with the open elements as a list.

For pages whose hyperlinks are absolute or begin with a slash, with the character references of ``_REFERENCES`` only,
and without cookie dialogs.
"""

from __future__ import annotations

from pagequarry.functions import html_kernel as k
from pagequarry.functions import text as t
from pagequarry.operators import adapt, crawl
from pagequarry.plans.sql import _CHOICE, _CONTENT, _LATEST, _SCORED_FROM_P, _SIGN, _clean, _count, _normal, _paragraphs, _strip, _words


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


_TOKEN = r"""<!--[\s\S]*?-->|</?[a-zA-Z][^\s/>]*(?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?][^>]*>|(?:[^<]|<[^a-zA-Z/!?])+"""
_NAME = r"lower(regexp_extract(t, '^</?([a-zA-Z][^\s/>]*)', 1))"
_RAW = _in(k.RAW_TEXT)


def _attribute(name: str) -> str:
    return rf"""lower(regexp_extract(t, '(?i)\s{name}\s*=\s*["'']?([^"''\s>]*)', 1))"""


_REFERENCES = "t"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", chr(34)), ("nbsp", chr(0xA0)), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("copy", "©"), ("#8220", "“"), ("#8221", "”"), ("amp", "&")):
    _REFERENCES = f"replace({_REFERENCES}, '&{_name};', '{_sign}')"
PAGE_URL = f"coalesce({_normal('loadedurl')}, {_normal('url')}, {_normal('canonicalurl')}, '')"
_PAGES = f"WITH RECURSIVE pages AS (SELECT row_id, html, {PAGE_URL} AS page_url FROM dataset_rows WHERE html IS NOT NULL)"
#: From ``pages`` (row_id, html, page_url): one row per tag and text of each page, with the elements around it; u is unseen, c is chrome.
DOM = rf""", split AS (SELECT row_id, unnest(regexp_extract_all(html, '{_TOKEN}')) AS t, generate_subscripts(regexp_extract_all(html, '{_TOKEN}'), 1) AS pos FROM pages
), tok AS (
  SELECT row_id, pos, t, CASE WHEN regexp_matches(t, '^</?[a-zA-Z]') THEN {_NAME} END AS name, regexp_matches(t, '^<[!?]') AS skip,
    regexp_matches(t, '^<[a-zA-Z]') AS starts, regexp_matches(t, '^</[a-zA-Z]') AS closes, regexp_matches(t, '^<[a-zA-Z]') AND NOT t LIKE '%/>' AND {_NAME} NOT IN {_in(k.VOID)} AS opens,
    regexp_matches(t, '^<[a-zA-Z][^>]*\shidden[\s=>]') OR {_attribute("aria-hidden")} = 'true' AS hidden, {_attribute("role")} AS role, {_attribute("id")} AS id FROM split
), walk AS (
  SELECT row_id, CAST(0 AS BIGINT) AS pos, ['#document'] AS names, [CAST(0 AS BIGINT)] AS ids, [false] AS us, [false] AS cs, '' AS name, 'none' AS kind, '' AS t, '' AS within, [CAST(0 AS BIGINT)] AS around, false AS u, false AS c, '' AS role, '' AS id FROM pages
  UNION ALL
  SELECT row_id, pos, CASE WHEN text THEN names WHEN opens THEN list_append(names, name) WHEN closes AND list_contains(names[2:], name) THEN names[1:keep] ELSE names END,
    CASE WHEN text THEN ids WHEN opens THEN list_append(ids, pos) WHEN closes AND list_contains(names[2:], name) THEN ids[1:keep] ELSE ids END,
    CASE WHEN text THEN us WHEN opens THEN list_append(us, own_u) WHEN closes AND list_contains(names[2:], name) THEN us[1:keep] ELSE us END,
    CASE WHEN text THEN cs WHEN opens THEN list_append(cs, own_c) WHEN closes AND list_contains(names[2:], name) THEN cs[1:keep] ELSE cs END,
    name, CASE WHEN text THEN 'text' WHEN starts THEN 'element' ELSE 'none' END, t, names[-1], ids, CASE WHEN starts AND NOT text THEN own_u ELSE us[-1] END, CASE WHEN starts AND NOT text THEN own_c ELSE cs[-1] END, role, id
  FROM (
    SELECT w.row_id, k.pos, w.names, w.ids, w.us, w.cs, k.name, k.t, k.opens, k.closes, k.starts, k.role, k.id, w.us[-1] OR k.name IN {_in(k.UNSEEN)} OR k.hidden AS own_u, w.cs[-1] OR k.name IN {_in(k.CHROME)} AS own_c,
      len(w.names) - coalesce(list_position(list_reverse(w.names), k.name), 0) AS keep,
      CASE WHEN w.names[-1] IN {_RAW} THEN NOT (k.closes AND k.name = w.names[-1]) ELSE k.name IS NULL AND NOT k.skip END AS text
    FROM walk w JOIN tok k ON k.row_id = w.row_id AND k.pos = w.pos + 1)
), texts AS (
  SELECT row_id, pos, around, u, c, within, CASE WHEN within IN {_RAW} THEN t ELSE {_REFERENCES} END AS s FROM walk WHERE kind = 'text' AND within NOT IN {_in(k.NO_STRING)}
), elements AS (SELECT * FROM walk WHERE kind = 'element')"""

_BASE = "regexp_extract(page_url, '^[a-z]+://[^/]+')"
_LINKS = rf"""hrefs AS (
  SELECT e.row_id, e.pos, p.page_url, regexp_extract(e.t, '(?i)\shref\s*=\s*"([^"]*)"', 1) AS href, row_number() OVER (PARTITION BY e.row_id ORDER BY e.pos) AS nth
  FROM elements e JOIN pages p USING (row_id) WHERE e.name = 'a' AND regexp_matches(e.t, '(?i)\shref\s*=')
), full_hrefs AS (SELECT *, CASE WHEN href LIKE '/%' AND page_url <> '' THEN {_BASE} || href WHEN href LIKE '%://%' THEN href END AS address FROM hrefs WHERE nth <= {k.MAX_LINKS + 1}
), links AS (SELECT *, {_normal("address")} AS target FROM full_hrefs
), internal AS (SELECT *, page_url <> '' AND regexp_extract(target, '^[a-z]+://([^/:]+)', 1) = regexp_extract(page_url, '^[a-z]+://([^/:]+)', 1) AS own FROM links WHERE target IS NOT NULL)"""

#: From ``pages``: what the kernel measures, in ``measured``.
MEASURED = rf"""{DOM}, {_LINKS}, firsts AS (
  SELECT row_id, min(pos) FILTER (name = 'title') AS title_at, min(pos) FILTER (name = 'body' AND NOT u AND NOT c) AS body_at, min(pos) FILTER (name = 'meta' AND regexp_matches(t, '(?i)\sname\s*=\s*"description"')) AS described_at,
    min(pos) FILTER (name = 'link' AND regexp_matches(t, '(?i)\srel\s*=\s*"[^"]*canonical')) AS canonical_at, bool_or(name = 'script' AND regexp_matches(t, '\stype="application/ld\+json"')) AS has_json_ld,
    count(*) FILTER (name = 'script') AS scripts, bool_or(id IN {_in(k.SHELL_IDS)}) AS marked FROM elements GROUP BY 1
), titles AS (SELECT x.row_id, left(string_agg(trim(s), ' ' ORDER BY x.pos), 500) AS title FROM texts x JOIN firsts f ON f.row_id = x.row_id AND list_contains(x.around, f.title_at) WHERE trim(s) <> '' GROUP BY 1
), mains AS (
  SELECT e.row_id, e.pos, coalesce(sum(length(x.s)), 0) AS size FROM elements e LEFT JOIN texts x ON x.row_id = e.row_id AND list_contains(x.around, e.pos) AND NOT x.u AND NOT x.c
  WHERE (e.name IN ('main', 'article') OR e.role = 'main') AND NOT e.u AND NOT e.c GROUP BY 1, 2
), main AS (SELECT p.row_id, coalesce(arg_max(m.pos, m.size * 100000 - m.pos), any_value(f.body_at), 0) AS at FROM pages p LEFT JOIN mains m USING (row_id) LEFT JOIN firsts f USING (row_id) GROUP BY 1
), raws AS (SELECT row_id, length({_clean("string_agg(s, chr(10) ORDER BY pos)")}) AS n FROM texts WHERE NOT u GROUP BY 1
), bodies AS (SELECT x.row_id, {_clean("string_agg(s, chr(10) ORDER BY x.pos)")} AS body FROM texts x JOIN main m ON m.row_id = x.row_id AND list_contains(x.around, m.at) WHERE NOT u AND NOT c GROUP BY 1
), inside AS (
  SELECT e.row_id, string_agg(e.name[2:2], '' ORDER BY e.pos) FILTER (regexp_full_match(e.name, 'h[1-6]')) AS heading_levels, count(*) FILTER (e.name = 'p') AS p, count(*) FILTER (e.name IN ('ul', 'ol')) AS l,
    count(*) FILTER (e.name = 'table') AS tb, count(*) FILTER (e.name = 'pre') AS pr FROM elements e JOIN main m ON m.row_id = e.row_id AND list_contains(e.around, m.at) WHERE NOT u AND NOT c GROUP BY 1
), counted AS (SELECT row_id, count(*) FILTER (own) AS i, count(*) FILTER (NOT own) AS o FROM internal GROUP BY 1
), joined AS (SELECT p.row_id, p.html, p.page_url, coalesce(body, '') AS body, coalesce(raws.n, 0) AS raw, f.*, tt.title AS found_title, ins.*, counted.i, counted.o,
    {_normal(r"regexp_extract((SELECT any_value(e.t) FROM elements e WHERE e.row_id = p.row_id AND e.pos = f.canonical_at), 'href=.([^ >]*)[^a-zA-Z0-9/]', 1)")} AS canonical
  FROM pages p LEFT JOIN firsts f ON f.row_id = p.row_id LEFT JOIN titles tt ON tt.row_id = p.row_id LEFT JOIN raws ON raws.row_id = p.row_id LEFT JOIN bodies b ON b.row_id = p.row_id LEFT JOIN inside ins ON ins.row_id = p.row_id LEFT JOIN counted ON counted.row_id = p.row_id), measured AS (
SELECT row_id, html, body, page_url, coalesce(found_title, '') AS title, described_at IS NOT NULL AS has_meta_description, coalesce(has_json_ld, false) AS has_json_ld, canonical AS canonical_url, raw AS raw_text_chars, coalesce(heading_levels, '') AS heading_levels,
  coalesce(p, 0) AS paragraph_count, coalesce(l, 0) AS list_count, coalesce(tb, 0) AS table_count, coalesce(pr, 0) AS code_block_count, coalesce(i, 0) AS internal_link_count, coalesce(o, 0) AS external_link_count,
  {_words("body")} < 30 AND ((coalesce(marked, false) AND coalesce(scripts, 0) >= 1) OR (({" OR ".join(f"contains(html, '{s}')" for s in k.FRAMEWORK_SIGNS)}) AND coalesce(scripts, 0) >= 2) OR (coalesce(scripts, 0) >= 5 AND length(html) > 2000)) AS js_shell,
  {_words("body")} AS word_count, round_even(greatest(0.0, least(1.0, 1 - length(body) / CAST(greatest(raw, 1) AS DOUBLE))), 4) AS boilerplate_ratio, md5(body) AS text_digest
FROM joined)"""
HTML_STRUCTURE = f"{_PAGES}{MEASURED} SELECT * EXCLUDE (html, body, page_url) FROM measured"

LINK_EDGES = f"""{_PAGES}{DOM}, {_LINKS}, page_links AS (SELECT row_id, page_url, target, min(pos) AS pos FROM internal WHERE own GROUP BY 1, 2, 3
), kept AS (SELECT * FROM page_links QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pos) <= {k.MAX_LINKS})
SELECT target, count(DISTINCT page_url) AS pages FROM kept GROUP BY 1"""

CRAWL_FRONTIER = f"""{_PAGES}{DOM}, {_LINKS}, page_links AS (SELECT row_id, page_url, target, min(pos) AS pos FROM internal WHERE own GROUP BY 1, 2, 3
), kept AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS place FROM page_links
), new AS (
  SELECT target AS url, row_id, place FROM kept WHERE place <= {k.MAX_LINKS} AND target LIKE 'https://%' AND NOT contains(target, '/careers') AND NOT contains(target, '/t/') AND target NOT IN (SELECT page_url FROM pages)
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY row_id, place) = 1
), placed AS (SELECT url, row_number() OVER (ORDER BY row_id, place, url) - 1 AS ord FROM new)
SELECT url, ord FROM placed WHERE ord < {crawl.MAX_QUEUE}"""

# The audit of all delivered rows without duplicates

_DOCS = rf"""WITH RECURSIVE docs AS (
  SELECT row_id, 'dataset:' || dataset_id || ':' || row_index AS source_id, {PAGE_URL} AS page_url, field, {_CONTENT} AS content, left(coalesce(title, ''), {adapt.TITLE_CHARS}) AS given_title,
    CASE WHEN field IS NULL THEN 'dataset_row_unusable' WHEN length({_CONTENT}) > {adapt.MAX_SOURCE_CHARS} THEN 'too_large' END AS early, field = 'html' OR regexp_matches({_CONTENT}, '{_SIGN}') AS is_html
  FROM ({_CHOICE.replace("FROM dataset_rows", f"FROM ({_LATEST})")})
), pages AS (SELECT row_id, content AS html, page_url FROM docs WHERE is_html AND early IS NULL)"""
_HEADS = f"regexp_extract_all(content, '(?m){t.MD_HEADING}', 1)"
_PLAIN = f"CASE WHEN field = 'markdown' THEN {_strip('content')} ELSE content END"
_MD = "CASE WHEN field = 'markdown' THEN {} ELSE 0 END".format
_PLAIN_DOCS = rf""", plain AS (SELECT *, {_PLAIN} AS p FROM docs WHERE NOT is_html AND early IS NULL
), cleaned AS (SELECT *, {_clean("p")} AS body FROM plain
), others AS (
  SELECT row_id, body, CASE WHEN given_title = '' AND field = 'markdown' THEN coalesce(left(regexp_extract(content, '(?m){t.MD_HEADING}', 2), 500), '') ELSE given_title END AS title, false AS has_meta_description, false AS has_json_ld, NULL AS canonical_url,
    length(body) AS raw_text_chars, CASE WHEN field = 'markdown' THEN array_to_string(list_transform({_HEADS}, lambda h: length(h)), '') ELSE '' END AS heading_levels, {_paragraphs("p")} AS paragraph_count,
    {_MD(_count("content", t.MD_LIST))} AS list_count, {_MD(_count("content", "(?m)" + t.MD_TABLE))} AS table_count, {_MD(_count("content", "(?m)" + t.MD_FENCE) + " // 2")} AS code_block_count,
    0 AS internal_link_count, 0 AS external_link_count, false AS js_shell, {_words("body")} AS word_count, CASE WHEN body = '' THEN 1.0 ELSE 0.0 END AS boilerplate_ratio FROM cleaned)"""
_EVERY = f"""{_DOCS}{MEASURED}{_PLAIN_DOCS}, every AS (
  SELECT d.source_id, d.page_url AS url, d.is_html, d.early, length(d.content) AS chars, m.* FROM docs d LEFT JOIN (
    SELECT row_id, body, title, has_meta_description, has_json_ld, canonical_url, raw_text_chars, heading_levels, paragraph_count, list_count, table_count, code_block_count, internal_link_count, external_link_count, js_shell, word_count, boilerplate_ratio FROM measured
    UNION ALL SELECT * FROM others) m USING (row_id)
), stated AS (
  SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN is_html AND body = '' AND NOT js_shell THEN 'dataset_row_unusable' END AS error_code, canonical_url IS NOT NULL AS has_canonical, 'not_checked' AS duplicate_status, length(heading_levels) AS heading_count,
    CASE WHEN js_shell THEN 'likely_requires_javascript' WHEN body = '' THEN 'empty' WHEN word_count < 30 THEN 'too_short' ELSE 'ok' END AS content_status, CAST(ceil(length(body) / 4.0) AS BIGINT) AS estimated_tokens,
    CASE WHEN is_html THEN len(list_filter(range(1, length(heading_levels)), lambda i: CAST(heading_levels[i + 1:i + 1] AS INT) > CAST(heading_levels[i:i] AS INT) + 1)) ELSE 0 END AS heading_hierarchy_anomalies FROM every
), p AS (SELECT * FROM stated WHERE error_code IS NULL)"""
AUDIT_MEASURES = f"""{_EVERY}, {_SCORED_FROM_P}
SELECT source_id, url, 'audited' AS status, NULL AS error_code, content_status, title, prof AS page_profile, word_count, raw_text_chars, length(body) AS main_content_chars, CASE WHEN is_html THEN chars ELSE 0 END AS raw_html_chars, boilerplate_ratio, heading_count,
  len(list_filter(string_split(heading_levels, ''), lambda x: x = '2')) AS h2_count, heading_hierarchy_anomalies, paragraph_count, list_count, table_count, code_block_count, internal_link_count, external_link_count, has_meta_description, has_json_ld, is_html AS metadata_available,
  estimated_tokens, cents, val AS rag_value, rec AS recommended_for_rag FROM s
UNION ALL SELECT source_id, '', CASE WHEN error_code IN ('dataset_row_unusable', 'too_large') THEN 'skipped' ELSE 'failed' END, error_code, 'unavailable', '', 'short_content', 0, 0, 0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, false, false, true, 0, 0, 'low', false FROM stated WHERE error_code IS NOT NULL"""
