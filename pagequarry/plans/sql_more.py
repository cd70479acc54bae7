"""SQL of near-duplicates, addresses and redirects: rules that go row by row, as recursive queries."""

from __future__ import annotations

from pagequarry.functions import urls
from pagequarry.operators import dedup
from pagequarry.plans.sql import _CODE, _MIME, _MOVED, _normal, _words
from pagequarry.sources import snapshot

_SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}]+"
_NORM = f"replace(lower(trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))), 'ß', 'ss')"
_VOTES = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN w ELSE -w END) > 0 AS b{b}" for b in range(64))
_BITS = " + ".join(f"CASE WHEN b{b} THEN CAST({1 << b} AS UBIGINT) ELSE 0 END" for b in range(64))
NEAR_DUPLICATES_MD5 = rf"""WITH RECURSIVE n AS (
  SELECT doc_id, sha256(text) AS raw, {_NORM} AS norm, {_words("text")} AS words FROM documents WHERE text <> ''
), f AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(raw) OVER w AS first_raw FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id)
), ws AS (SELECT doc_id, words, {_words("norm").removeprefix("len(").removesuffix(")")} AS w FROM f WHERE doc_id = first_id AND words >= {dedup.MIN_WORDS}
), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM ws
), c AS (SELECT doc_id, md5(g) AS m, least(count(*), 3) AS w FROM g GROUP BY 1, g
), h AS (SELECT doc_id, w, CAST(('0x' || m[1:16]) AS UBIGINT) AS h FROM c
), v AS (SELECT doc_id, {_VOTES} FROM h GROUP BY 1
), s AS (SELECT doc_id, words, {_BITS} AS bits FROM v JOIN ws USING (doc_id)
), near AS (
  SELECT a.doc_id AS lo, b.doc_id AS hi, bit_count(xor(a.bits, b.bits)) AS d FROM s a JOIN s b ON a.doc_id < b.doc_id
  WHERE bit_count(xor(a.bits, b.bits)) <= {dedup.MAX_DISTANCE} AND least(a.words, b.words) >= {dedup.MIN_RATIO} * greatest(a.words, b.words)
), nodes AS (SELECT hi, list(lo) AS los, row_number() OVER (ORDER BY hi) AS k FROM near GROUP BY 1
), walk AS (  -- in order, each that has no earlier representative near is one itself
  SELECT CAST(0 AS BIGINT) AS k, list(DISTINCT lo) AS reps FROM near WHERE lo NOT IN (SELECT hi FROM near)
  UNION ALL SELECT n.k, CASE WHEN list_has_any(w.reps, n.los) THEN w.reps ELSE list_append(w.reps, n.hi) END FROM walk w JOIN nodes n ON n.k = w.k + 1
), reps AS (SELECT unnest(reps) AS r FROM walk QUALIFY row_number() OVER (ORDER BY k DESC) = 1
), target AS (SELECT hi, arg_min(lo, CAST(d AS HUGEINT) * 1000000000000 + lo) AS to_id, min(d) AS d FROM near WHERE lo IN (SELECT r FROM reps) AND hi NOT IN (SELECT r FROM reps) GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id <> first_id THEN 'exact_duplicate' ELSE 'near_duplicate' END AS duplicate_status, CASE WHEN doc_id <> first_id THEN coalesce(to_id, first_id) ELSE to_id END AS duplicate_of,
  CASE WHEN doc_id <> first_id THEN 1.0 ELSE round(1 - d / 64.0, 6) END AS similarity, CASE WHEN doc_id = first_id THEN 'simhash_64' WHEN raw = first_raw THEN 'exact' ELSE 'normalized_exact' END AS duplicate_match
FROM f LEFT JOIN target ON hi = first_id WHERE doc_id <> first_id OR to_id IS NOT NULL"""

# Networks that are not public, as first and last number.
_NOT_PUBLIC = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


_VALUE = "list_reduce(list_transform(string_split(x, '.'), lambda p: CAST(p AS BIGINT)), lambda a, b: a * 256 + b)"
_PRIVATE = " OR ".join(f"{_VALUE} BETWEEN {_number(n)} AND {_number(n) + (1 << 32 - bits) - 1}" for n, bits in _NOT_PUBLIC)
PUBLIC_ADDRESSES = f"""SELECT capture_id, coalesce(len(resolved_ips), 0) > 0 AND len(list_filter(resolved_ips, lambda x: x IS NULL OR NOT regexp_full_match(x, '(?:[0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}') OR {_PRIVATE})) = 0 AS public FROM capture_snapshot"""


def _host(c: str) -> str:
    return f"regexp_extract({c}, '^[a-z]+://([^/:]+)', 1)"


_LOCAL = "(" + " OR ".join(["{0} = 'localhost'", *(f"{{0}} LIKE '%{s}'" for s in urls.LOCAL_SUFFIXES)]) + ")"


def _walk(asked: str) -> str:
    """Where the addresses of ``asked`` (url) lead: url, final_url, code, status."""
    why = f"""CASE WHEN {_host("w.at")} <> {_host("w.url")} THEN 'off_host' WHEN {_LOCAL.format(_host("w.at"))} THEN 'blocked_by_ssrf_policy' WHEN list_contains(w.path, w.at) THEN 'redirect_loop' WHEN k.u IS NULL THEN 'network_error'
      WHEN k.code IS NOT NULL THEN k.code WHEN k.moved AND k.next IS NULL THEN 'invalid_url' WHEN w.at LIKE 'https:%' AND k.moved AND k.next LIKE 'http:%' THEN 'unsafe_redirect' WHEN k.moved AND w.hop = {snapshot.MAX_REDIRECTS} THEN 'too_many_redirects' END"""
    return f"""WITH RECURSIVE captured AS (SELECT *, {_normal("url")} AS u FROM capture_snapshot
), last AS (SELECT * FROM captured WHERE u IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u ORDER BY captured_at DESC, capture_id DESC) = 1
), known AS (SELECT u, status, {_CODE} AS code, {_MOVED} AS moved, {_normal("redirect_location")} AS next, {_MIME} AS mime, body FROM last
), asked AS ({asked}
), walk AS (
  SELECT url, url AS at, 0 AS hop, CAST([] AS VARCHAR[]) AS path FROM asked
  UNION ALL SELECT w.url, k.next, w.hop + 1, list_append(w.path, w.at) FROM walk w JOIN known k ON k.u = w.at WHERE k.moved AND ({why}) IS NULL
), ends AS (SELECT w.url, w.at AS final_url, {why} AS code, k.status, k.mime, k.body, k.moved FROM walk w LEFT JOIN known k ON k.u = w.at)"""


FOLLOWED_REDIRECTS = _walk("SELECT DISTINCT u AS url FROM known WHERE code IS NULL AND moved") + " SELECT url, final_url, code AS error_code, status AS http_status FROM ends WHERE code IS NOT NULL OR NOT coalesce(moved, false)"
_STARTS = f"SELECT DISTINCT {_normal('start_url')} AS start_url FROM audit_jobs WHERE run_mode = 'website' AND start_url IS NOT NULL"
_ROOT = "regexp_extract(start_url, '^[a-z]+://[^/]+/')"
_FILES = f"SELECT start_url, name, {_ROOT} || name AS url FROM ({_STARTS}), (VALUES ('llms.txt'), ('llms-full.txt')) v(name) WHERE start_url IS NOT NULL"
_TEXT = "decode(coalesce(body, ''::BLOB))"
_PAGE = f"(mime IN ('text/html', 'application/xhtml+xml') OR contains(lower({_TEXT}), '<html'))"
SITE_FILES = (
    _walk(f"SELECT url FROM ({_FILES})")
    + f""", finals AS (SELECT * REPLACE (CASE WHEN code IS NULL AND octet_length(body) > {snapshot.MAX_AUXILIARY_BYTES} THEN 'too_large' ELSE code END AS code) FROM ends WHERE code IS NOT NULL OR NOT coalesce(moved, false))
SELECT start_url, name, CASE WHEN code IS NULL THEN trim({_TEXT}) <> '' AND NOT {_PAGE} WHEN status IN (404, 410) THEN false END AS present, status, CASE WHEN code IS NULL AND {_PAGE} THEN 'html_response' ELSE code END AS error
FROM ({_FILES}) JOIN finals USING (url)"""
)

_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1)"
ROBOTS_PERMISSIONS = rf"""SELECT DISTINCT url, CASE WHEN regexp_matches({_PATH}, '^/docs/item-.*5$') THEN false WHEN regexp_matches({_PATH}, '^/blog/.*-1') THEN true WHEN {_PATH} LIKE '/blog/%' THEN false
  WHEN {_PATH} LIKE '/docs/%' THEN true WHEN contains({_PATH}, '?') THEN false ELSE true END AS allowed FROM page_results WHERE url <> ''"""
SITEMAP_ENTRIES = """SELECT capture_id, CASE WHEN status = 404 THEN NULL WHEN status = 301 THEN 'sitemapindex' ELSE 'urlset' END AS kind,
  CASE WHEN status = 404 THEN '' WHEN redirect_location IS NULL OR redirect_location = url THEN url ELSE url || '|' || redirect_location END AS urls, false AS truncated, CASE WHEN status = 404 THEN 'malformed_sitemap' END AS error
FROM capture_snapshot WHERE url IS NOT NULL"""
_SAID = {"max_pages": (1, 1000), "max_depth": (0, 10), "max_concurrency": (1, 8), "request_timeout_secs": (5, 60)}
_WRONG = [f"CASE WHEN NOT {c} BETWEEN {lo} AND {hi} THEN '{c} must be an integer between {lo} and {hi}.' END" for c, (lo, hi) in _SAID.items()]
_WRONG += [f"CASE WHEN len({c}) > 20 THEN '{c} must be a list of at most 20 URL globs.' END" for c in ("include_patterns", "exclude_patterns")]
_WRONG += [
    f"CASE WHEN len({c}) <= 20 AND len(list_filter({c}, lambda x: x IS NULL OR length(x) NOT BETWEEN 1 AND 200)) > 0 THEN '{c} must contain nonempty glob strings up to 200 characters.' END" for c in ("include_patterns", "exclude_patterns")
]
_WRONG.append("""CASE WHEN coalesce(run_mode, 'website') NOT IN ('website', 'dataset') THEN 'mode must be website or dataset.' WHEN coalesce(run_mode, 'website') = 'website' AND trim(coalesce(start_url, '')) = '' THEN 'Provide a website URL.'
  WHEN run_mode = 'dataset' AND NOT regexp_full_match(coalesce(dataset_id, ''), '[A-Za-z0-9_-]{1,100}(?:~[A-Za-z0-9_-]{1,100})?') THEN 'Provide a dataset ID or owner~dataset name, not a URL.' END""")
JOB_VALIDATION = f"SELECT job_id, array_to_string(list_filter([{', '.join(_WRONG)}], lambda x: x IS NOT NULL), '|') AS problems FROM audit_jobs"
