"""Captured websites: responses, robots, sitemaps, redirects, crawl order."""

import gzip
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagequarry.config import AuditConfig
from pagequarry.operators import crawl
from pagequarry.sources import robots, sitemap, snapshot

SCHEMA = "capture_id long, url string, status int, mime string, redirect_location string, body binary, resolved_ips array<string>, captured_at timestamp"
IPS = ["8.8.8.8"]
BODY = "Readers of this page learn how a bounded crawl keeps its order while captured answers are joined level by level. "


def page(title, links=(), text=BODY):
    return f"<html><head><title>{title}</title></head><body><main><h1>{title}</h1><p>{text * 6}</p>{''.join(f'<a href={u!r}>x</a>' for u in links)}</main></body></html>"


def capture(spark, pages):
    now = datetime(2026, 1, 1)
    rows = []
    for i, (url, spec) in enumerate(pages):
        s = {"status": 200, "mime": "text/html; charset=utf-8", "location": None, "body": "", "ips": IPS} | spec
        body = s["body"].encode() if isinstance(s["body"], str) else s["body"]
        rows.append((i, url, s["status"], s["mime"], s["location"], body, s["ips"], now + timedelta(seconds=i)))
    return spark.createDataFrame(rows, SCHEMA)


SITE = [
    ("https://e.com/robots.txt", {"mime": "text/plain", "body": "User-agent: *\nDisallow: /private\nSitemap: https://e.com/map.xml\n"}),
    ("https://e.com/map.xml", {"mime": "application/xml", "body": "<urlset><url><loc>https://e.com/mapped</loc></url><url><loc>https://other.com/x</loc></url></urlset>"}),
    ("https://e.com/", {"body": page("Start", ["/a", "/b", "/private/x", "/a#again", "https://other.com/", "/moved", "/gone.pdf"])}),
    ("https://e.com/a", {"body": page("A", ["/deep"], "Another subject altogether fills the page that carries the first letter and nothing of the start. ")}),
    ("https://e.com/b", {"body": page("Start", ["/a", "/b", "/private/x", "/a#again", "https://other.com/", "/moved", "/gone.pdf"])}),
    ("https://e.com/private/x", {"body": page("P")}),
    ("https://e.com/mapped", {"body": page("M", (), "Sitemaps name pages that no link on the start page leads to, which is why they are read first of all. ")}),
    ("https://e.com/moved", {"status": 301, "location": "/a"}),
    ("https://e.com/gone.pdf", {"mime": "application/pdf"}),
    ("https://e.com/deep", {"status": 404}),
]


def run(spark, config, site=SITE, **more):
    pages, warnings = crawl.audit_site(capture(spark, site), config, **more)
    return pages.collect(), warnings


def test_site(spark):
    pages, warnings = run(spark, AuditConfig(mode="website", start_url="https://e.com", max_depth=2, max_pages=50))
    got = {p.source_id.removeprefix("https://e.com"): p for p in pages}
    assert set(got) == {"/", "/a", "/b", "/private/x", "/mapped", "/moved", "/gone.pdf", "/deep"}
    assert got["/b"].duplicate_status == "exact_duplicate" and got["/b"].duplicate_of == "https://e.com/"
    assert (got["/private/x"].error_code, got["/private/x"].status) == ("robots_disallowed", "skipped")
    assert (got["/gone.pdf"].error_code, got["/gone.pdf"].content_status) == ("unsupported_mime", "unsupported")
    assert (got["/deep"].error_code, got["/deep"].http_status, got["/deep"].status) == ("http_404", 404, "failed")
    assert (got["/moved"].error_code, got["/moved"].status) == ("redirect_alias", "skipped")
    assert got["/"].robots_checked and got["/"].robots_allowed and got["/"].robots_url == "https://e.com/robots.txt"
    assert got["/mapped"].status == "audited" and not warnings


def test_limits_and_patterns(spark):
    pages, warnings = run(spark, AuditConfig(mode="website", start_url="https://e.com", max_depth=1, max_pages=2, exclude_patterns=("*/mapped",)))
    assert {p.source_id for p in pages} == {"https://e.com/", "https://e.com/a"} and warnings == [crawl.PARTIAL]
    pages, _ = run(spark, AuditConfig(mode="website", start_url="https://e.com", max_depth=0))
    assert len(pages) == 1


def test_without_robots(spark):
    pages, warnings = run(spark, AuditConfig(mode="website", start_url="https://e.com", max_depth=0), SITE[2:])
    assert pages[0].error_code == "robots_disallowed" and "network_error" in warnings[0]
    pages, _ = run(spark, AuditConfig(mode="website", start_url="https://e.com", max_depth=0, respect_robots_txt=False), SITE[2:])
    assert pages[0].status == "audited" and pages[0].robots_allowed is None


def test_redirects(spark):
    hop = lambda a, b: (f"https://e.com/{a}", {"status": 302, "location": b})
    site = [
        *[hop(f"r{i}", f"/r{i + 1}") for i in range(8)], hop("loop1", "/loop2"), hop("loop2", "/loop1"), hop("none", None), hop("down", "http://e.com/a"), hop("away", "https://o.com/"), hop("bad", "ftp://x"),
        hop("ok", "a"), ("https://e.com/a", {"body": "x"}), ("https://e.com/local", {"ips": ["10.0.0.1"], "body": "x"}), ("https://e.com/dead", {"status": None}),
    ]
    known = snapshot.classify(capture(spark, site))
    asked = spark.createDataFrame([(f"https://e.com/{x}", "e.com") for x in ("r0", "r3", "loop1", "none", "down", "away", "bad", "ok", "local", "dead", "unknown")], "url string, start_host string")
    got = {r.url.rsplit("/", 1)[1]: (r.error and r.error.code, r.final_url) for r in snapshot.resolve(asked, known).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "r0": "too_many_redirects", "r3": "network_error", "loop1": "redirect_loop", "none": "invalid_redirect", "down": "unsafe_redirect", "away": "off_host", "bad": "invalid_url", "ok": None,
        "local": "blocked_by_ssrf_policy", "dead": "network_error", "unknown": "network_error",
    }
    assert got["ok"][1] == "https://e.com/a"


def test_auxiliary_files_that_redirect(spark):
    """robots.txt, sitemaps and llms files are followed; what does not resolve is not used, and refused for robots."""
    moved = [
        ("https://e.com/robots.txt", {"status": 301, "location": "/rules.txt"}), ("https://e.com/rules.txt", {"mime": "text/plain", "body": "User-agent: *\nDisallow: /private\nSitemap: https://e.com/map.xml\n"}),
        ("https://e.com/map.xml", {"status": 302, "location": "/maps/new.xml"}), ("https://e.com/maps/new.xml", {"mime": "application/xml", "body": "<urlset><url><loc>/mapped</loc></url></urlset>"}), *SITE[2:],
        ("https://e.com/llms.txt", {"status": 307, "location": "/about.txt"}), ("https://e.com/about.txt", {"mime": "text/plain", "body": "# e"}), ("https://e.com/llms-full.txt", {"mime": "text/plain", "body": "x" * 300_000}),
    ]
    pages, warnings = run(spark, AuditConfig(mode="website", start_url="https://e.com", max_depth=1), moved)
    got = {p.source_id.removeprefix("https://e.com"): p for p in pages}
    assert got["/private/x"].error_code == "robots_disallowed" and "/mapped" in got and not warnings
    known = crawl.responses(capture(spark, moved))
    files = {r.name: (r.present, r.status, r.error) for r in snapshot.text_files(spark.createDataFrame([("https://e.com/",)], "start_url string"), known).collect()}
    assert files == {"llms.txt": (True, 200, None), "llms-full.txt": (None, 200, "too_large")}
    away = [("https://e.com/robots.txt", {"status": 301, "location": "https://other.com/robots.txt"}), ("https://other.com/robots.txt", {"mime": "text/plain", "body": "User-agent: *\nAllow: /"}), *SITE[1:]]
    rules = crawl.site_rules("https://e.com/", crawl.responses(capture(spark, away)))
    assert not rules.allowed("https://e.com/a") and "off_host" in rules.warning


def test_long_robots_files_are_refused(spark):
    long = [("https://e.com/robots.txt", {"mime": "text/plain", "body": "User-agent: *\n" + "# x\n" * 80_000 + "Disallow: /\n"})]
    rules = crawl.site_rules("https://e.com/", crawl.responses(capture(spark, long)))
    assert not rules.allowed("https://e.com/a") and "too_large" in rules.warning


def test_text_files(spark):
    site = [("https://e.com/llms.txt", {"mime": "text/plain", "body": "# e"}), ("https://e.com/llms-full.txt", {"mime": "text/html", "body": "<html>"}), ("https://f.com/llms.txt", {"status": 404})]
    starts = spark.createDataFrame([("https://e.com/",), ("https://f.com/",)], "start_url string")
    got = {(r.start_url[8], r.name): (r.present, r.error) for r in snapshot.text_files(starts, snapshot.classify(capture(spark, site))).collect()}
    assert got == {("e", "llms.txt"): (True, None), ("e", "llms-full.txt"): (False, "html_response"), ("f", "llms.txt"): (False, "http_404"), ("f", "llms-full.txt"): (None, "network_error")}


@pytest.mark.parametrize(
    ("body", "status", "error", "allowed"),
    [
        ("User-agent: *\nDisallow: /", 200, None, False), ("", 200, None, True), ("<html>", 200, None, False), ("nonsense", 200, None, False), (None, 404, "http_404", True), (None, 503, "http_5xx", False),
        ("User-agent: pagequarry\nAllow: /\n\nUser-agent: *\nDisallow: /", 200, None, True), ("User-agent: *\nDisallow: /*.html$\nAllow: /x.html$", 200, None, True), ("User-agent: *\nDisallow: /x", 200, None, False),
    ],
)
def test_robots(body, status, error, allowed):
    assert robots.rules("r", body, status, error).allowed("https://e.com/x.html") is allowed


def test_sitemaps(spark):
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/1 </loc></url><url><loc>https://e.com/1</loc></url><url><loc>https://e.com/2</loc></url></urlset>'
    plain = sitemap.parse(xml)
    assert plain == {"kind": "urlset", "urls": ["https://e.com/1", "https://e.com/2"], "truncated": False, "error": None} == sitemap.parse(gzip.compress(xml))
    assert sitemap.parse(xml, 1)["truncated"] and sitemap.parse(b"<sitemapindex/>")["kind"] == "sitemapindex"
    for bad in (b"<html/>", b"<urlset>", b'<!DOCTYPE x><urlset/>', b"\x1f\x8bxx", b"<urlset>\x00</urlset>", gzip.compress(xml) + b"x", b"<urlset>" + b"<a>" * 40 + b"</a>" * 40 + b"</urlset>"):
        assert sitemap.parse(bad)["error"] == "malformed_sitemap"
    assert sitemap.parse(gzip.compress(b"<urlset>" + b" " * 3_000_000 + b"</urlset>"))["error"] == "too_large"
    df = spark.createDataFrame([(xml,), (None,)], "b binary").select(sitemap.parse_column(F.col("b")).alias("s"))
    assert [r.s.kind for r in df.collect()] == ["urlset", None]


def test_website_outputs(spark, tmp_path):
    from pagequarry import api

    result = api.audit_website(capture(spark, SITE), AuditConfig(mode="website", start_url="https://e.com", max_depth=1))
    result.write(str(tmp_path / "out"))
    audited, other = (spark.read.parquet(str(tmp_path / "out" / x)).count() for x in ("pages", "diagnostics"))
    report = __import__("json").loads(spark.read.text(str(tmp_path / "out" / "report")).first().value)
    assert (report["pages_successfully_audited"], report["pages_processed"], report["domain"]) == (audited, audited + other, "e.com")
    assert report["ai_metadata"]["llms_txt_present"] is None
    with pytest.raises(Exception, match="exists"):
        result.write(str(tmp_path / "out"))
    result.view("audited_site")
    assert spark.sql("SELECT count(*) FROM audited_site WHERE status = 'audited'").first()[0] == audited
