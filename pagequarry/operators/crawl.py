"""The audit of a website over captured responses: a breadth-first search, one join per level.

The queue of each start is first in, first out: pages are visited in the order
(depth, order of the page that links to them, place of the link). A level is
numbered by a window per start, which the bounds of a crawl keep small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pagequarry.config import AuditConfig
from pagequarry.functions import html_kernel, urls
from pagequarry.operators import scoring
from pagequarry.operators.adapt import extract
from pagequarry.operators.dedup import mark_duplicates
from pagequarry.operators.diagnostics import audited, diagnostics
from pagequarry.plans.lineage import cut, store
from pagequarry.sources import robots, sitemap, snapshot

# The most addresses that a crawl remembers, and messages.
MAX_QUEUE = 10_000
ROBOTS = "Blocked by robots rules or conservative unavailable-rules fallback."
ALIAS = "Final resource already analyzed in this run."
EXCLUDED = "URL excluded by input patterns."
PARTIAL = "Crawl reached its page or discovery limit; coverage is partial."
NESTED = "Nested sitemap traversal truncated at depth/file limit."
CUT_OFF = "Sitemap URL list truncated at the configured hard limit."


def responses(captured: DataFrame) -> DataFrame:
    """Captured responses by normalized url, the last of each, classified for pages and auxiliary files."""
    df = captured.withColumn("url", urls.normalize_url(F.col("url"))).where("url is not null")
    return store(snapshot.classify(snapshot.latest(df), snapshot.TEXT_MIMES))


def site_rules(start: str, known: DataFrame, enabled: bool = True, public_only: bool = True) -> robots.Rules:
    """Rules of the origin of ``start``, redirects of its robots.txt followed: one captured row.

    A file over the limit of auxiliary files is not used, as one that failed.
    """
    origin = start.split("/", 3)
    url = f"{origin[0]}//{origin[2]}/robots.txt"
    if not enabled:
        return robots.rules(url, None, enabled=False)
    asked = known.sparkSession.createDataFrame([(url, urls.host_of(start))], "url string, start_host string")
    found = snapshot.resolve(asked, known, public_only)
    row = found.select("http_status", F.coalesce("error.code", F.when(F.octet_length("body") > snapshot.MAX_AUXILIARY_BYTES, "too_large")).alias("code"), F.when(F.octet_length("body") <= snapshot.MAX_AUXILIARY_BYTES, F.col("body")).alias("body")).first()
    status, code, body = row
    return robots.rules(url, bytes(body or b"").decode("utf-8", "replace"), status, code)


def sitemap_urls(start: str, known: DataFrame, rules: robots.Rules, public_only: bool = True) -> tuple[list[str], list[str]]:
    """Pages that the sitemaps of ``start`` list, in order, and warnings. At most 20 files are read, redirects followed."""
    host = urls.host_of(start)
    origin = start.split("/", 3)
    level = list(dict.fromkeys(filter(None, (urls.normalize(u) for u in [*rules.sitemaps, f"{origin[0]}//{origin[2]}/sitemap.xml"]))))[: sitemap.MAX_FILES]
    pages: dict[str, None] = {}
    visited: list[str] = []
    warnings: list[str] = []
    depth = 0
    while level and len(visited) < sitemap.MAX_FILES and len(pages) < sitemap.MAX_URLS:
        level = [u for u in level if u not in visited][: sitemap.MAX_FILES - len(visited)]
        visited += level
        asked = known.sparkSession.createDataFrame([(u, host) for u in level], "url string, start_host string")
        found = store(snapshot.resolve(asked, known, public_only))
        files = {r["url"]: (r["final_url"], r["s"]) for r in found.where("error is null").select("url", "final_url", sitemap.parse_column(F.coalesce("body", F.lit(b""))).alias("s")).collect()}
        failed = {r["url"]: (r["http_status"], r["code"]) for r in found.where("error is not null").select("url", "http_status", "error.code").collect()}
        nested: list[str] = []
        for u in level:
            if not rules.allowed(u) and rules.checked:
                warnings.append("Sitemap not used (robots_disallowed).")
                continue
            if u not in files:
                status, code = failed.get(u, (None, "network_error"))
                if status != 404 and (status is not None or code != "network_error" or u in rules.sitemaps):  # what was never captured is not told apart from what is not there
                    warnings.append(f"Sitemap not used ({code}).")
                continue
            final, s = files[u]
            if final != u and rules.checked and not rules.allowed(final):
                warnings.append("Sitemap not used (robots_disallowed).")
                continue
            if s["error"]:
                warnings.append(f"Sitemap not used ({s['error']}).")
            if s["truncated"]:
                warnings.append(CUT_OFF)
            for target in (urls.normalize(x, final) for x in s["urls"]):
                if target is None or urls.host_of(target) != host:
                    continue
                if s["kind"] == "sitemapindex":
                    if depth < sitemap.MAX_DEPTH and len(visited) + len(nested) < sitemap.MAX_FILES:
                        nested.append(target)
                    else:
                        warnings.append(NESTED)
                elif len(pages) < sitemap.MAX_URLS:
                    pages[target] = None
        level, depth = nested, depth + 1
    return list(pages), list(dict.fromkeys(warnings))


def offer(links: DataFrame, seen: DataFrame, config: AuditConfig, room: int, base: int) -> DataFrame:
    """(url, ord) of the new addresses of a level, in queue order, at most ``room``.

    ``links`` has url, parent, place: one row per link, normalized. The window
    holds no more than the ``MAX_QUEUE`` first addresses.
    """
    wanted = links.where(urls.matches_patterns(F.col("url"), config.include_patterns, config.exclude_patterns))
    first = wanted.groupBy("url").agg(F.min(F.struct("parent", "place")).alias("at"))
    new = first.join(seen.select("url"), "url", "left_anti").orderBy("at", "url").limit(max(room, 0))
    return new.select("url", (F.row_number().over(Window.orderBy("at", "url")) + base - 1).cast("long").alias("ord"))


def permission(rules: robots.Rules):
    """Whether a column of urls may be read, in Arrow batches."""
    if not rules.lines:
        return lambda url: F.lit(rules.default)

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(rules.allowed, na_action="ignore").astype("boolean")

    return F.pandas_udf(run, BooleanType())


def audit_site(captured: DataFrame, config: AuditConfig, public_only: bool = True) -> tuple[DataFrame, list[str]]:
    """Pages of one website in visiting order, and warnings. ``captured`` is a capture snapshot."""
    spark = captured.sparkSession
    known = responses(captured)
    start = urls.normalize(config.start_url)
    if start is None:
        raise ValueError(snapshot.INVALID_URL)
    host = urls.host_of(start)
    rules = site_rules(start, known, config.respect_robots_txt, public_only)
    warnings = [rules.warning] if rules.warning else []
    permit = permission(rules)
    frontier = offer(spark.createDataFrame([(start, 0, 0)], "url string, parent long, place long"), spark.createDataFrame([], "url string"), config, MAX_QUEUE, 0)
    queue = cut(frontier.withColumn("depth", F.lit(0)))
    extra = None
    if config.max_depth > 0:
        listed, more = sitemap_urls(start, known, rules, public_only)
        warnings += more
        if listed:
            extra = spark.createDataFrame([(u, -1, k) for k, u in enumerate(listed)], "url string, parent long, place long")
    fetched = None
    finals = spark.createDataFrame([], "final_url string")
    count = queue.count()
    selected = 0
    for depth in range(config.max_depth + 1):
        level = queue.where(F.col("depth") == depth)
        if config.max_pages is not None:
            level = level.where(F.col("ord") < config.max_pages)
        got = snapshot.resolve(level.select("url", F.lit(host).alias("start_host")), known, public_only).drop("start_host")
        denied = F.when(~permit(F.coalesce("final_url", "url")), snapshot.error("robots_disallowed", ROBOTS))
        outside = F.when(~urls.matches_patterns(F.col("final_url"), config.include_patterns, config.exclude_patterns), snapshot.error("excluded_by_pattern", EXCLUDED))
        paged = F.when(~F.col("mime_type").isin(*snapshot.PAGE_MIMES), snapshot.error("unsupported_mime", snapshot.BAD_MIME))
        got = level.join(got, "url").withColumn("error", F.coalesce(outside, denied, "error", paged))
        # Of pages with one final address the first visited counts.
        nth = F.row_number().over(Window.partitionBy("final_url", F.col("error").isNull()).orderBy("ord"))
        before = finals.withColumn("_before", F.lit(True))
        got = got.withColumn("_nth", nth).join(before, "final_url", "left")
        again = F.when((F.col("_nth") > 1) | F.col("_before"), snapshot.error("redirect_alias", ALIAS))
        got = cut(got.withColumn("error", F.coalesce("error", again)).drop("_nth", "_before"))
        fetched = got if fetched is None else fetched.unionByName(got)
        finals = fetched.where("error is null").select("final_url").distinct()
        selected += level.count()
        if depth == config.max_depth:
            break
        html = F.when(F.col("mime_type").isin(*snapshot.HTML_MIMES), F.decode("body", "UTF-8"))
        pages = got.where("error is null").withColumn("links", html_kernel.extract_column(html, F.col("final_url"))["links"])
        links = pages.select(F.col("ord").alias("parent"), F.posexplode("links").alias("place", "url")).select("url", "parent", "place")
        if depth == 0 and extra is not None:
            links = links.unionByName(extra)
        links = links.where(urls.host(F.col("url")) == host)
        new = cut(offer(links, queue, config, MAX_QUEUE - count, count).withColumn("depth", F.lit(depth + 1)))
        more = new.count()
        if not more:
            break
        queue, count = queue.unionByName(new), count + more
    if selected < count or count >= MAX_QUEUE:
        warnings.append(PARTIAL)
    return _pages(fetched, config, rules, permit), warnings


def _pages(fetched: DataFrame, config: AuditConfig, rules: robots.Rules, permit) -> DataFrame:
    mime = F.col("mime_type")
    field = F.when(mime.isin(*snapshot.HTML_MIMES), "html").when(mime == "text/markdown", "markdown").otherwise("text")
    checked = {"robots_checked": F.lit(rules.checked), "robots_url": F.lit(rules.url)}
    checked["robots_allowed"] = permit(F.coalesce("final_url", "url")) if rules.checked else F.lit(None).cast("boolean")
    docs = fetched.select(
        F.lit("site").alias("scope"), "ord", F.col("url").alias("source_id"), F.col("url").alias("requested_url"), F.col("final_url").alias("page_url"), "final_url", "http_status", "error",
        field.alias("field"), F.when(F.col("error").isNull(), F.decode("body", "UTF-8")).alias("content"), F.lit("").alias("title"), *[v.alias(k) for k, v in checked.items()],
    )
    docs = docs.withColumn("content", F.when(F.col("error").isNull(), F.coalesce("content", F.lit(""))))
    done = store(extract(docs))
    good = done.where("error is null").withColumns({"title": F.col("page_title"), "url": F.col("page_url")})
    scored = scoring.score(mark_duplicates(good, config.detect_duplicates, "scope", "ord"))
    bad = done.where("error is not null").withColumn("url", F.col("requested_url"))
    return audited(scored, "website").unionByName(diagnostics(bad, "website"))
