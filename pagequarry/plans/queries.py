"""Queries of the core over the given tables, one or more per operator."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import api
from pagequarry.config import AuditConfig, problems
from pagequarry.functions import hashing, html_kernel, text, urls
from pagequarry.operators import adapt, crawl, dedup, diagnostics, report, scoring
from pagequarry.plans.lineage import cut, store
from pagequarry.schema import COMPONENTS
from pagequarry.sources import robots, sitemap, snapshot
from pagequarry.sources.tables import table, wide


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.source_rows(table(spark, sf_dir, "dataset_rows"))


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows, of those delivered again the last."""
    return adapt.source_rows(adapt.latest_delivery(table(spark, sf_dir, "dataset_rows")))


# Sources and limits


def source_rows(spark, sf_dir):
    """The recognised fields of each row with its identity."""
    r = _rows(spark, sf_dir)
    return r.select(adapt.source_id(F.col("dataset_id"), F.col("row_index")).alias("source_id"), "row_index", *[F.length(c).cast("long").alias(f"{c}_chars") for c in ("markdown", "cleantext", "text", "content", "html", "title")])


def row_limit(spark, sf_dir):
    """Rows that each dataset's job selects: its first max_pages, unusable ones counted."""
    jobs = table(spark, sf_dir, "audit_jobs").where("dataset_id is not null").groupBy("dataset_id").agg(F.max("max_pages").alias("max_pages"))
    return _delivered(spark, sf_dir).join(jobs, "dataset_id").where("row_index < max_pages").select("dataset_id", "row_index")


def redelivered_rows(spark, sf_dir):
    """Of rows delivered again, the last one's id."""
    return adapt.latest_delivery(table(spark, sf_dir, "dataset_rows")).select("row_id", "dataset_id", "row_index")


def job_problems(spark, sf_dir):
    """Integer parameters and pattern lists of jobs within their bounds."""
    from pagequarry.config import INTEGER_BOUNDS, MAX_PATTERN_CHARS, MAX_PATTERNS

    jobs = table(spark, sf_dir, "audit_jobs")
    bad = [(~F.col(c).between(*b)).cast("int") for c, b in INTEGER_BOUNDS.items()]
    for c in ("include_patterns", "exclude_patterns"):
        p = F.coalesce(c, F.array().cast("array<string>"))
        bad.append(((F.size(p) > MAX_PATTERNS) | F.exists(p, lambda x: (x == "") | (F.length(x) > MAX_PATTERN_CHARS))).cast("int"))
    total = bad[0]
    for b in bad[1:]:
        total = total + b
    return jobs.select("job_id", total.cast("long").alias("problems"))


# Row adaptation


def content_choice(spark, sf_dir):
    """The content field of each row, its size and its error."""
    df = adapt.choose_content(table(spark, sf_dir, "dataset_rows"))
    return df.select("row_id", "field", F.length("content").cast("long").alias("chars"), adapt.problem(F.col("field"), F.col("content"))["code"].alias("error_code"))


def html_sniff(spark, sf_dir):
    """Whether each row's content is read as HTML."""
    df = adapt.choose_content(table(spark, sf_dir, "dataset_rows")).where("field is not null")
    return df.select("row_id", "field", adapt.is_html(F.col("field"), F.col("content")).alias("is_html"))


def url_choice(spark, sf_dir):
    """The first address of each row that can be normalized, '' where none can."""
    return adapt.choose_url(wide(table(spark, sf_dir, "dataset_rows"))).select("row_id", "page_url")


def titles(spark, sf_dir):
    """Titles of rows, cut to 500 characters."""
    return table(spark, sf_dir, "dataset_rows").select("row_id", F.substring(F.coalesce("title", F.lit("")), 1, adapt.TITLE_CHARS).alias("title"))


# Text and Markdown


def word_counts(spark, sf_dir):
    """Words and estimated tokens of each document."""
    d = wide(table(spark, sf_dir, "documents").where("text is not null"))
    return d.select("doc_id", text.count_words(F.col("text")).alias("words"), text.estimate_tokens(F.col("text")).alias("tokens"))


def clean_documents(spark, sf_dir):
    """Digest and size of each document's cleaned text, and its status."""
    d = wide(table(spark, sf_dir, "documents").where("text is not null")).select("doc_id", text.clean_text(F.col("text")).alias("t"))
    status = text.content_status(F.col("t"), text.count_words(F.col("t")), F.lit(False))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"), status.alias("content_status"))


def paragraph_counts(spark, sf_dir):
    """Paragraphs of each document."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.count_paragraphs(F.col("text")).alias("paragraphs"))


def markdown_structure(spark, sf_dir):
    """Headings, lists, tables and code blocks of each Markdown field."""
    c = F.col("markdown")
    d = table(spark, sf_dir, "dataset_rows").where("markdown is not null").withColumn("h", text.markdown_headings(c))
    return d.select(
        "row_id", F.size("h").cast("long").alias("headings"), *[text.heading_level(F.col("h"), k).alias(f"h{k}") for k in (1, 2, 3)], text.markdown_title(c).alias("heading_title"),
        text.markdown_lists(c).alias("lists"), text.markdown_tables(c).alias("tables"), text.markdown_code_blocks(c).alias("code_blocks"),
    )


def markdown_plain(spark, sf_dir):
    """Markdown without its marks: digest of the cleaned text, and paragraphs."""
    d = table(spark, sf_dir, "dataset_rows").where("markdown is not null").select("row_id", text.strip_markdown(F.col("markdown")).alias("s"))
    return d.select("row_id", F.md5(text.clean_text(F.col("s"))).alias("digest"), text.count_paragraphs(F.col("s")).alias("paragraphs"))


# HTML


def html_structure(spark, sf_dir):
    """Everything that the kernel measures of each page."""
    from pagequarry.functions.html_kernel import extract_column

    d = adapt.choose_url(wide(table(spark, sf_dir, "dataset_rows").where("html is not null")))
    k = d.select("row_id", extract_column(F.col("html"), F.col("page_url")).alias("k"))
    names = [
        "title", "has_meta_description", "has_json_ld", "canonical_url", "raw_text_chars", "paragraph_count", "list_count", "table_count", "code_block_count",
        "internal_link_count", "external_link_count", "js_shell", "word_count", "boilerplate_ratio",
    ]
    return k.select("row_id", *[f"k.{n}" for n in names], F.array_join(F.col("k.heading_levels").cast("array<string>"), "").alias("heading_levels"), F.md5("k.text").alias("text_digest"))


def html_metadata(spark, sf_dir):
    """Sizes and metadata signs of each page."""
    from pagequarry.functions.html_kernel import extract_column

    d = wide(table(spark, sf_dir, "dataset_rows").where("html != ''")).select("row_id", F.length("html").cast("long").alias("raw_html_chars"), extract_column(F.col("html"), F.lit("")).alias("k"))
    return d.select("row_id", "raw_html_chars", "k.title", "k.has_meta_description", "k.has_json_ld")


def link_edges(spark, sf_dir):
    """Distinct internal links of each page, by target."""
    from pagequarry.functions.html_kernel import extract_column

    d = adapt.choose_url(wide(table(spark, sf_dir, "dataset_rows").where("html is not null"))).where("page_url != ''")
    links = d.select("page_url", F.explode(extract_column(F.col("html"), F.col("page_url"))["links"]).alias("target"))
    return links.groupBy("target").agg(F.countDistinct("page_url").alias("pages"))


# URLs


def url_hosts(spark, sf_dir):
    """Results by host of their url."""
    p = table(spark, sf_dir, "page_results").where("url != ''").select(urls.host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("results"))


def glob_filter(spark, sf_dir):
    """For each dataset's job, how many urls of its results its patterns let through.

    The distinct pattern lists are few (jobs), so each becomes one expression.
    """
    jobs = table(spark, sf_dir, "audit_jobs").where("dataset_id is not null")
    lists = jobs.select("include_patterns", "exclude_patterns").distinct().limit(1001).collect()
    if len(lists) > 1000:
        raise ValueError("more than 1000 distinct pattern lists")
    p = table(spark, sf_dir, "page_results").where("url != '' and source_type = 'dataset'").select("url", F.split_part("source_id", F.lit(":"), F.lit(2)).alias("dataset_id"))
    matched = p.join(jobs.select("job_id", "dataset_id", F.to_json(F.struct("include_patterns", "exclude_patterns")).alias("lists")), "dataset_id")
    passes = F.lit(False)
    for include, exclude in lists:
        key = F.to_json(F.struct(*[F.lit(v).cast("array<string>").alias(n) for n, v in (("include_patterns", include), ("exclude_patterns", exclude))]))
        passes = F.when(F.col("lists") == key, urls.matches_patterns(F.col("url"), tuple(include or ()), tuple(exclude or ()))).otherwise(passes)
    return matched.groupBy("job_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if(passes).alias("selected"))


def public_addresses(spark, sf_dir):
    """Captured responses whose addresses are all public."""
    s = table(spark, sf_dir, "capture_snapshot")
    return s.select("capture_id", urls.all_public(F.col("resolved_ips")).alias("public"))


# Duplicates


def _prints(spark, sf_dir):
    d = wide(table(spark, sf_dir, "documents"))
    return d.select(F.lit("").alias("scope"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("ref"), "text", text.count_words(F.col("text")).alias("words"), F.lit(0.0).alias("boilerplate"))


def exact_duplicates(spark, sf_dir):
    """Documents whose raw or normalized text stands in an earlier one."""
    docs = _prints(spark, sf_dir).withColumn("words", F.lit(0).cast("long"))
    found = dedup.find_duplicates(docs, near=False).where("duplicate_status = 'exact_duplicate'")
    return found.select(F.col("ref").cast("long").alias("doc_id"), F.col("duplicate_of").cast("long").alias("duplicate_of"), "duplicate_match")


def shingle_weights(spark, sf_dir):
    """How often each document repeats its shingles: distinct ones, and their capped weight."""
    d = wide(table(spark, sf_dir, "documents").where("text is not null")).select("doc_id", F.explode(hashing.shingles(F.lower("text"))).alias("g"))
    c = d.groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shingles"), F.sum(F.least("n", F.lit(hashing.MOST))).alias("weight"))


def near_duplicates(spark, sf_dir):
    """Near-duplicates of documents with their representatives."""
    found = dedup.find_duplicates(_prints(spark, sf_dir)).where("duplicate_status != 'unique'")
    return found.select(F.col("ref").cast("long").alias("doc_id"), "duplicate_status", F.col("duplicate_of").cast("long").alias("duplicate_of"), "similarity", "duplicate_match")


def near_duplicates_md5(spark, sf_dir):
    """The same with shingles by MD5, which SQL has."""
    found = dedup.find_duplicates(_prints(spark, sf_dir), digest="md5").where("duplicate_status != 'unique'")
    return found.select(F.col("ref").cast("long").alias("doc_id"), "duplicate_status", F.col("duplicate_of").cast("long").alias("duplicate_of"), "similarity", "duplicate_match")


# Scores


def page_profiles(spark, sf_dir):
    """Profile of each audited result from its measures."""
    return _audited(spark, sf_dir).select("result_id", scoring.page_profile().alias("profile"))


def _audited(spark, sf_dir):
    p = table(spark, sf_dir, "page_results").where("status = 'audited'")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("word_count", "internal_link_count", "code_block_count", "paragraph_count", "heading_count", "list_count", "table_count", "heading_hierarchy_anomalies", "estimated_tokens")}
    return p.withColumns(zero | {"boilerplate_ratio": F.coalesce("boilerplate_ratio", F.lit(0.0)), "content_status": F.coalesce("content_status", F.lit("ok")), "duplicate_status": F.coalesce("duplicate_status", F.lit("not_checked"))})


def score_components(spark, sf_dir):
    """The six components, in cents."""
    parts = scoring.components()
    return _audited(spark, sf_dir).select("result_id", *[F.round(parts[c] * 100).cast("long").alias(f"{c}_cents") for c in COMPONENTS])


def rescored(spark, sf_dir):
    """Score, level, value and recommendation of each audited result."""
    s = scoring.score(_audited(spark, sf_dir))
    return s.select("result_id", F.round(F.col("rag_readiness_score") * 100).cast("long").alias("cents"), "rag_readiness_level", "rag_value", "recommended_for_rag")


def explanations(spark, sf_dir):
    """Reasons, issues and recommendations of each audited result, joined."""
    s = scoring.score(_audited(spark, sf_dir).withColumn("issues", F.array().cast("array<string>")))
    return s.select("result_id", *[F.array_join(c, "|").alias(c) for c in ("reasons", "issues", "recommendations")])


def chunk_advice(spark, sf_dir):
    """Chunk size and overlap of each audited result."""
    c = _audited(spark, sf_dir).withColumn("page_profile", scoring.page_profile()).withColumn("c", scoring.chunking())
    return c.select("result_id", F.col("c.size").alias("chunk_size"), F.col("c.overlap").alias("chunk_overlap"), F.col("c.reason").alias("reason"))


# Captured responses


def response_outcomes(spark, sf_dir):
    """What each captured response gives: document, redirect or error."""
    s = snapshot.classify(table(spark, sf_dir, "capture_snapshot"))
    return s.select("capture_id", "mime_type", "outcome", F.col("error.code").alias("error_code"), F.col("error.message").alias("message"))


def response_diagnostics(spark, sf_dir):
    """Diagnosis of captured responses without document, by code."""
    s = snapshot.classify(table(spark, sf_dir, "capture_snapshot")).where("outcome = 'failed'")
    d = s.select(diagnostics.status_of(F.col("error.code")).alias("status"), F.col("error.code").alias("error_code"), diagnostics.content_status_of(F.col("error.code")).alias("content_status"))
    return d.groupBy("status", "error_code", "content_status").agg(F.count(F.lit(1)).alias("responses"))


def _known(spark, sf_dir):
    s = table(spark, sf_dir, "capture_snapshot").withColumn("url", urls.normalize_url(F.col("url"))).where("url is not null")
    return cut(snapshot.classify(snapshot.latest(s)))


def followed_redirects(spark, sf_dir):
    """Where the captured urls that redirect lead (W08); the network policy is left out, since the addresses are not public."""
    known = _known(spark, sf_dir)
    asked = known.where("outcome = 'redirect'").select("url", urls.host(F.col("url")).alias("start_host"))
    return snapshot.resolve(asked, known, public_only=False).select("url", "final_url", F.col("error.code").alias("error_code"), "http_status")


def site_files(spark, sf_dir):
    """Whether the sites of website jobs offer llms.txt and llms-full.txt."""
    jobs = table(spark, sf_dir, "audit_jobs").where("run_mode = 'website' and start_url is not null").select(urls.normalize_url(F.col("start_url")).alias("start_url")).where("start_url is not null").distinct()
    return snapshot.text_files(jobs, _known(spark, sf_dir), public_only=False)


#: A robots.txt for the query below: longest lines first decide, a tie is allowed.
ROBOTS_TXT = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /blog/\nAllow: /blog/*-1\nDisallow: /docs/item-*5$\nAllow: /docs/\nDisallow: /*?\n"


def robots_permissions(spark, sf_dir):
    """Whether the lines of a robots.txt let each address of the results be read."""
    p = table(spark, sf_dir, "page_results").where("url != ''").select("url").distinct()
    return p.select("url", crawl.permission(robots.parse(ROBOTS_TXT))(F.col("url")).alias("allowed"))


def sitemap_entries(spark, sf_dir):
    """The addresses of one sitemap per captured response: its own, where it leads, and its own once more, which counts once."""
    escaped = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    place = lambda c: F.coalesce(F.concat(F.lit("<url><loc> "), c, F.lit("\n</loc></url>")), F.lit(""))
    kind = F.when(F.col("status") == 404, "feed").when(F.col("status") == 301, "sitemapindex").otherwise("urlset")
    entries = F.concat(place(escaped("url")), place(escaped("redirect_location")), place(escaped("url")))
    xml = F.concat(F.lit('<?xml version="1.0"?><'), kind, F.lit(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, F.lit("</"), kind, F.lit(">"))
    s = table(spark, sf_dir, "capture_snapshot").where("url is not null").select("capture_id", sitemap.parse_column(F.encode(xml, "UTF-8")).alias("s"))
    return s.select("capture_id", "s.kind", F.array_join("s.urls", "|").alias("urls"), "s.truncated", "s.error")


def crawl_frontier(spark, sf_dir):
    """The queue of a crawl after one level: addresses that pages link to, once each, in the order of the pages and links, those seen left out."""
    d = adapt.choose_url(wide(table(spark, sf_dir, "dataset_rows").where("html is not null"))).where("page_url != ''")
    pages = store(d.select("row_id", "page_url", html_kernel.extract_column(F.col("html"), F.col("page_url"))["links"].alias("links")))
    links = pages.select(F.col("row_id").alias("parent"), F.posexplode("links").alias("place", "url")).select("url", F.col("parent"), F.col("place").cast("long").alias("place"))
    config = AuditConfig(include_patterns=("https://*",), exclude_patterns=("*/careers*", "*/t/*"))
    return crawl.offer(links, pages.select(F.col("page_url").alias("url")).distinct(), config, crawl.MAX_QUEUE, 0)


def job_validation(spark, sf_dir):
    """What is wrong with each job's input, in words."""
    names = ("start_url", "dataset_id", "max_pages", "max_depth", "max_concurrency", "request_timeout_secs", "include_patterns", "exclude_patterns", "respect_robots_txt", "detect_duplicates", "check_ai_metadata")
    jobs = table(spark, sf_dir, "audit_jobs").select("job_id", F.to_json(F.struct(F.col("run_mode").alias("mode"), *names)).alias("input"))
    told = F.pandas_udf(lambda inputs: inputs.map(lambda x: "|".join(problems(json.loads(x)))), "string")
    return jobs.select("job_id", told("input").alias("problems"))


# Report


def report_totals(spark, sf_dir):
    """Counts, tokens and sums of scores over all results."""
    return report.totals(table(spark, sf_dir, "page_results"))


def report_by_type(spark, sf_dir):
    """The totals by source type and profile (G01 to G06, grouped)."""
    return report.totals(table(spark, sf_dir, "page_results"), ["source_type", "page_profile"])


def report_median(spark, sf_dir):
    """Median of the audited scores."""
    return report.median_score(table(spark, sf_dir, "page_results"))


def report_top_issues(spark, sf_dir):
    """The ten most common issues."""
    return report.top_issues(table(spark, sf_dir, "page_results"))


def report_violations(spark, sf_dir):
    """Zeros if the totals reconcile."""
    return report.violations(table(spark, sf_dir, "page_results"))


def recommended_rows(spark, sf_dir):
    """Source rows whose result is recommended."""
    good = table(spark, sf_dir, "page_results").where("recommended_for_rag and status = 'audited'").select("source_id")
    r = table(spark, sf_dir, "dataset_rows").withColumn("source_id", adapt.source_id(F.col("dataset_id"), F.col("row_index")))
    return r.join(good, "source_id", "left_semi").select("row_id", "source_id")


def split_outputs(spark, sf_dir):
    """Results by output: audited pages, and diagnostics."""
    p = table(spark, sf_dir, "page_results")
    return p.groupBy(F.when(F.col("status") == "audited", "pages").otherwise("diagnostics").alias("output"), "status").agg(F.count(F.lit(1)).alias("results"))


# The whole audit


def audit_pages(spark, sf_dir):
    """Every delivered row as an audited page or a diagnosis: adapters, kernel, duplicates, scores."""
    return api.audit_pages(wide(adapt.latest_delivery(table(spark, sf_dir, "dataset_rows")))).drop("collected_at")


def audit_measures(spark, sf_dir):
    """Every delivered row as an audited page or a diagnosis, with duplicates not checked."""
    pages = api.audit_pages(wide(adapt.latest_delivery(table(spark, sf_dir, "dataset_rows"))), AuditConfig(max_pages=None, detect_duplicates=False))
    names = (
        "source_id", "url", "status", "error_code", "content_status", "title", "page_profile", "word_count", "raw_text_chars", "main_content_chars", "raw_html_chars", "boilerplate_ratio", "heading_count", "h2_count",
        "heading_hierarchy_anomalies", "paragraph_count", "list_count", "table_count", "code_block_count", "internal_link_count", "external_link_count", "has_meta_description", "has_json_ld", "metadata_available",
        "estimated_tokens", "rag_value", "recommended_for_rag",
    )
    return pages.select(*names, F.round(F.col("rag_readiness_score") * 100).cast("long").alias("cents"))


def audit_totals(spark, sf_dir):
    """Report of the audit of all delivered rows."""
    return report.totals(audit_pages(spark, sf_dir))


def audit_documents(spark, sf_dir):
    """The documents audited as plain text, in the order of their ids."""
    d = wide(table(spark, sf_dir, "documents")).select(F.lit("documents").alias("dataset_id"), F.col("doc_id").alias("row_index"), "text", "url", "title")
    return api.audit_pages(d).drop("collected_at")
