"""Rows that could not be audited, as pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.schema import COMPONENTS, PAGE_FIELDS, PAGE_NAMES

# Errors that mean a resource was left out, not that it failed.
SKIPPED_CODES = (
    "unsupported_mime", "unsupported_encoding", "robots_disallowed", "off_host", "blocked_by_ssrf_policy", "invalid_url", "excluded_by_pattern", "dataset_row_unusable", "too_large", "redirect_alias",
)
REVIEW = "Review the diagnostic and fix or exclude this resource upstream."


def status_of(code: Column) -> Column:
    return F.when(code.isin(*SKIPPED_CODES), "skipped").otherwise("failed")


def content_status_of(code: Column) -> Column:
    return F.when(code == "unsupported_mime", "unsupported").otherwise("unavailable")


def _default(value, kind) -> Column:
    if value == ():
        return F.array().cast("array<string>")
    return F.lit(value).cast(kind)


def as_pages(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """``df`` in the columns of a page: those given, and for the others the value a page has by default."""
    return df.select(*[(given[n].cast(t) if n in given else _default(v, t)).alias(n) for n, t, v in PAGE_FIELDS])


def diagnostics(errors: DataFrame, source_type: str = "dataset") -> DataFrame:
    """Pages of ``errors`` (source_id, error: code and message, and maybe url, http_status, robots columns)."""
    code, have = F.col("error.code"), set(errors.columns)
    given = {
        "source_type": F.lit(source_type), "source_id": F.col("source_id"), "status": status_of(code), "error_code": code, "content_status": content_status_of(code), "page_profile": F.lit("short_content"),
        "score_breakdown": F.struct(*[F.lit(0.0).alias(c) for c in COMPONENTS]), "issues": F.array("error.message"), "recommendations": F.array(F.lit(REVIEW)),
    }
    if "url" in have:
        given |= {"url": F.col("url"), "requested_url": F.col("url")}
        given["page_profile"] = F.lit("short_content")
    for c in ("http_status", "robots_checked", "robots_allowed", "robots_url"):
        if c in have:
            given[c] = F.col(c)
    return as_pages(errors, given)


def audited(pages: DataFrame, source_type: str = "dataset") -> DataFrame:
    """Scored documents in the columns of a page."""
    have = set(pages.columns)
    given = {n: F.col(n) for n in PAGE_NAMES if n in have}
    return as_pages(pages, given | {"source_type": F.lit(source_type), "status": F.lit("audited")})
