"""Audited pages rolled up into one reconciled report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.schema import COMPONENTS

# Texts of the report.
SCHEMA_VERSION = "1.0"
AGGREGATION = "Unweighted mean of audited unique/not-checked pages, excluding navigation_or_index; null if none."
COVERAGE = "Bounded audit of observed eligible URLs/rows; not exhaustive."
DUPLICATES_OFF = "Duplicate detection disabled; uniqueness and corpus size may be overstated."
ROWS_LEFT = "Dataset audit limited to selected source rows; remaining rows were not analyzed."
NO_ROWS = "Source dataset is empty; no documents were analyzed."
TOP_ISSUES = 10


def _is_audited() -> Column:
    return F.col("status") == "audited"


def _is_weighted() -> Column:
    return _is_audited() & F.col("duplicate_status").isin("unique", "not_checked") & (F.col("page_profile") != "navigation_or_index")


def totals(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, tokens and exact sums of the scores (in cents, so that they do not depend on order); one row, or one per group."""
    audited, weighted = _is_audited(), _is_weighted()
    cents = lambda c: F.round(c * 100).cast("long")
    count = lambda test, name: F.count_if(test).alias(name)
    aggregates = [
        F.count(F.lit(1)).alias("pages_processed"),
        count(audited, "pages_successfully_audited"),
        count(F.col("status") == "failed", "pages_failed"),
        count(F.col("status") == "skipped", "pages_skipped"),
        count(audited & F.col("recommended_for_rag"), "recommended_pages"),
        count(audited & (F.col("rag_value") == "low"), "low_value_pages"),
        count(audited & (F.col("duplicate_status") == "unique"), "unique_pages"),
        count(audited & (F.col("duplicate_status") == "exact_duplicate"), "exact_duplicates"),
        count(audited & (F.col("duplicate_status") == "near_duplicate"), "near_duplicates"),
        count(audited & (F.col("duplicate_status") == "not_checked"), "duplicates_not_checked"),
        count(audited & (F.col("content_status") == "likely_requires_javascript"), "likely_js_pages"),
        F.coalesce(F.sum(F.when(audited & F.col("recommended_for_rag"), F.col("estimated_tokens"))), F.lit(0)).alias("estimated_corpus_tokens"),
        F.coalesce(F.sum(F.when(audited, F.col("estimated_tokens"))), F.lit(0)).alias("estimated_analyzed_tokens"),
        count(weighted, "score_denominator"),
        F.coalesce(F.sum(F.when(weighted, cents(F.col("rag_readiness_score")))), F.lit(0)).alias("weighted_score_cents"),
        F.coalesce(F.sum(F.when(audited, cents(F.col("rag_readiness_score")))), F.lit(0)).alias("analyzed_score_cents"),
        *[F.coalesce(F.sum(F.when(weighted, cents(F.col(f"score_breakdown.{c}")))), F.lit(0)).alias(f"{c}_cents") for c in COMPONENTS],
    ]
    return (pages.groupBy(*by) if by else pages.groupBy()).agg(*aggregates)


def median_score(pages: DataFrame) -> DataFrame:
    """Exact median of the audited scores, from a count per distinct score: scores have two digits, so there are few."""
    counts = pages.where(_is_audited()).groupBy(F.col("rag_readiness_score").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile("score", F.lit(0.5), F.col("n")).alias("median_analyzed_score"))


def top_issues(pages: DataFrame, n: int = TOP_ISSUES) -> DataFrame:
    """(issue, count): the most common issues over all pages, each once a page, ties in text order."""
    each = pages.select(F.explode(F.array_distinct("issues")).alias("issue"))
    return each.groupBy("issue").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "issue").limit(n)


def violations(pages: DataFrame) -> DataFrame:
    """How far the totals miss what they must satisfy; zeros if they reconcile."""
    t = totals(pages)
    return t.select(
        (F.col("pages_processed") - F.col("pages_successfully_audited") - F.col("pages_failed") - F.col("pages_skipped")).alias("unaccounted_pages"),
        (F.col("pages_successfully_audited") - F.col("unique_pages") - F.col("exact_duplicates") - F.col("near_duplicates") - F.col("duplicates_not_checked")).alias("unaccounted_duplicates"),
        F.greatest(F.col("recommended_pages") - F.col("pages_successfully_audited"), F.lit(0)).alias("excess_recommended"),
    )


def _mean(cents: int, n: int) -> float | None:
    """Mean of numbers of two digits, rounded as the mean of the numbers is."""
    return round(cents / 100 / n, 2) if n else None


def build(pages: DataFrame, *, mode: str, source: str, discovered: int, selected: int, warnings: tuple[str, ...] = (), started_at: str | None = None, ai_metadata: dict | None = None) -> dict:
    """The report of an audit, as a dictionary: one row of totals and ten of issues reach the driver."""
    t = totals(pages).first().asDict()
    n = t["score_denominator"]
    out = {"schema_version": SCHEMA_VERSION, "mode": mode, "source": source, "domain": source if mode == "website" else None, "source_dataset": source if mode == "dataset" else None}
    out |= {"started_at": started_at, "pages_discovered": discovered, "pages_selected": selected}
    out |= {k: v for k, v in t.items() if not k.endswith("_cents")}
    out |= {
        "overall_score": _mean(t["weighted_score_cents"], n),
        "score_breakdown": {c: _mean(t[f"{c}_cents"], n) for c in COMPONENTS} if n else {},
        "score_aggregation_method": AGGREGATION,
        "average_analyzed_score": _mean(t["analyzed_score_cents"], t["pages_successfully_audited"]),
        "median_analyzed_score": median_score(pages).first()[0],
        "top_issues": [r.asDict() for r in top_issues(pages).collect()],
        "recommended_include_patterns": [], "recommended_exclude_patterns": [], "warnings": list(dict.fromkeys(warnings)), "ai_metadata": ai_metadata or {}, "coverage": COVERAGE,
    }
    return out
