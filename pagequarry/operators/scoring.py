"""Profile, scores, level, value, explanations and chunking advice: projections over a page's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.schema import COMPONENTS

# Points by status.
UNIQUENESS = {"unique": 15.0, "near_duplicate": 5.0, "exact_duplicate": 0.0, "not_checked": 7.5}
ACCESSIBILITY = {"ok": 10.0, "too_short": 7.0, "empty": 2.0, "likely_requires_javascript": 2.0}
LEVELS = ((85, "excellent"), (70, "good"), (50, "mixed"))
# Explanations.
SUBSTANTIAL = "Substantial main content detected."
STRUCTURED = "Page has clear heading structure."
UNIQUE = "Content appears unique within this audit."
UNVERIFIED = "Duplicate detection disabled; uniqueness is unverified."
EXACT = "Exact duplicate of another document."
NEAR = "Near-duplicate of another document."
EXCLUDE = "Review the representative document and exclude redundant content before embedding."
BOILERPLATE = "High boilerplate ratio."
FOCUS = "Use a focused main-content extraction upstream."
NEEDS_JS = "Very little server-rendered text; page likely requires JavaScript."
BROWSER = "Use a browser-capable crawler upstream, then audit its dataset."
LITTLE = "Little useful text was extracted."
REVIEW_SHORT = "Review this short document before ingestion."
NO_HEADINGS = "No heading structure detected."
KEEP_HEADINGS = "Preserve section headings in the source content."
INCLUDE = "Include as a candidate and validate retrieval against representative questions."
REVIEW_SCORE = "Review the score components before including this document."
# Chunk size, overlap and reason by case.
CHUNK_NONE = "No usable text to chunk."
CHUNK_ONE = "Keep this short document in one chunk."
CHUNK_FAQ = "Preserve question/answer pairs where possible."
CHUNK_HEADINGS = "Start with heading-aligned chunks; preserve code and tables."
CHUNK_SMALL = "Start with small paragraph-aligned chunks."
CHUNK_SECTIONS = "Start with section-aligned chunks and evaluate retrieval."

_c = F.col


def _case(column: str, values: dict[str, float]) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(_c(column) == key, value) if out is None else out.when(_c(column) == key, value)
    return out.otherwise(0.0)


def _bit(column: str) -> Column:
    return F.when(_c(column), 1.0).otherwise(0.0)


def page_profile() -> Column:
    title = F.lower(F.coalesce(_c("title"), F.lit("")))
    return (
        F.when(title.contains("faq") | title.contains("frequently asked"), "faq")
        .when((_c("word_count") < 150) & (_c("internal_link_count") >= 15), "navigation_or_index")
        .when(_c("word_count") < 80, "short_content")
        .when((_c("code_block_count") > 0) | _c("url").contains("/docs/") | _c("url").contains("/tutorial/"), "documentation")
        .when((_c("paragraph_count") >= 2) & (_c("heading_count") > 0), "article")
        .otherwise("unknown")
    )


def components() -> dict[str, Column]:
    """The six components, each rounded to cents and not below 0."""
    titled = F.when(F.coalesce(_c("title"), F.lit("")) != "", 1.0).otherwise(0.0)
    blocks = _c("list_count") + _c("table_count") + _c("code_block_count")
    hollow = _c("content_status").isin("empty", "likely_requires_javascript")
    content = 30 * F.least(F.lit(1.0), F.log1p("word_count") / F.log1p(F.lit(600.0)))
    cleanliness = 15 * (1 - F.greatest(F.lit(0.0), _c("boilerplate_ratio") - 0.25) / 0.75)
    raw = {
        "content": F.when(hollow, F.least(content, F.lit(3.0))).otherwise(content),
        "structure": 4 * titled
        + 6 * F.least(_c("heading_count") / 3, F.lit(1.0))
        + 6 * F.least(_c("paragraph_count") / 4, F.lit(1.0))
        + 4 * F.least(blocks / 2, F.lit(1.0))
        - F.least(_c("heading_hierarchy_anomalies"), F.lit(2)),
        "cleanliness": F.when(hollow, F.least(cleanliness, F.lit(5.0))).otherwise(cleanliness),
        "uniqueness": _case("duplicate_status", UNIQUENESS),
        "metadata": 4 * titled + 2 * _bit("has_meta_description") + 2 * _bit("has_canonical") + 2 * _bit("has_json_ld"),
        "accessibility": _case("content_status", ACCESSIBILITY),
    }
    return {name: F.round(F.greatest(F.lit(0.0), raw[name]), 2) for name in COMPONENTS}


def level(total: Column) -> Column:
    out = None
    for least, name in LEVELS:
        out = F.when(total >= least, name) if out is None else out.when(total >= least, name)
    return out.otherwise("poor")


def rag_value() -> Column:
    low = (_c("page_profile") == "navigation_or_index") | (_c("content_status") != "ok") | _c("duplicate_status").isin("exact_duplicate", "near_duplicate")
    return F.when(low, "low").when((_c("word_count") >= 200) & (_c("heading_count") >= 2), "high").when(_c("word_count") >= 60, "medium").otherwise("low")


def recommended() -> Column:
    return (
        (_c("rag_readiness_score") >= 70)
        & (_c("content_status") == "ok")
        & (_c("word_count") >= 60)
        & _c("duplicate_status").isin("unique", "not_checked")
        & (_c("page_profile") != "navigation_or_index")
    )


def _listed(*items: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(words)) for test, words in items]), lambda x: x.isNotNull())


def reasons() -> Column:
    return _listed((_c("word_count") >= 200, SUBSTANTIAL), (_c("heading_count") >= 2, STRUCTURED), (_c("duplicate_status") == "unique", UNIQUE))


def issues() -> Column:
    js = _c("content_status") == "likely_requires_javascript"
    own = _listed(
        (_c("duplicate_status") == "not_checked", UNVERIFIED),
        (_c("duplicate_status") == "exact_duplicate", EXACT),
        (_c("duplicate_status") == "near_duplicate", NEAR),
        (_c("boilerplate_ratio") > 0.6, BOILERPLATE),
        (js, NEEDS_JS),
        (~js & (_c("word_count") < 60), LITTLE),
        ((_c("heading_count") == 0) & (_c("word_count") >= 60), NO_HEADINGS),
    )
    return F.array_distinct(F.concat(_c("issues"), own))


def recommendations() -> Column:
    js = _c("content_status") == "likely_requires_javascript"
    listed = _listed(
        (_c("duplicate_status").isin("exact_duplicate", "near_duplicate"), EXCLUDE),
        (_c("boilerplate_ratio") > 0.6, FOCUS),
        (js, BROWSER),
        (~js & (_c("word_count") < 60), REVIEW_SHORT),
        ((_c("heading_count") == 0) & (_c("word_count") >= 60), KEEP_HEADINGS),
        (_c("recommended_for_rag"), INCLUDE),
    )
    return F.when(F.size(listed) == 0, F.array(F.lit(REVIEW_SCORE))).otherwise(F.array_distinct(listed))


def chunking() -> Column:
    """Struct of size, overlap and reason."""
    tokens = _c("estimated_tokens")
    as_chunk = lambda size, overlap, reason: F.struct(F.lit(size).cast("long").alias("size") if isinstance(size, int) else size.alias("size"), F.lit(overlap).cast("long").alias("overlap"), F.lit(reason).alias("reason"))
    return (
        F.when(tokens == 0, as_chunk(0, 0, CHUNK_NONE))
        .when(tokens <= 256, as_chunk(tokens, 0, CHUNK_ONE))
        .when(_c("page_profile") == "faq", as_chunk(256, 32, CHUNK_FAQ))
        .when((tokens > 2000) & (_c("heading_count") >= 5), as_chunk(768, 96, CHUNK_HEADINGS))
        .when(tokens <= 600, as_chunk(384, 48, CHUNK_SMALL))
        .otherwise(as_chunk(512, 64, CHUNK_SECTIONS))
    )


def score(pages: DataFrame) -> DataFrame:
    """Scores audited pages. ``pages`` has the measures of a page, duplicate_status and issues."""
    df = pages.withColumn("page_profile", page_profile())
    parts = components()
    df = df.withColumn("score_breakdown", F.struct(*[parts[c].alias(c) for c in COMPONENTS]))
    total = _c(f"score_breakdown.{COMPONENTS[0]}")
    for c in COMPONENTS[1:]:
        total = total + _c(f"score_breakdown.{c}")
    df = df.withColumn("rag_readiness_score", F.round(total, 2))
    df = df.withColumns({"rag_readiness_level": level(_c("rag_readiness_score")), "rag_value": rag_value(), "recommended_for_rag": recommended()})
    df = df.withColumns({"reasons": reasons(), "issues": issues(), "recommendations": recommendations(), "_chunk": chunking()})
    return df.withColumns({"recommended_chunk_size": _c("_chunk.size"), "recommended_chunk_overlap": _c("_chunk.overlap"), "chunking_reason": _c("_chunk.reason")}).drop("_chunk")
