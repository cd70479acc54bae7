"""Schemas of source rows, captured responses and audited pages."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

CONTENT_FIELDS = ("markdown", "cleantext", "text", "content", "html")
URL_FIELDS = ("loadedurl", "url", "canonicalurl")
SOURCE_FIELDS = (*CONTENT_FIELDS, *URL_FIELDS, "title")
COMPONENTS = ("content", "structure", "cleanliness", "uniqueness", "metadata", "accessibility")

_S, _L, _D, _B, _I, _A = StringType(), LongType(), DoubleType(), BooleanType(), IntegerType(), ArrayType(StringType())
SCORES = StructType([StructField(c, _D) for c in COMPONENTS])
#: The audited page, field by field, with the value it has where nothing sets it.
PAGE_FIELDS = (
    ("source_type", _S, "website"), ("source_id", _S, ""), ("url", _S, ""), ("requested_url", _S, ""), ("final_url", _S, None), ("canonical_url", _S, None), ("status", _S, "audited"),
    ("error_code", _S, None), ("http_status", _I, None), ("content_status", _S, "ok"), ("title", _S, ""), ("page_profile", _S, "unknown"), ("rag_readiness_score", _D, 0.0),
    ("rag_readiness_level", _S, "poor"), ("rag_value", _S, "low"), ("recommended_for_rag", _B, False), ("estimated_tokens", _L, 0),
    ("token_estimation_method", _S, "ceil(unicode_characters / 4); heuristic, not a tokenizer"), ("raw_html_chars", _L, 0), ("raw_text_chars", _L, 0), ("main_content_chars", _L, 0),
    ("word_count", _L, 0), ("boilerplate_ratio", _D, 0.0), ("heading_count", _L, 0), ("h1_count", _L, 0), ("h2_count", _L, 0), ("h3_count", _L, 0), ("heading_hierarchy_anomalies", _L, 0),
    ("paragraph_count", _L, 0), ("list_count", _L, 0), ("table_count", _L, 0), ("code_block_count", _L, 0), ("internal_link_count", _L, 0), ("external_link_count", _L, 0),
    ("duplicate_status", _S, "unique"), ("duplicate_of", _S, None), ("similarity", _D, None), ("duplicate_match", _S, None), ("has_canonical", _B, False), ("has_json_ld", _B, False),
    ("has_meta_description", _B, False), ("metadata_available", _B, True), ("robots_checked", _B, False), ("robots_allowed", _B, None), ("robots_url", _S, None),
    ("recommended_chunk_size", _L, 0), ("recommended_chunk_overlap", _L, 0), ("chunking_reason", _S, "No usable content."), ("score_breakdown", SCORES, None), ("reasons", _A, ()),
    ("issues", _A, ()), ("recommendations", _A, ()), ("collected_at", _S, None),
)
PAGE_SCHEMA = StructType([StructField(n, t) for n, t, _ in PAGE_FIELDS])
PAGE_NAMES = tuple(n for n, _, _ in PAGE_FIELDS)
