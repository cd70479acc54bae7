"""Source rows to extracted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import html_kernel, text, urls
from pagequarry.plans.lineage import store
from pagequarry.schema import CONTENT_FIELDS, SOURCE_FIELDS, URL_FIELDS

# Limits and thresholds of the adapter.
MAX_SOURCE_CHARS = 1_000_000
MEANINGFUL_CHARS = 40
TITLE_CHARS = 500
# What makes a text HTML, whatever field it comes in.
HTML_SIGN = r"(?i)<(?:!doctype|html|body|main|article|div|p|h[1-6]|script|style|nav|table|section|ul|ol)(?:[\t-\r\x{1c}-\x{20}\x{85}\x{a0}]|>)"
# Messages.
URL_MISSING = "Source URL missing or invalid; use source_id to locate the document."
NO_METADATA = "HTML metadata unavailable; score uses only supplied content signals."
NO_CONTENT = "Source row contains no usable content field."
TOO_LARGE = "Dataset content exceeds the source character limit."
NOTHING_VISIBLE = "HTML field contains no usable visible content."
NOT_PARSED = "Dataset content could not be parsed."


def numbered(rows: DataFrame, dataset: Column, order: list[str]) -> DataFrame:
    """``rows`` with their place in their dataset (from 0) as ``row_index``, by ``order`` and then by all else they hold.

    Rows are sorted into ranges, counted per range, and numbered within it: no task holds a dataset. Rows
    that are equal in everything are numbered in any order.
    """
    texts = [F.col(c) for c in rows.columns if c not in order]
    keyed = rows.withColumns({"_dataset": dataset, "_rest": F.xxhash64(*texts) if texts else F.lit(0).cast("long")})
    by = ["_dataset", *order, "_rest"]
    ranged = store(keyed.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("_dataset").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_dataset", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_dataset", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_dataset", "_range").orderBy(*by[1:]))
    named = offsets.withColumnsRenamed({"_dataset": "_d", "_range": "_r"})
    placed = ranged.withColumn("_at", within).join(named, (F.col("_range") == F.col("_r")) & F.col("_dataset").eqNullSafe(F.col("_d")))
    return placed.withColumn("row_index", (F.col("_offset") + F.col("_at") - 1).cast("long")).drop("_dataset", "_rest", "_range", "_at", "_d", "_r", "_offset")


def source_rows(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The recognised fields as strings (missing ones null), with ``dataset_id`` and a ``row_index`` from 0.

    Where ``row_index`` is missing, rows are numbered by ``order`` within their
    dataset, without it by a hash of what they hold: the same in every run. Other columns are dropped.
    """
    lower = {c.lower(): c for c in rows.columns}
    dataset = F.col("dataset_id") if "dataset_id" in lower else F.lit("rows")
    if "row_index" not in lower:
        rows, lower["row_index"] = numbered(rows, dataset, order or []), "row_index"
    chosen = [(F.col(lower[f]) if f in lower and dict(rows.dtypes)[lower[f]] == "string" else F.lit(None).cast("string")).alias(f) for f in SOURCE_FIELDS]
    return rows.select(dataset.alias("dataset_id"), F.col(lower["row_index"]).cast("long").alias("row_index"), *chosen)


def latest_delivery(rows: DataFrame, by: str = "ingested_at", tie: str = "row_id") -> DataFrame:
    """Of rows delivered again (one dataset and index), the one ingested last."""
    best = rows.groupBy("dataset_id", "row_index").agg(F.max(F.struct(F.col(by), F.col(tie))).alias("_best"))
    kept = best.select(F.col("_best")[tie].alias(tie))
    return rows.join(kept, tie, "left_semi")


def limit_rows(rows: DataFrame, max_pages: int | None) -> DataFrame:
    """The first ``max_pages`` rows of each dataset, unusable ones counted; all where it is None."""
    return rows if max_pages is None else rows.where(F.col("row_index") < max_pages)


def source_id(dataset: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("dataset"), dataset, index.cast("string"))


def choose_content(df: DataFrame) -> DataFrame:
    """Adds ``field`` and ``content``: the first field with 40 characters or more, else the first that is not blank."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("content")) for f in CONTENT_FIELDS])
    usable = F.filter(each, lambda e: F.length(text.trim(e["content"])) > 0)
    long = F.filter(each, lambda e: F.length(text.trim(e["content"])) >= MEANINGFUL_CHARS)
    picked = F.coalesce(F.get(long, F.lit(0)), F.get(usable, F.lit(0)))
    return df.withColumn("_picked", picked).withColumns({"field": F.col("_picked.field"), "content": F.col("_picked.content")}).drop("_picked")


def choose_url(df: DataFrame) -> DataFrame:
    """Adds ``page_url``: the first address that can be normalized, '' where none can."""
    normal = [urls.normalize_url(F.col(c)) for c in URL_FIELDS]
    return df.withColumn("page_url", F.coalesce(*normal, F.lit("")))


def is_html(field: Column, content: Column) -> Column:
    return (field == "html") | content.rlike(HTML_SIGN)


def problem(field: Column, content: Column) -> Column:
    """Code and message of why a row has no document; null where it may have one."""
    none = F.struct(F.lit("dataset_row_unusable").alias("code"), F.lit(NO_CONTENT).alias("message"))
    large = F.struct(F.lit("too_large").alias("code"), F.lit(TOO_LARGE).alias("message"))
    return F.when(field.isNull(), none).when(F.length(content) > MAX_SOURCE_CHARS, large)


def extract(df: DataFrame) -> DataFrame:
    """Measures of each document. ``df`` has source_id, page_url, title, content, field, error.

    Adds the text and the structure columns of a page; HTML goes through the
    kernel, other text through expressions. Rows with an error keep nulls.
    """
    c, f = F.col("content"), F.col("field")
    df = df.withColumn("_html", F.col("error").isNull() & is_html(f, c))
    df = df.withColumn("k", html_kernel.extract_column(F.when(F.col("_html"), c), F.col("page_url")))
    plain = F.col("error").isNull() & ~F.col("_html")
    md = f == "markdown"
    df = df.withColumn("_plain", F.when(plain, F.when(md, text.strip_markdown(c)).otherwise(c)))
    df = df.withColumn("_clean", text.clean_text(F.col("_plain")))
    heads = F.when(plain & md, text.markdown_headings(c)).otherwise(F.array().cast("array<string>"))
    k = lambda name: F.col(f"k.{name}")
    levels = F.coalesce(k("heading_levels"), F.transform(heads, lambda h: F.length(h)))
    pick = lambda name, other: F.when(F.col("_html"), k(name)).otherwise(other)
    only_md = lambda value: F.when(md, value).otherwise(F.lit(0).cast("long"))
    title = F.substring(F.coalesce("title", F.lit("")), 1, TITLE_CHARS)
    words = pick("word_count", text.count_words(F.col("_clean")))
    steps = F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 2, F.greatest(F.size(levels), F.lit(0))), lambda a, b: b > a + 1)
    no_url = F.when(F.col("page_url") == "", F.lit(URL_MISSING))
    listed = F.concat(F.array(no_url), F.when(F.col("_html"), k("kernel_issues")).otherwise(F.array(F.lit(NO_METADATA))))
    at = lambda level: F.size(F.filter(levels, lambda x: x == level)).cast("long")
    out = df.withColumns(
        {
            "body_text": F.coalesce(k("text"), F.col("_clean")),
            "page_title": pick("title", F.when((title == "") & md, F.coalesce(text.markdown_title(c), F.lit(""))).otherwise(title)),
            "word_count": words,
            "raw_html_chars": F.when(F.col("_html"), F.length(c)).otherwise(0).cast("long"),
            "raw_text_chars": pick("raw_text_chars", F.length("_clean").cast("long")),
            "boilerplate_ratio": pick("boilerplate_ratio", F.when(F.col("_clean") == "", 1.0).otherwise(0.0)),
            "heading_count": F.size(levels).cast("long"),
            "h1_count": at(1),
            "h2_count": at(2),
            "h3_count": at(3),
            "heading_hierarchy_anomalies": F.when(F.col("_html"), F.size(F.filter(steps, lambda x: x))).otherwise(0).cast("long"),
            "paragraph_count": pick("paragraph_count", text.count_paragraphs(F.col("_plain"))),
            "list_count": pick("list_count", only_md(text.markdown_lists(c))),
            "table_count": pick("table_count", only_md(text.markdown_tables(c))),
            "code_block_count": pick("code_block_count", only_md(text.markdown_code_blocks(c))),
            "internal_link_count": F.coalesce(k("internal_link_count"), F.lit(0).cast("long")),
            "external_link_count": F.coalesce(k("external_link_count"), F.lit(0).cast("long")),
            "links": F.coalesce(k("links"), F.array().cast("array<string>")),
            "canonical_url": k("canonical_url"),
            "has_canonical": F.coalesce(k("has_canonical"), F.lit(False)),
            "has_json_ld": F.coalesce(k("has_json_ld"), F.lit(False)),
            "has_meta_description": F.coalesce(k("has_meta_description"), F.lit(False)),
            "metadata_available": F.col("_html"),
            "js_shell": F.coalesce(k("js_shell"), F.lit(False)),
            "issues": F.filter(listed, lambda x: x.isNotNull()),
        }
    )
    out = out.withColumns(
        {
            "main_content_chars": F.length("body_text").cast("long"),
            "estimated_tokens": text.estimate_tokens(F.col("body_text")),
            "content_status": text.content_status(F.col("body_text"), F.col("word_count"), F.col("js_shell")),
        }
    )
    unparsed = F.struct(F.lit("parse_error").alias("code"), F.lit(NOT_PARSED).alias("message"))
    unseen = F.struct(F.lit("dataset_row_unusable").alias("code"), F.lit(NOTHING_VISIBLE).alias("message"))
    late = F.when(k("parse_error").isNotNull(), unparsed).when(F.col("_html") & (F.col("body_text") == "") & ~F.col("js_shell"), unseen)
    return out.withColumn("error", F.coalesce("error", late)).drop("k", "_html", "_plain", "_clean", "content")


def adapt(rows: DataFrame) -> DataFrame:
    """Source rows (``source_rows``) to documents with their measures, or an ``error``."""
    df = choose_url(choose_content(rows))
    df = df.withColumn("source_id", source_id(F.col("dataset_id"), F.col("row_index")))
    return extract(df.withColumn("error", problem(F.col("field"), F.col("content"))))
