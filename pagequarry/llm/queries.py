"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import lines, mixing, packing, pages, records, spans
from pagequarry.llm.sql import ORACLES  # noqa: F401
from pagequarry.sources.tables import table, wide


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that stand in six or more rows of their site."""
    return lines.found(table(spark, sf_dir, "dataset_rows"), table(spark, sf_dir, "page_results"))


def p1_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's text without the lines that its site repeats, near-duplicates included."""
    return lines.strip_lines(table(spark, sf_dir, "dataset_rows"), table(spark, sf_dir, "page_results"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose html shows residue or a message instead of content."""
    return pages.residue_rows(wide(table(spark, sf_dir, "dataset_rows")))


def p2_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the rows that remain for the audit."""
    return pages.without_residue(wide(table(spark, sf_dir, "dataset_rows"))).select("row_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each further row of a record, with the record's first row."""
    return records.pairs(table(spark, sf_dir, "dataset_rows"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its number of copies."""
    return records.collapse(table(spark, sf_dir, "dataset_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of foreign markup in each field."""
    return pages.markup_kinds(wide(table(spark, sf_dir, "dataset_rows")))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field as clean text."""
    return pages.clean_texts(wide(table(spark, sf_dir, "dataset_rows")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each page that do not belong to its main body."""
    return pages.aside_blocks(wide(table(spark, sf_dir, "dataset_rows")))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each page."""
    return pages.main_bodies(wide(table(spark, sf_dir, "dataset_rows")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, for each capacity."""
    return packing.pack_documents(wide(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers of each capacity are used, and the least possible number."""
    return packing.usage(p6_containers(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for each mix, by training position."""
    sizes = mixing.sized(wide(table(spark, sf_dir, "documents")))
    return mixing.draw(sizes, mixing.plan_mixes(sizes, table(spark, sf_dir, "mix_targets")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each mix really reaches."""
    sizes = mixing.sized(wide(table(spark, sf_dir, "documents")))
    plan = mixing.plan_mixes(sizes, table(spark, sf_dir, "mix_targets"))
    return mixing.shares(mixing.draw(sizes, plan), plan)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a verbatim run of 200 characters or more."""
    return spans.found(wide(table(spark, sf_dir, "documents")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    return spans.shares(wide(table(spark, sf_dir, "documents")))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document that stand elsewhere too."""
    return spans.passages(wide(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_stripped, p2_found, p2_remaining, p3_found, p3_records, p4_found, p4_clean, p5_found, p5_bodies, p6_containers, p6_usage, p7_drawn, p7_shares, p8_found, p8_shares, p8_passages)}
