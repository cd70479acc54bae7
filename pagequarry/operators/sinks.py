"""Writing the outputs of an audit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_pages(pages: DataFrame, folder: str) -> None:
    """Audited pages to ``folder/pages``, all others to ``folder/diagnostics``; refuses a folder that has them."""
    for name, test in (("pages", "status = 'audited'"), ("diagnostics", "status != 'audited'")):
        pages.where(test).write.mode("errorifexists").parquet(f"{folder}/{name}")


def write_report(pages: DataFrame, report: dict, folder: str) -> None:
    """The report as one line of JSON in ``folder/report``."""
    line = pages.sparkSession.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string")
    line.coalesce(1).write.mode("errorifexists").text(f"{folder}/report")


def overview(pages: DataFrame) -> DataFrame:
    """The columns to look at first."""
    return pages.select("url", "rag_readiness_score", "rag_value", "recommended_for_rag", "estimated_tokens", "duplicate_status", "content_status", "issues")
