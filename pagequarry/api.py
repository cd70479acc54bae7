"""The audit of a dataset or a captured website as one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.config import AuditConfig
from pagequarry.functions import urls
from pagequarry.operators import crawl, report, scoring, sinks
from pagequarry.operators.adapt import adapt, limit_rows, source_rows
from pagequarry.operators.dedup import mark_duplicates
from pagequarry.operators.diagnostics import audited, diagnostics
from pagequarry.plans.lineage import store
from pagequarry.sources import snapshot


@dataclass
class AuditResult:
    """All pages of an audit; ``pages`` keeps those audited, ``diagnostics`` the others."""

    every: DataFrame
    source: str
    discovered: int
    selected: int
    warnings: tuple[str, ...]
    mode: str = "dataset"
    ai_metadata: dict | None = None

    @property
    def pages(self) -> DataFrame:
        return self.every.where("status = 'audited'")

    @property
    def diagnostics(self) -> DataFrame:
        return self.every.where("status != 'audited'")

    def report(self) -> dict:
        """The report as a dictionary."""
        return report.build(
            self.every, mode=self.mode, source=self.source, discovered=self.discovered, selected=self.selected, warnings=self.warnings, ai_metadata=self.ai_metadata
        )

    def write(self, folder: str) -> None:
        """Pages, diagnostics and report to a folder that has none yet."""
        sinks.write_pages(self.every, folder)
        sinks.write_report(self.every, self.report(), folder)

    def view(self, name: str) -> None:
        """All pages as a temporary view for SQL."""
        self.every.createOrReplaceTempView(name)


def audit_pages(rows: DataFrame, config: AuditConfig = AuditConfig(max_pages=None), scope: str | None = "dataset_id") -> DataFrame:
    """Every selected source row as a page, audited or with a diagnosis.

    ``rows`` may have any of the recognised fields; other columns are ignored.
    Duplicates are sought within ``scope``; over all rows where it is None.
    """
    docs = store(adapt(limit_rows(source_rows(rows), config.max_pages)))
    good = docs.where("error is null")
    renamed = good.withColumns({"title": F.col("page_title"), "url": F.col("page_url"), "requested_url": F.col("page_url"), "final_url": F.nullif("page_url", F.lit(""))})
    scored = scoring.score(mark_duplicates(renamed, config.detect_duplicates, scope))
    bad = docs.where("error is not null").select("source_id", "error")
    return audited(scored).unionByName(diagnostics(bad))


def audit(rows: DataFrame, config: AuditConfig = AuditConfig(max_pages=None)) -> AuditResult:
    """Audit of one dataset with its report."""
    pages = store(audit_pages(rows, config))
    discovered, selected = rows.count(), pages.count()
    warnings = []
    if not config.detect_duplicates:
        warnings.append(report.DUPLICATES_OFF)
    if discovered > selected:
        warnings.append(report.ROWS_LEFT)
    if not selected:
        warnings.append(report.NO_ROWS)
    return AuditResult(pages, config.dataset_id, discovered, selected, tuple(warnings))


def audit_website(captured: DataFrame, config: AuditConfig) -> AuditResult:
    """Audit of one website over a capture snapshot (capture_id, url, status, mime, redirect_location, body, resolved_ips, captured_at)."""
    pages, warnings = crawl.audit_site(captured, config)
    pages = store(pages)
    selected = pages.count()
    if not config.detect_duplicates:
        warnings = [*warnings, report.DUPLICATES_OFF]
    start = urls.normalize(config.start_url)
    files = {}
    if config.check_ai_metadata:
        one = captured.sparkSession.createDataFrame([(start,)], "start_url string")
        for r in snapshot.text_files(one, crawl.responses(captured)).collect():
            key = r["name"].replace("-", "_").replace(".", "_")
            files |= {f"{key}_present": r["present"], f"{key}_status": r["status"], f"{key}_error": r["error"]}
    return AuditResult(pages, urls.host_of(start), selected, selected, tuple(dict.fromkeys(warnings)), "website", files)
