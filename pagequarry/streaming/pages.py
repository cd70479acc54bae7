"""Continuous audits: rows are adapted and scored as they arrive, exact duplicates are kept in state.

In a stream the first row to arrive stands for its text. Near-duplicates need
the whole corpus and stay with the batch audit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from pagequarry.functions.hashing import fingerprints
from pagequarry.operators import scoring
from pagequarry.operators.adapt import adapt, source_rows
from pagequarry.operators.diagnostics import audited, diagnostics

MARKED = "source_id string, duplicate_status string, duplicate_of string, duplicate_match string"


def _mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first = state.get if state.exists else None
    for f in batches:
        f = f.sort_values(["row_index", "source_id"])
        out = []
        for ref, raw in zip(f["source_id"], f["raw"]):
            if first is None:
                first = (ref, raw)
                state.update(first)
                out.append((ref, "unique", None, None))
            elif ref != first[0]:
                out.append((ref, "exact_duplicate", first[0], "exact" if raw == first[1] else "normalized_exact"))
        yield pd.DataFrame(out, columns=["source_id", "duplicate_status", "duplicate_of", "duplicate_match"])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(source_id, duplicate_status, duplicate_of, duplicate_match) of a stream of adapted documents.

    State is one reference and one digest per distinct normalized text.
    """
    texts = docs.where("error is null and length(body_text) > 0")
    keyed = texts.select("source_id", "row_index", F.sha2("body_text", 256).alias("raw"), fingerprints(F.col("body_text"), F.lit(False))["norm"].alias("norm"))
    return keyed.groupBy("norm").applyInPandasWithState(_mark, MARKED, "ref string, raw string", "append", "NoTimeout")


def audit_stream(rows: DataFrame) -> DataFrame:
    """Pages of a stream of source rows, with duplicates not checked. ``rows`` has dataset_id and row_index."""
    docs = adapt(source_rows(rows))
    nothing = {"duplicate_of": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "duplicate_match": F.lit(None).cast("string"), "duplicate_status": F.lit("not_checked")}
    good = docs.where("error is null").withColumns({"title": F.col("page_title"), "url": F.col("page_url"), "requested_url": F.col("page_url"), **nothing})
    return audited(scoring.score(good)).unionByName(diagnostics(docs.where("error is not null").select("source_id", "error")))


def status_windows(results: DataFrame, time: str = "ingested_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Results by status in windows of event time; what comes later than ``late`` is dropped."""
    w = results.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "status").agg(F.count(F.lit(1)).alias("results"))
    return w.select(F.col("w.start").alias("window_start"), "status", "results")
