"""Streaming audits over files that arrive in turn."""

import json
from datetime import datetime

from pagequarry.streaming import pages

TEXT = "A stream of documents is marked as it arrives, and the first of equal texts stands for the others in state. "
SCHEMA = "dataset_id string, row_index long, text string, url string"


def write(folder, k, rows):
    (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("dataset_id", "row_index", "text", "url"), r))) for r in rows))


def drain(df, spark, where):
    """Run what is there to run, and read all that has come out so far."""
    q = df.writeStream.format("parquet").option("path", str(where / "out")).option("checkpointLocation", str(where / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(where / "out")).collect()


def test_exact_duplicates_across_batches(spark, tmp_path):
    from pagequarry.operators.adapt import adapt, source_rows

    data = tmp_path / "in"
    data.mkdir()
    write(data, "a", [("d", 0, TEXT, None), ("d", 1, TEXT.upper(), None), ("d", 2, "", None)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(data))
    marked = pages.exact_duplicates(adapt(source_rows(stream)))
    got = {r.source_id: r for r in drain(marked, spark, tmp_path)}
    assert got["dataset:d:0"].duplicate_status == "unique" and got["dataset:d:1"].duplicate_match == "normalized_exact"
    write(data, "b", [("d", 3, TEXT, None)])
    got = {r.source_id: r for r in drain(marked, spark, tmp_path)}
    assert (got["dataset:d:3"].duplicate_of, got["dataset:d:3"].duplicate_match) == ("dataset:d:0", "exact")


def test_audit_stream(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    write(data, "a", [("d", 0, TEXT * 5, "https://e.com/docs/x"), ("d", 1, None, None)])
    got = {r.source_id: r for r in drain(pages.audit_stream(spark.readStream.schema(SCHEMA).json(str(data))), spark, tmp_path)}
    assert got["dataset:d:0"].status == "audited" and got["dataset:d:0"].rag_readiness_score > 0 and got["dataset:d:1"].error_code == "dataset_row_unusable"


def test_status_windows(spark):
    rows = [("audited", datetime(2026, 1, 1, 0, 10)), ("audited", datetime(2026, 1, 1, 0, 50)), ("failed", datetime(2026, 1, 1, 1, 5))]
    got = pages.status_windows(spark.createDataFrame(rows, "status string, ingested_at timestamp")).collect()
    assert sorted((r.window_start.hour, r.status, r.results) for r in got) == [(0, "audited", 2), (1, "failed", 1)]
