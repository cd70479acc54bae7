"""Page operators as DataFrame transformations: problems 2, 4 and 5 over a column of HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm import blocks, markup, residue
from pagequarry.llm.dom import parse
from pagequarry.plans.lineage import store

#: Documents whose pieces are labelled together.
TOGETHER = 256
#: Parts of a body that very many rows show.
SALTS = 16


def _aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nids = [], []
        for row_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parse(html)
            items, _, body = blocks.classify(page)
            aside = blocks.aside_ids(page, items, body)
            ids += [row_id] * len(aside)
            nids += aside
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nids, pa.int64())], ["row_id", "nid"])


def aside_blocks(rows: DataFrame, id_col: str = "row_id", html_col: str = "html") -> DataFrame:
    """(row_id, nid): the ids of elements of each page that do not belong to its main body; none where no element has an id."""
    html = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(html_col).alias("html")).where("html != ''")
    return html.mapInArrow(_aside, "row_id long, nid long").distinct()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parse(html)
            items, _, body = blocks.classify(page)
            texts = [page.string(i) for i in items]
            main = "\n".join(t for t, b in zip(texts, body) if b and t)
            every = sum(map(len, texts))
            out.append((row_id, main, len(main), round(1 - sum(len(t) for t, b in zip(texts, body) if b) / every, 4) if every else 0.0))
        cols = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row_id", "body", "body_chars", "aside_share"])


def main_bodies(rows: DataFrame, id_col: str = "row_id", html_col: str = "html") -> DataFrame:
    """(row_id, body, body_chars, aside_share): only the main body of each page.

    A null or empty html has no row; a page without blocks has an empty body.
    """
    html = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(html_col).alias("html")).where("html != ''")
    return html.mapInArrow(_bodies, "row_id long, body string, body_chars long, aside_share double")


_SIGNS = ["placeholder", "filler", "notice", "errors", "short", "match", "chars", "print"]
_SIGN_TYPES = [pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.float64(), pa.int32(), pa.int64()]


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, html, address, title = (c.to_pylist() for c in batch.columns)
        found = [residue.detect(parse(h), a or "", t or "") for h, a, t in zip(html, address, title)]
        cols = [pa.array([f[k] for f in found], t) for k, t in zip(_SIGNS, _SIGN_TYPES)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols, batch.column(2)], ["row_id", *_SIGNS, "address"])


def residue_signs(rows: DataFrame) -> DataFrame:
    """One row per page with what its detectors found, on how many addresses its host shows
    the same body (``shown``), and on how many hosts it is shown (``hosts``).

    Rows of one address count once; a row without address is no evidence.
    """
    address = F.coalesce(*[F.when(F.col(c).rlike(r"(?i)^\s*https?://"), F.trim(c)) for c in ("loadedurl", "url", "canonicalurl")])
    html = rows.select(F.col("row_id").cast("long").alias("row_id"), "html", address.alias("address"), "title").where("html != ''")
    kinds = "placeholder boolean, filler boolean, notice boolean, errors int, short boolean, match double, chars int, print long"
    signs = store(html.mapInArrow(_signs, f"row_id long, {kinds}, address string"))
    # Host evidence: only bodies of low information, by their print; counted before it is joined.
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col("address"), F.lit("HOST"))), r"^www\.", "")
    place = F.regexp_replace(F.lower("address"), r"^https?://(?:www\.)?|[?#].*$|/+$", "")
    seen = signs.where("short").select("row_id", "print", host.alias("host"), place.alias("place")).where("host is not null")
    shown = seen.groupBy("print", "host", "place").agg(F.lit(1).alias("one")).groupBy("print", "host").agg(F.count(F.lit(1)).alias("shown"))
    counted = store(shown)
    hosts = counted.groupBy("print").agg(F.count(F.lit(1)).alias("hosts"))
    # Only what is shown twice is evidence; a message that very many rows show is spread.
    spread = counted.join(hosts, "print").where("shown > 1 or hosts > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = seen.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    evidence = salted.join(spread, ["print", "host", "_salt"]).groupBy("row_id").agg(F.max("shown").alias("shown"), F.max("hosts").alias("hosts"))
    one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
    return signs.join(evidence, "row_id", "left").select("row_id", *_SIGNS, one("shown"), one("hosts"))


def is_residue() -> Column:
    """Whether the signs of a page are those of a page without real content.

    A body of low information is a message by two pieces of evidence: error phrases (each one),
    an address and title that it does not fit, and the same body at other addresses or hosts.
    Without a phrase, it must fit nothing and be shown at five addresses or more.
    """
    differs, repeated = F.coalesce(F.col("match") < 0.5, F.lit(False)), (F.col("shown") >= 3) | (F.col("hosts") >= 3)
    votes = F.least("errors", F.lit(2)) + differs.cast("int") + repeated.cast("int")
    alien = F.coalesce(F.col("match") < 0.2, F.lit(False)) & ((F.col("shown") >= 5) | (F.col("hosts") >= 5))
    message = F.col("short") & (((F.col("errors") >= 1) & (votes >= 2)) | alien)
    return F.col("placeholder") | F.col("filler") | F.col("notice") | message


def residue_rows(rows: DataFrame) -> DataFrame:
    """(row_id): pages that show residue or a message instead of content.

    Null and empty html is no case.
    """
    return residue_signs(rows).where(is_residue()).select("row_id").distinct()


def without_residue(rows: DataFrame) -> DataFrame:
    """The rows that remain: all but those of ``residue_rows``, whatever their other columns."""
    return rows.join(residue_rows(rows), "row_id", "left_anti")


def _kinds(is_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            docs = [markup.html_texts(parse(t)) if is_html else markup.markdown_texts(t) for t in texts]
            out = [(i, k) for i, doc in zip(ids, markup.label(docs, is_html)) for k in sorted(markup.kinds(doc, "" if is_html else "markdown"))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], ["row_id", "markup"])

    return run


def _rendered(is_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            out: list[str] = []
            for at in range(0, len(texts), TOGETHER):
                some = texts[at : at + TOGETHER]
                out += markup.render_all([markup.page_steps(parse(t)) if is_html else markup.markdown_steps(t) for t in some], is_html)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["row_id", "clean"])

    return run


def _by_field(rows: DataFrame, run, schema: str) -> DataFrame:
    parts = []
    for field in ("markdown", "html"):
        t = rows.select(F.col("row_id").cast("long").alias("row_id"), field).where(F.col(field) != "")
        parts.append(t.mapInArrow(run(field == "html"), schema).withColumn("field_name", F.lit(field)))
    return parts[0].unionByName(parts[1])


def markup_kinds(rows: DataFrame) -> DataFrame:
    """(row_id, field_name, markup): the kinds of foreign markup that ``markdown`` and ``html`` hold.

    Null and empty fields have no rows.
    """
    return _by_field(rows, _kinds, "row_id long, markup string").select("row_id", "field_name", "markup").distinct()


def clean_texts(rows: DataFrame) -> DataFrame:
    """(row_id, field_name, clean): each field as clean text that shows headings, lists, tables, code and formulas."""
    return _by_field(rows, _rendered, "row_id long, clean string").select("row_id", "field_name", "clean")
