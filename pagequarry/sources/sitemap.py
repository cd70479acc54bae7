"""URLs of sitemap files, plain or gzipped, from captured bodies."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zlib
from io import BytesIO

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of one file and of a traversal.
MAX_BYTES, MAX_URLS, MAX_NESTING = 2_000_000, 10_000, 32
MAX_FILES, MAX_DEPTH = 20, 3
RESULT = "kind string, urls array<string>, truncated boolean, error string"


def parse(body: bytes, limit: int = MAX_URLS) -> dict:
    """kind (urlset, sitemapindex), urls in order, whether there were more, and the code of an error."""
    failed = lambda code: {"kind": None, "urls": [], "truncated": False, "error": code}
    if body[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(wbits=31)
        try:
            body = unzip.decompress(body, MAX_BYTES + 1)
        except zlib.error:
            return failed("malformed_sitemap")
        if len(body) <= MAX_BYTES and not unzip.unconsumed_tail and (unzip.unused_data or not unzip.eof):
            return failed("malformed_sitemap")
    if len(body) > MAX_BYTES:
        return failed("too_large")
    upper = body.upper()
    if b"\x00" in body or b"<!DOCTYPE" in upper or b"<!ENTITY" in upper:
        return failed("malformed_sitemap")
    kind, nesting, urls = None, 0, {}
    try:
        for event, element in ET.iterparse(BytesIO(body), ("start", "end")):
            name = element.tag.rpartition("}")[2]
            if event == "start":
                nesting += 1
                kind = kind or name
                if nesting > MAX_NESTING or kind not in ("urlset", "sitemapindex"):
                    return failed("malformed_sitemap")
                continue
            nesting -= 1
            place = (element.text or "").strip() if name == "loc" and element.text else None
            element.clear()
            if place is not None and place not in urls:
                if len(urls) >= limit:
                    return {"kind": kind, "urls": list(urls), "truncated": True, "error": None}
                urls[place] = None
    except ET.ParseError:
        return failed("malformed_sitemap")
    return {"kind": kind or "urlset", "urls": list(urls), "truncated": False, "error": None}


def parse_column(body: Column) -> Column:
    """``parse`` in Arrow batches; null bodies give nulls."""

    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(("kind", "urls", "truncated", "error")) if b is None else parse(bytes(b)) for b in bodies], columns=["kind", "urls", "truncated", "error"])

    return F.pandas_udf(run, RESULT)(body)
