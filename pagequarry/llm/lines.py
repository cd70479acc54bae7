"""Problem 1: lines repeated across the documents of one site.

Lines are masked (numbers, dates, names), clustered within their site by
locality-sensitive hashing over shingles of five characters at a similarity of
0.7, and clusters that stand in many documents are removed. Shingles of
characters see variants of short lines, too: of a line of twelve words in which
one is another, two thirds of the shingles of five words differ, but less than a
quarter of those of characters. What is compared and shuffled is one row per
distinct masked line of a site (a node), not one per line.

Nodes that share a bucket are compared in blocks of bounded size, first by a
sketch (32 bytes of their least hashes), then by their shingles; connected
components of what is similar are the clusters.

Defined results: null texts have no lines; a row without site (no result, null
or empty url) has no repeated lines; row ids are unique; of a repeated id each
row counts for a line, and all as one for a cluster of lines in fewer rows; blank lines are numbered but never repeated lines. Empty tables
give empty results. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pagequarry.operators.graph import components
from pagequarry.plans.lineage import store

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NAME = r"(?<=[\p{L}\p{N},;:|(-]\s)\p{Lu}[\p{L}\p{M}'’-]*"
BYLINE = r"(?i)^\W*(?:(?:written|posted|published) by|by|von|par|por|di|autor|author|auteur|autore)\b"
CHARS = 5
SIMILARITY = 0.7
#: A pair at the limit is missed in 12 % of cases, one at 0.78 in 2.5 %, one at 0.85 in 0.2 %.
BANDS, ROWS_PER_BAND = 8, 4
#: Of the bytes of two sketches so many agree, or the pair is not looked at (a pair at the limit has 0.7; deviation 0.08).
SKETCH_AGREES = 0.45
SALTS = 16
BUCKET = 512
#: Nodes that a task remembers, so as not to repeat them.
SEEN = 1 << 20


def normal(line: Column) -> Column:
    """Lower case, each run of 0-9 as one sign, each run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def mask(line: Column) -> Column:
    """``normal`` with numbers, dates and times as 0, and names as n.

    Names are capitals within the line; where these make up more than a third of its words they name
    things (as in German, or in a title), which are masked only in a byline.
    """
    few = F.regexp_count(line, F.lit(NAME)) * 3 <= F.regexp_count(line, F.lit(r"\S+"))
    named = F.when(line.rlike(r"\p{Ll}") & (few | line.rlike(BYLINE)), F.regexp_replace(line, NAME, "n")).otherwise(line)
    return normal(F.regexp_replace(named, r"[0-9]+(?:[-/.:,][0-9]+)*", "0"))


def sites(rows: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, text, site): the site of a row is the host of its result's url.

    There are as many sources as rows, so their sites are never broadcast, however small.
    """
    host = F.regexp_replace(F.lower(F.try_parse_url(F.trim("url"), F.lit("HOST"))), r"^www\.", "")
    found = results.where(F.col("url") != "").groupBy("source_id").agg(F.min(host).alias("site")).where(F.length("site") > 0)
    source = F.concat_ws(":", F.lit("dataset"), F.col("dataset_id"), F.col("row_index").cast("string"))
    return rows.where("text is not null").select("row_id", "text", source.alias("source_id")).join(found.hint("merge"), "source_id").drop("source_id")


def split_lines(docs: DataFrame) -> DataFrame:
    """(row_id, line_no, key, site, node, masked) of each line that has a letter.

    Equal lines of a site have one ``key``, equal masked ones one ``node``; only the first of a key in a row has a node.
    """
    with_keys = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("no"), F.when(x.rlike(r"\p{L}"), F.xxhash64("site", normal(x))).alias("key"), x.alias("line")))
    lettered = F.filter(with_keys, lambda e: e["key"].isNotNull())
    d = docs.select("row_id", "site", lettered.alias("ls")).select("row_id", "site", "ls", F.col("ls.key").alias("ks"))
    e = d.select("row_id", "site", "ks", F.posexplode("ls").alias("at", "l"))
    masked = F.when(F.array_position("ks", F.col("l.key")) == F.col("at") + 1, mask(F.col("l.line")))
    e = e.select("row_id", F.col("l.no").alias("line_no"), F.col("l.key").alias("key"), "site", masked.alias("masked"))
    return e.select("row_id", "line_no", "key", "site", F.when(F.col("masked").isNotNull(), F.xxhash64("site", "masked")).alias("node"), "masked")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, site, masked): each node's length, buckets and sketch, from the least hashes of its shingles.

    A node is given once of the last ``SEEN`` or so, not of all.
    """
    seen: set[int] = set()
    seeds = [np.uint64(xxhash.xxh64_intdigest(b"seed", k)) for k in range(BANDS * ROWS_PER_BAND)]
    for batch in batches:
        if not batch.num_rows:
            continue
        node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        if len(seen) > SEEN:
            seen.clear()
        new = np.fromiter((k not in seen for k in node.tolist()), bool, len(node))
        node, first = node[new], first[new]
        seen.update(node.tolist())
        if not len(node):
            continue
        masked = batch.column(2).take(pa.array(first))
        site = np.array([xxhash.xxh64_intdigest(s) for s in batch.column(1).take(pa.array(first)).to_pylist()], np.uint64)
        codes = np.frombuffer("".join(masked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = pc.utf8_length(masked).to_numpy()
        # One shingle per place up to the last whole one; a shorter line is one shingle, filled up with zeros.
        many = np.maximum(size - (CHARS - 1), 1)
        starts = np.concatenate([[0], np.cumsum(many)[:-1]])
        begin = np.cumsum(size) - size
        at = np.arange(many.sum()) - np.repeat(starts - begin, many)
        codes = np.concatenate([codes, np.zeros(CHARS, np.uint64)])
        grams = np.zeros(len(at), np.uint64)
        short = np.repeat(size < CHARS, many)
        ends = np.repeat(begin + size, many)
        for k in range(CHARS):
            c = codes[at + k]
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + (np.where(short & (at + k >= ends), np.uint64(0), c) if short.any() else c)
        grams ^= grams >> np.uint64(32)
        least = np.empty((len(seeds), len(node)), np.uint64)
        for k, seed in enumerate(seeds):
            least[k] = np.minimum.reduceat((grams ^ seed) * np.uint64(0xBF58476D1CE4E5B9), starts)
        least ^= least >> np.uint64(29)
        buckets = np.empty((len(node), BANDS), np.uint64)
        for b in range(BANDS):
            bucket = site + np.uint64(b)
            for r in range(ROWS_PER_BAND):
                bucket = bucket * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS_PER_BAND + r]
                bucket ^= bucket >> np.uint64(31)
            buckets[:, b] = bucket
        sketch = np.ascontiguousarray((least & np.uint64(255)).astype(np.uint8).T).view(np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(buckets.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(size.astype(np.int32)), lists, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(sketch.shape[1]))], ["node", "chars", "buckets", *SKETCH])


SKETCH = [f"s{k}" for k in range(BANDS * ROWS_PER_BAND // 8)]


def _agreeing(x: Column, y: Column) -> Column:
    """Bytes of two longs that agree: each byte of their difference is folded into its last bit."""
    d = x.bitwiseXOR(y)
    for by, kept in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        d = d.bitwiseOR(F.shiftrightunsigned(d, by)).bitwiseAND(F.lit(kept))
    return 8 - F.bit_count(d)


@lru_cache(1 << 14)
def shingles(masked: str) -> frozenset[str]:
    """Distinct shingles of five characters; all characters where there are fewer."""
    return frozenset(masked[i : i + CHARS] for i in range(max(1, len(masked) - CHARS + 1)))


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) >= SIMILARITY for x, y in zip(a, b)], dtype="bool")


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (key, other) whose lines are similar."""
    chosen = pairs.select(F.col("key").alias("node")).unionByName(pairs.select(F.col("other").alias("node"))).distinct()
    text = store(nodes.select("node", "masked").join(chosen, "node").dropDuplicates(["node"]))
    named = pairs.join(text.select(F.col("node").alias("key"), F.col("masked").alias("a")), "key").join(text.select(F.col("node").alias("other"), F.col("masked").alias("b")), "other")
    return named.where(F.pandas_udf(_alike, BooleanType())("a", "b")).select("key", "other")


def _candidates(member: DataFrame, by: list[str], which: Column | None = None) -> DataFrame:
    """(key, other): pairs of ``member`` (node, chars, sketch) with equal ``by`` whose sketches and lengths allow for similarity."""
    a, b = member.alias("a"), member.alias("b")
    agree = sum((_agreeing(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in SKETCH), F.lit(0))
    # Shingles of two lines at the limit differ in number by a third at most; repeated ones allow for more characters.
    fits = (F.least("a.chars", "b.chars") >= 0.5 * F.greatest("a.chars", "b.chars")) & (agree >= SKETCH_AGREES * 8 * len(SKETCH))
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by] + [F.col("a.node") < F.col("b.node")]).where(fits if which is None else fits & which)
    return met.select(F.col("a.node").alias("key"), F.col("b.node").alias("other"))


def close_lines(nodes: DataFrame) -> DataFrame:
    """(key, other): pairs of ``nodes`` (node, site, masked) of a site that share a bucket and are
    similar, as many as link all that are.

    A node may stand in several rows. In a bucket of more than ``BUCKET`` nodes those like the least one
    are linked by it and not compared with each other; all others are compared with all.
    """
    sketch = ", ".join(f"{c} long" for c in SKETCH)
    signed = store(nodes.select("node", "site", "masked").mapInArrow(_signatures, f"node long, chars int, buckets array<long>, {sketch}"))
    member = signed.select("node", F.explode("buckets").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    met = store(member.join(sizes, "bucket").distinct())
    large = met.where("parts > 1")
    links = None
    met = met.withColumn("apart", F.lit(True))
    if not large.isEmpty():
        lead = large.groupBy("bucket").agg(F.min("node").alias("key"))
        led = store(large.join(lead, "bucket").select("bucket", "key", F.col("node").alias("other")))
        links = store(_verified(led.where("key < other").select("key", "other").distinct(), nodes))
        near = led.join(links, ["key", "other"]).select("bucket", F.col("other").alias("node"), F.lit(False).alias("far"))
        near = near.unionByName(lead.select("bucket", F.col("key").alias("node"), F.lit(False).alias("far")))
        met = met.drop("apart").join(near, ["bucket", "node"], "left").select("bucket", "node", "parts", ((F.col("parts") == 1) | F.coalesce("far", F.lit(True))).alias("apart"))
    once = signed.select("node", "chars", *SKETCH).join(met.select("node").distinct(), "node").dropDuplicates(["node"])
    member = met.join(once, "node")
    # Both sides of a small bucket are the same rows, shuffled once; large buckets are cut into blocks.
    pairs = _candidates(member.where("parts = 1").drop("parts", "apart"), ["bucket"])
    if links is not None:
        blocks = member.where("parts > 1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("each", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = blocks.withColumns({"low": F.least("own", "each"), "high": F.greatest("own", "each")}).drop("each", "parts").distinct()
        once_only = (F.col("a.low") == F.col("a.high")) | (F.col("a.own") != F.col("b.own"))
        pairs = pairs.unionByName(_candidates(blocks, ["bucket", "low", "high"], once_only & (F.col("a.apart") | F.col("b.apart"))))
    pairs = store(pairs.distinct())
    close = _verified(pairs, nodes)
    return close if links is None else close.unionByName(links)


def clusters(lines: DataFrame) -> DataFrame:
    """(key, rows, node, cluster) of each distinct line of a site; ``cluster`` is null where it is linked to no other.

    ``rows`` is the number of rows the line stands in. Lines that are equal after masking are one node;
    nodes that are linked, be it through others or by a line that is masked in two ways, are one
    cluster, named by its least node; so are the lines of one node.
    """
    first = lines.where("node is not null")
    once = store(first.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("node"), F.max("node").alias("last")))
    close = close_lines(first.select("node", "site", "masked"))
    joined = components(close.unionByName(once.where("node < last").select(F.col("node").alias("key"), F.col("last").alias("other"))))
    named = joined.select(F.col("key").alias("node"), "cluster").unionByName(joined.select(F.col("cluster").alias("node"), "cluster").distinct())
    alike = once.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.col("node").alias("cluster"))
    named = named.unionByName(alike).groupBy("node").agg(F.min("cluster").alias("cluster"))
    return once.join(named, "node", "left").select("key", "rows", "node", "cluster")


def heavy_lines(c: DataFrame, lines: DataFrame, min_rows: int) -> DataFrame:
    """(key, cluster, line_rows) of the lines of clusters that stand in ``min_rows`` different rows or more.

    One line in that many rows is enough, and lines in fewer rows by their sum are not; only what is
    between, where no line stands in ``min_rows`` rows, has its rows counted. Lines alone are not grouped.
    """
    linked = c.where("cluster is not null")
    sums = linked.groupBy("cluster").agg(F.max("rows").alias("most"), F.sum("rows").alias("total")).where(F.col("total") >= min_rows)
    sure = sums.where(F.col("most") >= min_rows).select("cluster")
    open_keys = linked.join(sums.where(F.col("most") < min_rows).select("cluster"), "cluster").select("key", "cluster")
    rows = lines.where("node is not null").select("row_id", "key").join(open_keys, "key").select("cluster", "row_id").distinct()
    counted = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("cluster")
    heavy = linked.join(sure.unionByName(counted), "cluster").select("key", "cluster", "rows")
    alone = c.where(F.col("cluster").isNull() & (F.col("rows") >= min_rows)).select("key", F.col("node").alias("cluster"), "rows")
    return heavy.unionByName(alone).withColumnRenamed("rows", "line_rows")


def repeated_lines(rows: DataFrame, results: DataFrame, min_rows: int = 6) -> DataFrame:
    """(row_id, line_no, cluster, line_rows) of the lines of clusters that stand in
    ``min_rows`` different rows or more of their site, the lines of a cluster taken together.
    """
    lines = store(split_lines(sites(rows, results)))
    c = store(clusters(lines))
    keys = heavy_lines(c, lines, min_rows)
    # A line of a large site stands in very many rows: spread each key.
    salted = lines.select("row_id", "line_no", "key", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).alias("_salt"))
    spread = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["key", "_salt"]).select("row_id", "line_no", "cluster", "line_rows")


def found(rows: DataFrame, results: DataFrame, min_rows: int = 6) -> DataFrame:
    """(row_id, line_no) of the repeated lines that stand, as such, in ``min_rows`` rows of the site."""
    hits = repeated_lines(rows, results, min_rows)
    return hits.where(F.col("line_rows") >= min_rows).select("row_id", "line_no")


def strip_lines(rows: DataFrame, results: DataFrame, min_rows: int = 6) -> DataFrame:
    """(row_id, text, removed): each row's text without the lines of heavy clusters.

    Rows with a null text keep it, with nothing removed.
    """
    hits = repeated_lines(rows, results, min_rows).groupBy("row_id").agg(F.collect_set("line_no").alias("bad"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("bad", (i + 1).cast("long")))
    joined = rows.select("row_id", "text").join(hits, "row_id", "left")
    clean = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("row_id", clean.alias("text"), F.coalesce(F.size("bad"), F.lit(0)).alias("removed"))
