"""Problem 8: long verbatim spans shared between documents.

Tokens are the hashes of ``GRAM`` characters in a row. A span of ``least``
characters has ``least - GRAM + 1`` of them, and all its copies have the same
least one. The compact windows of a text, the nodes of its Cartesian tree that
span so many tokens or more, give for every such span its least token, as
intervals of places where the spans begin; so two texts that share a span meet
under its token, whatever else they hold, and one hash function finds every
exact span.

``found`` gives the pairs of documents: the surroundings of places that meet are
compared character by character, each surrounding of a document once.

``shared_spans`` needs no pairs, so its work grows with the texts alone: the
stretch of text that a compact window covers is looked up whole (by a 128-bit
digest), and only where no other document has the whole stretch, its spans one
by one. Each span of a text lies in one compact window.

Of exact copies only the first takes part until the end. A token that many
texts share is joined in blocks of texts, never in one task.

Defined results: null texts and texts shorter than ``least`` share nothing
(share 0.0); rows of one id count as one document, which never forms a pair
with itself. Empty tables give empty results. Other columns are
ignored. Characters are code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.plans.lineage import cut, store

LEAST = 200
GRAM = 100
#: Occurrences of one token that are paired within one block.
BLOCK = 256
SALTS = 16
#: Texts are searched for windows in pieces of so many tokens, overlapping by a window.
PIECE = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` code points."""
    n = len(codes)
    if n < gram:
        return np.zeros(0, np.uint64)
    out = np.empty(n - gram + 1, np.uint64)
    step = PIECE - gram + 1
    up, down = _powers(PIECE)
    for at in range(0, len(out), step):  # pieces keep the powers short
        x = codes[at : at + PIECE].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out[at : at + step] = h[:step]
    return out


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """(first, last, lo, hi) of the compact windows of at least ``width`` tokens, by the Cartesian tree.

    The root of a stretch is its leftmost least token; stretches narrower than
    ``width`` are not divided further. ``first`` to ``last`` is the run of equal
    tokens at the root: any two copies of a span have one of its ends in common.
    Runs of ``width`` tokens that begin at ``lo`` to ``hi`` have the root as
    their least; each run of the text is in one window.
    """
    found = []
    for at in range(0, max(1, len(h) - width + 1), PIECE):
        todo = [(at, min(len(h), at + PIECE + width - 1))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < width:
                continue
            mid = lo + int(h[lo:hi].argmin())
            end = mid
            if mid + 1 < hi and h[mid + 1] == h[mid]:
                differ = np.flatnonzero(h[mid:hi] != h[mid])
                end = mid + int(differ[0]) - 1 if len(differ) else hi - 1
            found.append((mid, end, max(lo, mid - width + 1), min(end, hi - width)))
            todo.append((lo, mid))
            todo.append((end + 1, hi))
    return sorted(found)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(least: int, gram: int):
    """Of each text, a row per window, and one more for the other end of a run of equal tokens (with no spans: hi < lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows, tokens = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = gram_hashes(_codes(text), gram)
                at = compact_windows(h, least - gram + 1)
                at = np.array([(a, lo, hi) for a, _, lo, hi in at] + [(b, 0, -1) for a, b, _, _ in at if a < b], np.int32).reshape(-1, 3)
                of.append(np.full(len(at), i))
                rows.append(at)
                tokens.append(h[at[:, 0]].view(np.int64))
            if of:
                all_rows = np.concatenate(rows)
                cols = [batch.column(0).take(pa.array(np.concatenate(of).astype(np.int64))), pa.array(np.concatenate(tokens)), *(pa.array(all_rows[:, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "token", "place", "lo", "hi"])

    return run


def _around(least: int, gram: int):
    """The characters around each place that decide whether it lies in a span, enough to the left and right; each such surrounding of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, text, tokens, places, blocks in zip(*(col.to_pylist() for col in batch.columns)):
                once = {(t, n, text[max(0, p - least + gram) : p][::-1], text[p : p + least]) for t, p, n in zip(tokens, places, blocks)}
                out += [(c, *x) for x in once]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.string()))], ["id", "token", "blocks", "left", "right"])

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _extent(la: pd.Series, ra: pd.Series, lb: pd.Series, rb: pd.Series) -> pd.DataFrame:
    """How far two places agree to the left and to the right."""
    return pd.DataFrame({"left": [_common(x, y) for x, y in zip(la, lb)], "right": [_common(x, y) for x, y in zip(ra, rb)]}, dtype="int32")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, rep) of each document, long enough, whose text stands in several; rep is the least of their ids."""
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= least)
    t = t.select("id", F.md5("text").alias("print")).distinct()
    first = t.groupBy("print").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last")
    # A text of which there are very many copies is spread.
    spread = first.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = t.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return salted.join(spread, ["print", "_salt"]).groupBy("id").agg(F.min("rep").alias("rep"))


def _index(docs: DataFrame, copied: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The long texts (id, text), and their windows (id, token, place, lo, hi) whose token stands in several texts; of copies only the first."""
    long = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= least)
    long = long.join(copied.where("id != rep").select("id"), "id", "left_anti")
    index = store(long.mapInArrow(_windows(least, gram), f"id {dict(long.dtypes)['id']}, token long, place int, lo int, hi int"))
    several = index.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return long, index.join(several, "token")


def _by_text(long: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The texts with the ``columns`` of their rows as arrays."""
    hits = rows.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("hits"))
    return long.join(hits, "id").select("id", "text", *[F.col(f"hits.{c}").alias(c) for c in columns])


def meetings(docs: DataFrame, copied: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(a, b): documents a < b that share a span, of copies only the first; pairs may repeat."""
    long, hits = _index(docs, copied, id_col, text_col, least, gram)
    kind = dict(long.dtypes)["id"]
    places = cut(_by_text(long, hits, ["token", "place", "blocks"]).mapInArrow(_around(least, gram), f"id {kind}, token long, blocks int, left string, right string"))
    # Blocks i and j of a token meet in one key: no task gets more than two blocks.
    own = F.pmod(F.xxhash64("id", "left", "right"), F.col("blocks")).cast("int")
    spread = places.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    a, b = spread.alias("a"), spread.alias("b")
    once = (F.col("a.low") == F.col("a.high")) | (F.col("a.own") != F.col("b.own"))
    extent = F.pandas_udf(_extent, "left int, right int")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("token", "low", "high")] + [F.col("a.id") < F.col("b.id")]).where(once)
    ext = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), extent("a.left", "a.right", "b.left", "b.right").alias("e"))
    return ext.where(F.col("e.left") + F.col("e.right") >= least).select("a", "b")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id_a, doc_id_b): documents that share a verbatim run of ``least`` characters or more."""
    copied = cut(copies(docs, id_col, text_col, least))
    links = meetings(docs, copied, id_col, text_col, least).distinct()
    x = copied.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = copied.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    named = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    same = x.join(y.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    every = named.where("x != y").unionByName(same)
    return every.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _stretches(least: int):
    """The digest of the stretch of text that each window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, text, tokens, los, his in zip(*(col.to_pylist() for col in batch.columns)):
                out += [(c, t, lo, hi, _digest(text[lo : hi + least])) for t, lo, hi in zip(tokens, los, his)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["id", "token", "lo", "hi", "stretch"])

    return run


def _single_spans(least: int):
    """The digest of each span of each window, with the first and last document that are known to hold it, and the stretch for which these stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, text, los, his, firsts, lasts, of in zip(*(col.to_pylist() for col in batch.columns)):
                out += [(c, s, _digest(text[s : s + least]), a, b, x) for lo, hi, a, b, x in zip(los, his, firsts, lasts, of) for s in range(lo, hi + 1)]
            cols = list(zip(*out)) or [()] * 6
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int32(), pa.binary(), kind, kind, pa.binary()))], ["id", "place", "span", "first", "last", "of"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of a document as one."""
    for batch in batches:
        out: list[tuple] = []
        for c, begins, ends, firsts in zip(*(col.to_pylist() for col in batch.columns)):
            last = None
            for lo, hi, first in sorted(zip(begins, ends, firsts)):
                if last and lo <= last[2]:
                    last[2:] = [max(hi, last[2]), min(first, last[3])]
                else:
                    last = [c, lo, hi, first]
                    out.append(last)
        cols = list(zip(*out)) or [()] * 4
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int32(), pa.int32(), kind))], ["id", "begin", "end", "first"])


def shared_spans(docs: DataFrame, copied: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(id, begin, end, first): the longest stretches of each document all of whose spans of ``least``
    characters stand elsewhere too, and the least document that holds one of them; of copies only the first.
    """
    long, hits = _index(docs, copied, id_col, text_col, least, gram)
    kind = dict(long.dtypes)["id"]
    whole = store(_by_text(long, hits.where("hi >= lo"), ["token", "lo", "hi"]).mapInArrow(_stretches(least), f"id {kind}, token long, lo int, hi int, stretch binary"))
    known = store(whole.groupBy("token", "stretch").agg(F.min(F.struct("id", "lo", "hi")).alias("one"), F.max("id").alias("last")).select("token", "stretch", "one.*", "last"))
    # Whole stretches that several documents have.
    shared = known.where("id < last").select("token", "stretch", F.col("id").alias("first"))
    done = whole.join(shared, ["token", "stretch"]).select("id", F.col("lo").alias("begin"), (F.col("hi") + least).alias("end"), "first", "stretch")
    # The others span by span; of a shared stretch one document stands for all, where its token has other stretches.
    many = known.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    asked = whole.join(shared, ["token", "stretch"], "left_anti").select("id", "lo", "hi", F.col("id").alias("first"), F.col("id").alias("last"), F.lit(None).cast("binary").alias("of"))
    stands = known.where("id < last").join(many, "token", "left_semi").select("id", "lo", "hi", F.col("id").alias("first"), "last", F.col("stretch").alias("of"))
    texts = _by_text(long, asked.unionByName(stands), ["lo", "hi", "first", "last", "of"])
    single = store(texts.mapInArrow(_single_spans(least), f"id {kind}, place int, span binary, first {kind}, last {kind}, of binary"))
    several = store(single.groupBy("span").agg(F.min("first").alias("least_id"), F.max("last").alias("most_id")).where("least_id < most_id").select("span", "least_id"))
    more = single.where("of is null").join(several, "span").select("id", F.col("place").alias("begin"), (F.col("place") + least).alias("end"), F.col("least_id").alias("first"))
    # Documents with another stretch may hold spans of a shared one, too.
    lower = single.where("of is not null").join(several, "span").groupBy(F.col("of").alias("stretch")).agg(F.min("least_id").alias("lower"))
    done = done.join(lower, "stretch", "left").select("id", "begin", "end", F.least("first", "lower").alias("first"))
    # A document's spans are bounded by its length.
    spans = done.unionByName(more).groupBy("id").agg(F.collect_list(F.struct("begin", "end", "first")).alias("s"))
    return spans.select("id", "s.begin", "s.end", "s.first").mapInArrow(_merged, f"id {kind}, begin int, end int, first {kind}")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, from_char, to_char, first_doc_id): the passages of each document that stand elsewhere word for
    word, from the first character (0) to before the last, and the least document that has a part of them;
    the whole text of copies.
    """
    copied = cut(copies(docs, id_col, text_col, least))
    spans = shared_spans(docs, copied, id_col, text_col, least).join(copied, "id", "left_anti")
    sizes = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("end"), F.lit(0).alias("begin")).where(F.col("end") >= least).groupBy("id").agg(F.max("end").alias("end"), F.min("begin").alias("begin"))
    whole = copied.join(sizes, "id").select("id", "begin", "end", F.col("rep").alias("first"))
    every = spans.unionByName(whole)
    return every.select(F.col("id").alias("doc_id"), F.col("begin").alias("from_char"), F.col("end").alias("to_char"), F.col("first").alias("first_doc_id"))


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each document stands elsewhere.

    A null text has 0 characters; the share of an empty text is 0.0.
    """
    covered = passages(docs, id_col, text_col, least).groupBy("doc_id").agg(F.sum(F.col("to_char") - F.col("from_char")).alias("covered"))
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars")).join(covered, "doc_id", "left")
    out = out.select("doc_id", "n_chars", F.least(F.coalesce("covered", F.lit(0)), "n_chars").cast("long").alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
