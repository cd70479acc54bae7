"""Problem 3: records that differ only in formatting.

Each row's text becomes a multiset of (name, value) digests. The digests are
combined by sums, which do not depend on the order of fields, and rows are
grouped by these sums. A row joins a group only after its own multiset of
fields, each by its SHA-256, has been found equal to that of the group's
representative; one that differs (two multisets of one sum) stays with the rows
that have its letters and digits in the same order.

Defined results: a null text, and a text without letter or digit, belongs to no
record (``record_id`` is the row's own id, ``copies`` is 1). Repeated ids count
as separate rows for ``copies`` and once in ``pairs``. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pagequarry.operators.graph import components
from pagequarry.plans.lineage import cut, store

NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: A line of a record: a name, the first separator after it, a value.
NAME = r"[\p{L}\p{N}][^:=|\t→>]*?"
SEPARATOR = r"(?:->|=>|[:=|\t→]|[ \u00a0][-–—~][ \u00a0])"
FIELD = rf"^[^\p{{L}}\p{{N}}]*({NAME}){SEPARATOR}(.*)$"
#: Bits of each lane of the multiset sum. 2**19 fields of 44 bits fit a long.
LANE_BITS = 44
SALTS = 16


def squash(text: Column) -> Column:
    """Letters and digits of ``text`` in one case (sharp s and SS agree, as do the two forms of sigma)."""
    low = F.lower(F.regexp_replace(text, NOT_ALNUM, ""))
    return F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def _fields(text: Column) -> Column:
    """Array of (name, value) of a record, null where ``text`` is none."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    obj = F.transform(entries, lambda e: F.struct(squash(e["key"]).alias("n"), squash(F.coalesce(e["value"], F.lit(""))).alias("v")))
    whole = F.aggregate(obj, F.lit(0), lambda a, e: a + F.length(e["n"]) + F.length(e["v"]))
    complete = F.contains(text, F.lit("\\")) | (F.contains(text, F.lit("null"))) | (whole == F.length(squash(text)))
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    by_line = F.when(
        (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(FIELD)),
        F.transform(
            lines,
            lambda x: F.struct(squash(F.regexp_extract(x, FIELD, 1)).alias("n"), squash(F.regexp_extract(x, FIELD, 2)).alias("v")),
        ),
    )
    is_object = text.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(is_object, F.when(complete & (F.size(obj) > 0), obj)).otherwise(by_line)


def _lane(digests: Column, k: int) -> Column:
    """Sum of one slice of each digest: the same in any order of the fields."""
    shift, mask = 64 - LANE_BITS, F.lit((1 << LANE_BITS) - 1)
    return F.aggregate(digests, F.lit(0).cast("long"), lambda a, d: a + F.shiftrightunsigned(F.xxhash64(d, F.lit(k)), shift).bitwiseAND(mask))


def keyed(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, base, print, digests) of each row that takes part.

    ``base`` is the digest of all letters and digits in order; ``print`` the
    fingerprint of the multiset of fields, of the one nameless field ``base``
    where the text is no record.
    """
    t = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    t = t.select("id", F.sha2(squash(F.col("text")), 256).alias("base"), _fields(F.col("text")).alias("f"))
    digest = F.transform("f", lambda e: F.sha2(F.concat(e["n"], F.lit("\u0000"), e["v"]), 256))
    t = t.select("id", "base", F.col("f").isNotNull().alias("is_record"), F.coalesce(digest, F.array("base")).alias("digests"))
    d = F.col("digests")
    return t.withColumn("print", F.concat_ws(":", *[_lane(d, k).cast("string") for k in (1, 2, 3)], F.size(d).cast("string")))


def _counts_agree(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else Counter(x) == Counter(y) for x, y in zip(a, b)], dtype="object")


def _same(a: Column, b: Column) -> Column:
    """Equality of two arrays as multisets, without sorting them, in time linear in their size.

    As sets where no field repeats (of strings: sets of binary values are compared pair by pair); only rows with repeated fields have them counted (in Arrow batches).
    """
    repeats = F.size(F.array_distinct(a)) < F.size(a)
    sets = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    counted = F.pandas_udf(_counts_agree, BooleanType())(F.when(repeats & sets, a), F.when(repeats & sets, b))
    return sets & (~repeats | F.coalesce(counted, F.lit(False)))


def _with_leader(rows: DataFrame, key: str, leader: DataFrame, cols: list[str]) -> DataFrame:
    """Left join on ``key``; a hot key is spread over ``SALTS`` parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    spread = leader.select(key, *cols, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")


def _labels(edges: DataFrame) -> DataFrame:
    """(base, label) over bases whose rows disagree: one label for all that are linked by shared fingerprints."""
    named = components(edges.select(F.concat(F.lit("b"), "base").alias("key"), F.concat(F.lit("p"), "print").alias("other")))
    return named.where(F.col("key").startswith("b")).select(F.substring("key", 2, 64).alias("base"), "cluster").unionByName(
        named.select(F.substring("cluster", 2, 64).alias("base"), "cluster").where(F.col("cluster").startswith("b")).distinct()
    ).select("base", F.col("cluster").alias("label"))


def _base_labels(k: DataFrame) -> DataFrame:
    """The group of each ``base`` whose rows differ in ``print``; torn if its records do."""
    record = F.when(F.col("is_record"), F.col("print"))
    bases = k.groupBy("base").agg(F.min("print").alias("lo"), F.max("print").alias("hi"), F.min(record).alias("first"), F.max(record).alias("last"))
    return bases.where("lo != hi").select("base", F.coalesce("first", "lo").alias("label"), F.coalesce(F.col("first") != F.col("last"), F.lit(False)).alias("torn"))


def record_groups(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, group) of each row that takes part; rows of one record share ``group``."""
    k = cut(keyed(rows, id_col, text_col))
    # Fields in any order: the representative of a fingerprint is its least row.
    lead = k.groupBy("print").agg(F.min(F.struct("id", "digests")).alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").select("print", F.col("rep.digests").alias("rep"))
    k = _with_leader(k, "print", lead, ["rep"])
    own = F.concat(F.lit("="), "base")
    k = cut(k.select("id", "base", "is_record", F.when(F.col("rep").isNull() | _same(F.col("digests"), F.col("rep")), F.col("print")).otherwise(own).alias("print")))
    # The same letters and digits in the same order: one record, however it is laid out.
    bases = cut(_base_labels(k))
    if not bases.where("torn").isEmpty():
        reach = _labels(k.where("is_record").select("base", "print").distinct())
        k = cut(_with_leader(k, "base", reach, ["label"]).withColumn("print", F.when(F.col("is_record"), F.coalesce("label", "print")).otherwise(F.col("print"))).drop("label"))
        bases = _base_labels(k)
    k = _with_leader(k, "base", bases.select("base", "label"), ["label"])
    return store(k.select("id", F.coalesce("label", "print").alias("group")))


def pairs(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(first_row_id, row_id): each further row of a record, with the record's least id."""
    g = record_groups(rows, id_col, text_col)
    first = g.groupBy("group").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("group", "first")
    joined = _with_leader(g, "group", first, ["first"]).where(F.col("id") > F.col("first"))
    return joined.select(F.col("first").alias("first_row_id"), F.col("id").alias("row_id")).distinct()


def collapse(rows: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(record_id, copies): one row per record and per row that is no record."""
    g = record_groups(rows, id_col, text_col)
    counted = g.groupBy("group").agg(F.min("id").alias("record_id"), F.count(F.lit(1)).alias("copies")).select("record_id", "copies")
    lone = rows.select(F.col(id_col).alias("record_id"), F.col(text_col).cast("string").alias("t")).where(~F.coalesce(F.col("t").rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    return counted.unionByName(lone.select("record_id", F.lit(1).cast("long").alias("copies")))
