"""Exact, normalized and near duplicates within a scope, in the order of rows.

The first row of each normalized text stands for it. Of these, rows of 80 words
or more get a 64-bit SimHash; a row is a near-duplicate if an earlier
representative lies within 3 bits and 80 % of its words, else it becomes a
representative itself. What is decided row by row in a single pass is here a
least maximal independent set in row order, found in a few rounds over the graph
of close pairs; chains that are left are decided component by component.

Close pairs are found complete: 64 bits in 5 blocks differ in at most 3 blocks,
so two blocks agree, and rows meet under each of the 10 pairs of blocks (25 bits
or more, so that buckets stay small at any size). Rows with the same bits and
words count as one node, so very many copies of a template make no pairs.
Buckets are joined in parts of bounded size.

Defined results: null and empty texts are ``unique`` and stand for nothing. In
``mark_duplicates`` rows with the same scope and place are ordered by their id.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.hashing import fingerprints
from pagequarry.operators.graph import components
from pagequarry.plans.lineage import cut, store

# When rows are compared, and when they count as close.
MIN_WORDS, MAX_BOILERPLATE = 80, 0.8
MAX_DISTANCE, MIN_RATIO = 3, 0.8
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SALTS = 16
BUCKET = 512
#: Rounds before chains are decided as a whole, and the most links of a component that one task decides.
ROUNDS, CHAIN = 4, 200_000


def fingerprinted(docs: DataFrame, digest: str = "blake2b") -> DataFrame:
    """(scope, idx, ref, words, raw, norm, bits) of ``docs`` with a text: scope, idx, ref, text, words, boilerplate."""
    eligible = (F.col("words") >= MIN_WORDS) & (F.col("boilerplate") <= MAX_BOILERPLATE)
    some = docs.where(F.length("text") > 0)
    some = some.select("scope", "idx", "ref", "words", F.sha2("text", 256).alias("raw"), fingerprints(F.col("text"), eligible, digest).alias("f"))
    return some.select("scope", "idx", "ref", "words", "raw", "f.norm", "f.bits")


def exact_classes(prints: DataFrame) -> DataFrame:
    """Adds the first row of each normalized text: first_idx, first_ref, first_raw."""
    first = prints.groupBy("scope", "norm").agg(F.min(F.struct("idx", "ref", "raw")).alias("first"))
    spread = first.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = prints.withColumn("_salt", F.pmod(F.xxhash64("ref"), F.lit(SALTS)))
    joined = salted.join(spread, ["scope", "norm", "_salt"]).drop("_salt")
    return joined.select(*prints.columns, F.col("first.idx").alias("first_idx"), F.col("first.ref").alias("first_ref"), F.col("first.raw").alias("first_raw"))


def _keys(bits: Column) -> Column:
    """Keys of the pairs of blocks."""
    part = [F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    return F.array(*[F.struct(F.lit(k).alias("pair"), (part[i] * (1 << 13) + part[j]).alias("value")) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(scope, lo, hi, d): nodes (scope, idx, bits, words) within the distance and the ratio, lo < hi."""
    keyed = nodes.select("scope", "idx", "bits", "words", F.explode(_keys(F.col("bits"))).alias("key")).select("scope", "idx", "bits", "words", "key.*")
    sizes = keyed.groupBy("scope", "pair", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("scope", "pair", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    member = keyed.join(sizes, ["scope", "pair", "value"])
    member = member.withColumn("own", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    a, b = member.alias("a"), member.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("scope", "pair", "value", "low", "high")]
    d = distance(F.col("a.bits"), F.col("b.bits"))
    ratio = F.least("a.words", "b.words") / F.greatest("a.words", "b.words")
    met = a.join(b, [*same, F.col("a.idx") < F.col("b.idx")]).where((d <= MAX_DISTANCE) & (ratio >= MIN_RATIO))
    return met.select(F.col("a.scope").alias("scope"), F.col("a.idx").alias("lo"), F.col("b.idx").alias("hi"), d.alias("d")).distinct()


def _round(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Decides each open node of ``state`` whose earlier neighbours are decided, or one of them is a representative."""
    earlier = edges.join(state.select("scope", F.col("idx").alias("lo"), "rep"), ["scope", "lo"])
    seen = earlier.groupBy("scope", F.col("hi").alias("idx")).agg(F.max(F.coalesce("rep", F.lit(False))).alias("taken"), F.max(F.col("rep").isNull()).alias("open"))
    joined = state.join(seen, ["scope", "idx"], "left")
    free = ~F.coalesce("taken", F.lit(False)) & ~F.coalesce("open", F.lit(False))
    new = F.when(F.col("rep").isNotNull(), F.col("rep")).when(F.col("taken"), False).when(free, True)
    return cut(joined.select("scope", "idx", new.alias("rep")))


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the links (lo, hi) of one component, numbered in order: which nodes have no earlier representative near."""
    taken, reps = set(), set()
    near: dict[int, list[int]] = {}
    for lo, hi in zip(frame["lo"], frame["hi"]):
        near.setdefault(lo, []).append(hi)
    for n in range(1, int(max(frame["hi"])) + 1):
        if n not in taken:
            reps.add(n)
            taken.update(near.get(n, ()))
    nodes = sorted(set(frame["lo"]) | set(frame["hi"]))
    return pd.DataFrame({"cluster": frame["cluster"].iloc[0], "n": nodes, "rep": [n in reps for n in nodes]})


def _chains(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Decides the open nodes of all components of at most ``CHAIN`` links, each in one go.

    No open node has a representative near that is decided, so only links between open nodes count.
    """
    left = state.where("rep is null").select("scope", "idx")
    links = edges.select("scope", "lo", "hi").join(left.withColumnRenamed("idx", "lo"), ["scope", "lo"]).join(left.withColumnRenamed("idx", "hi"), ["scope", "hi"])
    key = lambda c: F.struct("scope", F.col(c).alias("idx"))
    links = store(links.select(key("lo").alias("key"), key("hi").alias("other")))
    ends = components(links)
    named = ends.unionByName(ends.select(F.col("cluster").alias("key"), "cluster").distinct())
    of = links.join(named, "key")
    name = F.to_json("cluster")
    small = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") <= CHAIN).select("cluster")
    nodes = store(named.join(small, "cluster").withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("key"))))
    numbered = of.join(nodes.select("key", F.col("n").alias("lo")), "key").join(nodes.select(F.col("key").alias("other"), F.col("n").alias("hi")), "other").select(name.alias("cluster"), "lo", "hi")
    found = numbered.groupBy("cluster").applyInPandas(_in_order, "cluster string, n int, rep boolean")
    by_node = nodes.select("key", "n", name.alias("cluster")).join(found, ["cluster", "n"]).select("key.scope", "key.idx", F.col("rep").alias("new"))
    return cut(state.join(by_node, ["scope", "idx"], "left").select("scope", "idx", F.coalesce("rep", "new").alias("rep")))


def representatives(edges: DataFrame) -> DataFrame:
    """(scope, idx, rep) of the nodes on ``edges``: whether each, in order, has no earlier representative close to it.

    Most nodes are decided in a few rounds. What is left are chains, of which each round decides a link:
    they are decided component by component; only components too large for that go on in rounds.
    """
    nodes = edges.select("scope", F.col("lo").alias("idx")).unionByName(edges.select("scope", F.col("hi").alias("idx"))).distinct()
    state = cut(nodes.withColumn("rep", F.lit(None).cast("boolean")))
    rounds = 0
    while not state.where("rep is null").isEmpty():
        if rounds == ROUNDS:
            state = _chains(edges, state)
        else:
            state = _round(edges, state)
        rounds += 1
    return state


def near_targets(firsts: DataFrame) -> DataFrame:
    """(scope, idx, target, d) of the near-duplicates among ``firsts`` (scope, idx, ref, words, bits)."""
    groups = firsts.groupBy("scope", "bits", "words").agg(F.min("idx").alias("node"), F.count(F.lit(1)).alias("n"))
    nodes = groups.select("scope", F.col("node").alias("idx"), "bits", "words")
    edges = cut(close_pairs(nodes))
    state = representatives(edges)
    node_reps = groups.join(state.withColumnRenamed("idx", "node"), ["scope", "node"], "left").select("scope", "bits", "words", "node", F.coalesce("rep", F.lit(True)).alias("rep"), "n")
    # Each node with the representatives close to it, itself included; only nodes where someone is near.
    both = edges.select("scope", F.col("lo").alias("node"), F.col("hi").alias("by"), "d").unionByName(edges.select("scope", F.col("hi").alias("node"), F.col("lo").alias("by"), "d"))
    is_rep = node_reps.where("rep").select("scope", F.col("node").alias("by"))
    own = node_reps.where("rep and n > 1").select("scope", "node", F.col("node").alias("by"), F.lit(0).alias("d"))
    reach = both.join(is_rep, ["scope", "by"]).unionByName(own, allowMissingColumns=True)
    named = reach.join(firsts.select("scope", F.col("idx").alias("by"), F.col("ref").alias("target")), ["scope", "by"])
    close = named.groupBy("scope", "node").agg(F.collect_list(F.struct("d", "by", "target")).alias("reps"))
    members = firsts.join(node_reps.select("scope", "bits", "words", "node", "rep"), ["scope", "bits", "words"])
    members = members.where((F.col("idx") != F.col("node")) | ~F.col("rep")).join(close, ["scope", "node"])
    best = F.array_min(F.filter("reps", lambda r: r["by"] < F.col("idx")))
    return members.select("scope", "idx", best.alias("best")).where("best is not null").select("scope", "idx", "best.target", "best.d")


def find_duplicates(docs: DataFrame, near: bool = True, digest: str = "blake2b") -> DataFrame:
    """(ref, duplicate_status, duplicate_of, similarity, duplicate_match) of ``docs`` with a text.

    ``docs`` has scope, idx, ref, text, words, boilerplate; ``digest`` gives the bits of a shingle.
    """
    rows = store(exact_classes(store(fingerprinted(docs, digest))))  # texts are read and hashed once
    if near:
        firsts = rows.where("idx = first_idx and ref = first_ref and bits is not null").select("scope", "idx", "ref", "words", "bits")
        targets = cut(near_targets(firsts)).select("scope", F.col("idx").alias("first_idx"), "target", "d")
        rows = rows.join(targets, ["scope", "first_idx"], "left")
    else:
        rows = rows.withColumns({"target": F.lit(None).cast("string"), "d": F.lit(None).cast("int")})
    follower = (F.col("idx") != F.col("first_idx")) | (F.col("ref") != F.col("first_ref"))
    nearby = F.col("target").isNotNull()
    return rows.select(
        "ref",
        F.when(follower, "exact_duplicate").when(nearby, "near_duplicate").otherwise("unique").alias("duplicate_status"),
        F.when(follower, F.coalesce("target", "first_ref")).when(nearby, F.col("target")).alias("duplicate_of"),
        F.when(follower, 1.0).when(nearby, F.round(1 - F.col("d") / 64, 6)).alias("similarity"),
        F.when(follower, F.when(F.col("raw") == F.col("first_raw"), "exact").otherwise("normalized_exact")).when(nearby, "simhash_64").alias("duplicate_match"),
    )


def mark_duplicates(pages: DataFrame, enabled: bool = True, scope: str | None = "dataset_id", order: str = "row_index") -> DataFrame:
    """Adds the duplicate columns to ``pages`` (source_id, body_text, word_count, boilerplate_ratio)."""
    nothing = {"duplicate_of": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "duplicate_match": F.lit(None).cast("string")}
    if not enabled:
        return pages.withColumns({"duplicate_status": F.lit("not_checked"), **nothing})
    docs = pages.select(
        (F.col(scope) if scope else F.lit("")).alias("scope"), F.struct(F.col(order).cast("long").alias("at"), F.col("source_id").alias("ref")).alias("idx"), F.col("source_id").alias("ref"), F.col("body_text").alias("text"),
        F.col("word_count").alias("words"), F.col("boilerplate_ratio").alias("boilerplate"),
    )
    found = find_duplicates(docs).dropDuplicates(["ref"]).withColumnRenamed("ref", "source_id")
    return pages.join(found, "source_id", "left").withColumn("duplicate_status", F.coalesce("duplicate_status", F.lit("unique")))
