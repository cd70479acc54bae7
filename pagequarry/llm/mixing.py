"""Problem 7: sources mixed to target weights along a curriculum.

Each source has a weight schedule over the course of training whose integral is
its target share. The documents of a source, in an order given by the hash of
their ids and of the pass, lie one behind the other along its tokens, in as many
passes as needed; the place of a document on this line, inverted through the integral of the schedule,
is its training position. Documents are range-sorted by position.

The mix is as large as its scarcest source allows: a source gives at most
``max_repeats`` passes, and a source without documents gives its share to the
others in proportion (shares really reached are reported).

Defined results: documents without tokens, and of a null source, are not drawn.
A mix of no source with documents draws nothing. Rows that repeat an id are
documents of their own. Null or non-positive shares and repeats count as 0.
Sources named twice in a mix raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.tokens import TOKENIZER, token_counts
from pagequarry.plans.lineage import store

#: Bound of the rows of ``mix_targets``, which the driver holds.
MAX_TARGETS = 10_000
#: The line of a source is summed up in so many parts.
PARTS = 4096
#: How far weights move from the start of training to its end: repeated sources from 1 - TILT to 1 + TILT times their share.
TILT = 0.5

PLAN = "mix_name string, source string, target_share double, share double, demand double, total double, repeats int, tilt double"


def schedule(targets: list[tuple], totals: dict[str, int], tilt: float = TILT) -> list[tuple]:
    """One row of ``PLAN`` per target: the share among sources that have documents, the tokens
    demanded, and the change of the weight, which sums to 0 over a mix at any time.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        rows = [(s, share or 0.0, repeats or 0) for m, s, share, repeats in targets if m == mix]
        if len({s for s, _, _ in rows}) < len(rows):
            raise ValueError(f"a source stands twice in {mix}")
        live = {s: (share, repeats) for s, share, repeats in rows if share > 0 and repeats > 0 and totals.get(s, 0) > 0}
        whole = sum(share for share, _ in live.values())
        size = min((totals[s] * repeats * whole / share for s, (share, repeats) in live.items()), default=0.0)
        late = sum(share for share, repeats in live.values() if repeats > 1) / whole if whole else 0.0
        for s, share, repeats in rows:
            own = share / whole if s in live else 0.0
            change = 0.0
            if s in live and 0 < late < 1:
                change = tilt * min(1.0, (1 - late) / late) * (1.0 if repeats > 1 else -late / (1 - late))
            out.append((mix, s, float(share), own, own * size, float(totals.get(s, 0)), int(repeats), change))
    return out


def plan_mixes(sizes: DataFrame, targets: DataFrame, tilt: float = TILT) -> DataFrame:
    """The rows of ``schedule`` for ``sizes`` (doc_id, source, tokens) as a frame."""
    rows = [tuple(r) for r in targets.select("mix_name", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    spark = sizes.sparkSession
    named = spark.createDataFrame(sorted({(r[1],) for r in rows if r[1] is not None}), "source string")
    # Only sources that a mix names: bounded by MAX_TARGETS.
    totals = {r["source"]: r["t"] for r in sizes.join(F.broadcast(named), "source").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    return spark.createDataFrame(schedule(rows, totals, tilt), PLAN)


def draw(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, position, source, doc_id, copy_no, tokens): the documents of each mix, sorted by position in [0, 1)."""
    passes = F.least(F.ceil(F.col("demand") / F.col("total")), F.col("repeats")).cast("int")
    mixes = plan.where("demand > 0").withColumn("passes", passes)  # MAX_TARGETS rows at most
    most = mixes.groupBy("source").agg(F.max("passes").alias("most"))
    docs = sizes.where("tokens > 0 and source is not null").join(F.broadcast(most), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("most")))).drop("most")
    # Each pass has an order of its own.
    docs = docs.withColumn("at", F.xxhash64("doc_id", "source", "copy_no"))
    docs = docs.withColumn("part", F.shiftrightunsigned("at", 64 - 12))
    sums = docs.groupBy("source", "copy_no", "part").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source", "copy_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "copy_no", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "copy_no", "part").orderBy("at", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = docs.withColumn("_end", F.sum("tokens").over(within)).join(offsets, ["source", "copy_no", "part"])
    lined = lined.select("source", "doc_id", "tokens", "copy_no", (F.col("offset") + F.col("_end") - F.col("tokens") / 2.0).alias("middle"))
    copies = lined.join(F.broadcast(mixes), "source").where("copy_no <= passes")
    y = ((F.col("copy_no") - 1) * F.col("total") + F.col("middle")) / F.col("demand")
    drawn = copies.withColumn("y", y).where("y < 1")
    a = F.col("tilt")
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * F.col("y"))
    position = F.when(F.abs(a) < 1e-9, F.col("y")).otherwise((root - (1 - a)) / (2 * a))
    out = drawn.select("mix_name", position.alias("position"), "source", "doc_id", "copy_no", "tokens")
    return out.orderBy("mix_name", "position", "source", "doc_id", "copy_no")


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, documents, most_copies, tokens, share_reached) of each target."""
    got = drawn.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("documents"), F.max("copy_no").alias("most_copies"), F.sum("tokens").alias("tokens"))
    whole = Window.partitionBy("mix_name")
    joined = plan.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left")
    joined = joined.fillna(0, ["documents", "most_copies", "tokens"])
    total = F.sum("tokens").over(whole)
    return joined.withColumn("share_reached", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents, stored."""
    return store(token_counts(docs, {"doc_id": "long", "source": "string"}, tokenizer=tokenizer))
