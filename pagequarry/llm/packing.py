"""Problem 6: items into as few containers of a fixed capacity as possible.

Minimum bin slack over the histogram of sizes: for the largest size left, subset
sums over the sizes left (one bit per sum) find the fullest feasible bin. The
same combination is taken as often as the counts allow, so the work depends on
the number of sizes, which the capacity bounds, and not on the number of items.
Items then look up the bin of their rank among those of their size.

Defined results: a text larger than the capacity is divided into full pieces and
a rest; no other is divided. A text without tokens (null, empty) goes into
container 0. Rows that repeat an id are items of their own. A container whose
capacity is null or below 1 raises ``ValueError``. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.tokens import TOKENIZER, token_counts
from pagequarry.plans.lineage import store

#: Bounds of what the driver holds: container kinds, and sizes of each (one count per size).
MAX_KINDS, MAX_CAPACITY = 64, 1 << 17
#: Items of one size are ranked in so many parts.
PARTS = 256


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[int]:
    """Sizes, by ``order``, whose sum is the largest up to ``room``."""
    if counts.get(room, 0):
        return [room]
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for size in order:
        left = min(counts[size], room // size) if size <= room else 0
        many = 1
        while left > 0:  # multiplicities in powers of two
            k = min(many, left)
            after = (reach | reach << size * k) & mask
            if after != reach:
                steps.append((size, k, reach))
                reach = after
                if reach >> room & 1:
                    left = 0
                    break
            left -= k
            many *= 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, []
    for size, k, before in reversed(steps):
        if not before >> target & 1:
            chosen += [size] * k
            target -= size * k
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (how many items of each size, how many such bins)."""
    counts = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        top = order[0]
        counts[top] -= 1
        bin_ = {top: 1}
        for s in fullest(counts, order, capacity - top):
            bin_[s] = bin_.get(s, 0) + 1
        counts[top] += 1
        times = min(counts[s] // k for s, k in bin_.items())
        for s, k in bin_.items():
            counts[s] -= k * times
        if any(counts[s] == 0 for s in bin_):
            order = [s for s in order if counts[s]]
        out.append((bin_, times))
    return out


def _lookup(bins: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For (size, rank): the starts of the stretches of ranks, the items per bin, the first bin."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bin_, times in bins:
        for s, k in bin_.items():
            start = used.get(s, 0)
            rows.append((s << 44 | start, start, k, base))
            used[s] = start + k * times
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def _assign(tables: list[tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, size, rank = (batch.column(i).to_numpy() for i in (0, 3, 4))
            bin_ = np.zeros(len(kind), np.int64)
            for k, (keys, start, per, base) in enumerate(tables):
                at = np.flatnonzero((kind == k) & (size > 0))
                if len(at):
                    i = np.searchsorted(keys, size[at] << 44 | rank[at], "right") - 1
                    bin_[at] = base[i] + (rank[at] - start[i]) // per[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bin_)], ["kind", "doc_id", "piece", "tokens", "container_no"])

    return run


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, doc_id, piece, tokens, container_no) of each of ``sizes`` (doc_id, tokens) for each kind of container."""
    kinds = sorted((r[0], r[1]) for r in containers.select("container_name", "capacity_tokens").limit(MAX_KINDS + 1).collect())
    if len(kinds) > MAX_KINDS or any(c is None or not 1 <= c <= MAX_CAPACITY for _, c in kinds):
        raise ValueError(f"at most {MAX_KINDS} containers, of 1 to {MAX_CAPACITY} tokens")
    spark = sizes.sparkSession
    kind_rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).cast("long").alias("capacity")) for k, (_, c) in enumerate(kinds)])
    if not kinds:
        kind_rows = F.array().cast("array<struct<kind:int,capacity:bigint>>")
    each = sizes.select("doc_id", "tokens", F.explode(kind_rows).alias("c")).select("doc_id", "tokens", "c.*")
    full = F.expr("tokens div capacity")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0)).cast("long")
    cut_up = each.select("kind", "doc_id", "tokens", "capacity", full.alias("full"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    size = F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("tokens") % F.col("capacity"))
    items = cut_up.select("kind", "doc_id", "piece", size.alias("size"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).alias("part"))
    counted = store(items.groupBy("kind", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    # One row per size and kind: bounded by the capacities.
    histograms: list[dict[int, int]] = [{} for _ in kinds]
    for r in counted.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect():
        histograms[r["kind"]][r["size"]] = r["n"]
    tables = [_lookup(patterns(h, c)) for h, (_, c) in zip(histograms, kinds)]
    before = Window.partitionBy("kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("kind", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("kind", "size", "part").orderBy("doc_id", "piece"))
    ranked = items.withColumn("_n", within).join(offsets, ["kind", "size", "part"])
    ranked = ranked.select("kind", "doc_id", "piece", "size", (F.col("offset") + F.col("_n") - 1).alias("rank"))
    placed = ranked.mapInArrow(_assign(tables), "kind int, doc_id long, piece long, tokens long, container_no long")
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(kinds)], "kind int, container_name string")
    return placed.join(F.broadcast(names), "kind").select("container_name", "doc_id", "piece", "tokens", "container_no")


def pack_documents(docs: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack`` of the texts of ``docs``, sized in tokens."""
    return pack(store(token_counts(docs, {"doc_id": "long"}, tokenizer=tokenizer)), containers)


def usage(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, containers, least, tokens, unused): what was used, and the least number that any packing needs."""
    used = packed.groupBy("container_name").agg(F.countDistinct("container_no").alias("containers"), F.sum("tokens").alias("tokens"))
    cap = containers.select("container_name", F.col("capacity_tokens").cast("long").alias("c"))
    return used.join(cap, "container_name").select(
        "container_name", "containers", F.ceil(F.col("tokens") / F.col("c")).alias("least"), "tokens", (F.col("containers") * F.col("c") - F.col("tokens")).alias("unused")
    )
