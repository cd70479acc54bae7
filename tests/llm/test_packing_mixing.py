"""Problems 6 and 7."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import mixing, packing, tokens

KINDS = "container_name string, capacity_tokens int"


def pack(spark, sizes, capacity):
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("container_name", F.lit("clash")).withColumn("size", F.lit(1))
    return packing.pack(df, spark.createDataFrame([("c", capacity)], KINDS)).collect()


def test_packing(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 30), 50])) for i in range(600)] + [(1000, 0), (1001, 250), (1002, 100), (1003, 200)]
    got = pack(spark, sizes, 100)
    load, whole, pieces = Counter(), Counter(), defaultdict(list)
    for r in got:
        load[r.container_no] += r.tokens
        whole[r.doc_id] += r.tokens
        pieces[r.doc_id].append(r.tokens)
    assert max(load.values()) <= 100 and whole == Counter(dict(sizes)) | Counter({1000: 0})
    assert {d: sorted(p) for d, p in pieces.items() if len(p) > 1} == {1001: [50, 100, 100], 1003: [100, 100]}
    assert len(load) <= -(-sum(n for _, n in sizes) // 100) + 3 and set(load) == set(range(len(load)))
    assert next(r for r in got if r.doc_id == 1000).container_no == 0


@pytest.mark.parametrize("seed", range(6))
def test_fullest_is_optimal(seed):
    rng = random.Random(seed)
    items = [rng.randint(2, 40) for _ in range(10)]
    counts = Counter(items)
    room = rng.randint(10, 120)
    got = packing.fullest(counts, sorted(counts, reverse=True), room)
    best = max((s for k in range(len(items) + 1) for c in combinations(items, k) if (s := sum(c)) <= room), default=0)
    assert sum(got) == best and not Counter(got) - counts


def test_packing_edges(spark):
    assert pack(spark, [], 10) == []
    assert len(pack(spark, [(1, 5), (1, 5), (1, 5)], 10)) == 3
    for bad in (0, None, 1 << 20):
        with pytest.raises(ValueError):
            pack(spark, [(1, 5)], bad)
    empty = packing.pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), spark.createDataFrame([], KINDS))
    assert empty.count() == 0


def test_packing_is_repeatable(spark):
    sizes = [(i, 1 + i * 7 % 90) for i in range(300)]
    assert sorted(pack(spark, sizes, 100)) == sorted(pack(spark, sizes[::-1], 100))


TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def mix(spark, docs, targets, tilt=mixing.TILT):
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    plan = mixing.plan_mixes(sizes, spark.createDataFrame(targets, TARGETS), tilt)
    drawn = mixing.draw(sizes, plan)
    return drawn.collect(), {r.source: r for r in mixing.shares(drawn, plan).collect()}


def make(n=900):
    rng = random.Random(6)
    return [(i, rng.choice("aaaab") if i % 20 else "c", rng.randint(1, 60)) for i in range(n)]


def test_mixing(spark):
    docs = make()
    drawn, shares = mix(spark, docs, [("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 3), ("m", "none", 0.0, 2)])
    total = sum(r.tokens for r in drawn)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[s].share_reached - share) * total <= 120
    repeats = Counter((r.source, r.doc_id) for r in drawn)
    assert all(n <= {"a": 1, "b": 2, "c": 3}[s] for (s, _), n in repeats.items())
    sizes = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    assert abs(total - min(sizes["a"] / 0.5, sizes["b"] * 2 / 0.3, sizes["c"] * 3 / 0.2)) < 200
    assert [r.position for r in drawn] == sorted(r.position for r in drawn) and all(0 <= r.position < 1 for r in drawn)
    # Repeated sources come later: their weight grows along the course.
    half = lambda s: sum(r.tokens for r in drawn if r.source == s and r.position < 0.5) / sum(r.tokens for r in drawn if r.source == s)
    assert half("a") > 0.52 and half("c") < 0.48


def test_passes_have_orders_of_their_own(spark):
    drawn, _ = mix(spark, [(i, "a" if i < 400 else "b", 10) for i in range(500)], [("m", "a", 0.5, 1), ("m", "b", 0.5, 4)])
    order = {c: [r.doc_id for r in drawn if r.source == "b" and r.copy_no == c] for c in range(1, 5)}
    assert all(sorted(x) == list(range(400, 500)) for x in order.values()) and len({tuple(x) for x in order.values()}) == 4
    last = [max(r.position for r in drawn if r.source == "b" and r.copy_no == c) for c in range(1, 5)]
    first = [min(r.position for r in drawn if r.source == "b" and r.copy_no == c) for c in range(1, 5)]
    assert all(a < b for a, b in zip(last, first[1:]))  # one pass after the other


def test_missing_source(spark):
    _, shares = mix(spark, make(), [("m", "a", 0.4, 1), ("m", "b", 0.4, 1), ("m", "gone", 0.2, 5)])
    assert shares["gone"].tokens == 0 and abs(shares["a"].share_reached - 0.5) < 0.02


def test_inverse_of_the_schedule(spark):
    drawn, _ = mix(spark, [(i, "a" if i % 2 else "b", 10) for i in range(400)], [("m", "a", 0.5, 1), ("m", "b", 0.5, 2)])
    for s, d in (("a", -1.0), ("b", 1.0)):
        p = [r.position for r in drawn if r.source == s]
        for k, t in enumerate(p):
            y = t + mixing.TILT * d * (t * t - t)
            assert abs(y * len(p) - (k + 0.5)) < 1e-6 * len(p) + 1e-9


def test_mixing_edges(spark):
    drawn, shares = mix(spark, [], [("m", "a", 1.0, 1)])
    assert drawn == [] and shares["a"].share_reached == 0.0
    drawn, _ = mix(spark, [(1, "a", 0), (2, None, 5), (3, "a", 4), (3, "a", 4)], [("m", "a", 1.0, 1), ("m", "b", None, None)])
    assert len(drawn) == 2
    with pytest.raises(ValueError):
        mix(spark, [(1, "a", 1)], [("m", "a", 0.5, 1), ("m", "a", 0.5, 1)])


def test_token_counts(spark):
    texts = ["", None, "Hello world", "日本語 text", "a" * 5000, "x\n\n\ty" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    enc = tokens.encoding(tokens.TOKENIZER)
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df, {"doc_id": "long"}).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]
