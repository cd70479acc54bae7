"""Problem 8."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import spans

SCHEMA = "doc_id long, text string"


def shared(a, b, least):
    grams = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in grams for i in range(len(b) - least + 1))


def brute(docs, least):
    d = [(i, t) for i, t in docs if t and len(t) >= least]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(d) for j, b in d[:k] if i != j and shared(a, b, least)}


def make():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60)[:n] for n in (199, 200, 201, 260, 330)] + ["-" * 250, "ab" * 150, "日本語。" * 80, ("line of a table\n" * 30)]
    docs = [(k, text(rng.randint(0, 40)) + "".join(rng.sample(passages, rng.choice([0, 1, 1, 2]))) + text(rng.randint(0, 40))) for k in range(70)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "x" * 150), (105, "-" * 199), (106, "-" * 5000), (107, "ab" * 3000), (108, "ba" * 120), (109, "\U0001f600" * 230), (110, "\U0001f600" * 260)]
    return docs


def test_found_against_brute_force(spark):
    docs = make()
    df = spark.createDataFrame(docs, SCHEMA).withColumn("token", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r.doc_id_a, r.doc_id_b) for r in spans.found(df).collect()}
    assert got == brute(docs, 200) and len(got) > 30


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 4)
    docs = make()
    got = {(r.doc_id_a, r.doc_id_b) for r in spans.found(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute(docs, 200)


def test_shares(spark):
    rng = random.Random(2)
    p = "".join(rng.choice("abcdefghij ") for _ in range(400))
    fill = lambda n: "".join(rng.choice("KLMNOPQ") for _ in range(n))
    docs = [(1, fill(100) + p + fill(50)), (2, p[:300] + fill(100)), (3, fill(500)), (4, fill(0)), (5, None), (6, p[100:]), (6, p[100:]), (7, "same " * 60), (8, "same " * 60)]
    got = {r.doc_id: r for r in spans.shares(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert (got[1].shared_chars, got[1].n_chars) == (400, 550) and got[2].shared_chars == 300 and got[3].share == got[4].share == got[5].share == 0.0
    assert got[6].share == got[7].share == got[8].share == 1.0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.found(df).count() == 0 and spans.shares(df).count() == 0 and spans.passages(df).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=120), st.integers(1, 12))
def test_compact_windows(values, width):
    h = np.array(values, np.uint64)
    windows = spans.compact_windows(h, width)
    got = {x for a, b, _, _ in windows for x in (a, b)}
    begins = []
    for a, b, lo, hi in windows:
        begins += range(lo, hi + 1)
        assert len(set(values[a : b + 1])) == 1
        for s in range(lo, hi + 1):
            assert min(values[s : s + width]) == values[a]
    assert sorted(begins) == list(range(max(0, len(values) - width + 1)))  # each run in one window
    for i in range(len(values) - width + 1):
        window = values[i : i + width]
        at = i + window.index(min(window))
        first = at
        while first > 0 and values[first - 1] == values[at]:
            first -= 1
        last = at
        while last + 1 < len(values) and values[last + 1] == values[at]:
            last += 1
        assert got & {at, first, last}


def brute_passages(docs, least):
    """Of each document, the merged spans that stand in another one, and the least document that holds one."""
    holders = {}
    for i, t in docs:
        for s in range(len(t or "") - least + 1):
            holders.setdefault(t[s : s + least], set()).add(i)
    out = set()
    for i, t in docs:
        runs = []
        for s in range(len(t or "") - least + 1):
            h = holders[t[s : s + least]]
            if len(h) > 1:
                if runs and s <= runs[-1][1]:
                    runs[-1][1:] = [s + least, min(runs[-1][2], min(h))]
                else:
                    runs.append([s, s + least, min(h)])
        out |= {(i, *r) for r in runs}
    return out


def passages(spark, docs):
    return {tuple(r) for r in spans.passages(spark.createDataFrame(docs, SCHEMA)).collect()}


def test_passages_against_brute_force(spark):
    docs = make()
    got, want = passages(spark, docs), brute_passages(docs, 200)
    assert {g[:3] for g in got} == {w[:3] for w in want} and len(got) > 40
    copied = {3, 100, 101}  # of copies the first stands for all
    assert {g for g in got if g[0] not in copied} == {w for w in want if w[0] not in copied}


@pytest.mark.parametrize("size", [200, 230, 700])
def test_one_passage_in_many_documents(spark, size):
    """Its length or more, in documents that differ all around it: rows grow with the documents, not with their pairs."""
    rng = random.Random(size)
    chars = "abcdefghijklmnopqrstuvwxyz "
    p = "".join(rng.choice(chars) for _ in range(size))
    docs = []
    for k in range(400):
        before, after = ("".join(rng.choice(chars) for _ in range(rng.randint(150, 300))) for _ in "ab")
        docs.append((k, before + "<" + p + ">" + after))
    got = passages(spark, docs)
    assert got == brute_passages(docs, 200) and len(got) == 400 and all(b - a >= size + 2 for _, a, b, _ in got)


def test_runs_within_one_document(spark):
    docs = [(1, "ab" * 3000), (2, "x" + "ab" * 3000), (3, "q" * 100 + "ba" * 90), (4, "only here " * 200)]
    assert passages(spark, docs) == brute_passages(docs, 200)
    assert {tuple(r) for r in spans.found(spark.createDataFrame(docs, SCHEMA)).collect()} == {(1, 2)}


@pytest.mark.parametrize("n", [0, 5, 99, 100, 101, 70_000])
def test_gram_hashes(n):
    codes = np.random.default_rng(1).integers(0, 50, n).astype(np.uint32)
    h = spans.gram_hashes(np.concatenate([codes, codes]), 100)
    assert len(h) == max(0, 2 * n - 99)
    if n >= 100:
        assert (h[: n - 99] == h[n : n + n - 99]).all()
