"""Problem 1."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import lines

ROWS = "row_id long, dataset_id string, row_index long, text string"
RESULTS = "source_id string, url string"


def brute(rows, results, least=6):
    site = {s: re.sub(r"^www\.", "", u.split("/")[2].lower()) for s, u in results if u}
    norm = lambda x: re.sub(r"\s+", " ", re.sub("[0-9]+", "0", x.lower())).strip()
    seen = defaultdict(set)
    each = []
    for rid, d, i, t in rows:
        s = site.get(f"dataset:{d}:{i}")
        for no, line in enumerate((t or "").split("\n") if s and t is not None else [], 1):
            if any(c.isalpha() for c in line):
                seen[s, norm(line)].add(rid)
                each.append((rid, no, (s, norm(line))))
    return {(r, n) for r, n, k in each if len(seen[k]) >= least}


def make(n=60):
    rng = random.Random(3)
    fixed = ["© 2020 Acme. All rights reserved.", "Follow Acme for more", "By Ann Lee, desk 4", "READ\u00a0 more\t", "日本の法的通知"]
    rows = []
    for k in range(n):
        own = [f"Line {rng.randint(0, 9)} of its own about {rng.choice('abcdefgh')} and {k}", "", "12345"]
        extra = [rng.choice([f, f.upper(), f.replace("2020", "1999"), "  " + f + "\r"]) for f in fixed if rng.random() < 0.5]
        body = own + extra
        rng.shuffle(body)
        rows.append((k, "d", k, "\n".join(body)))
    results = [(f"dataset:d:{k}", f"https://{'www.' if k % 5 == 0 else ''}site{k % 3}.example/p") for k in range(n)]
    return rows, results


def test_against_brute_force(spark):
    rows, results = make()
    rows += [(900, "d", 900, None), (901, "d", 901, ""), (902, "e", 1, rows[0][3])]
    results += [("dataset:d:900", "https://site0.example/"), ("dataset:d:901", "https://site0.example/"), ("dataset:e:1", ""), (results[0][0], results[0][1])]
    a = spark.createDataFrame(rows, ROWS).withColumn("site", F.lit("x")).withColumn("key", F.lit(1))
    b = spark.createDataFrame(results, RESULTS).withColumn("text", F.lit("x"))
    got = {(r.row_id, r.line_no) for r in lines.found(a, b).collect()}
    assert got == brute(rows, results) and len(got) > 60


def test_line_twice_in_a_row_counts_once(spark):
    rows = [(k, "d", k, "same line here\nsame line here") for k in range(3)]
    results = [(f"dataset:d:{k}", "https://s.example/") for k in range(3)]
    assert lines.found(spark.createDataFrame(rows, ROWS), spark.createDataFrame(results, RESULTS)).count() == 0


def test_near_lines_are_stripped(spark):
    tail = "all the content of this site is offered as is and without any promise about its use or its fitness for a purpose"
    rows = [(k, "d", k, f"Own words number {chr(97 + k)} {chr(98 + k)} alone\n{tail}{' today' if k % 2 else ''} {chr(97 + k)}") for k in range(8)]
    results = [(f"dataset:d:{k}", "https://s.example/") for k in range(8)]
    got = {r.row_id: r for r in lines.strip_lines(spark.createDataFrame(rows, ROWS), spark.createDataFrame(results, RESULTS)).collect()}
    assert sum(r.removed for r in got.values()) == 8 and all("Own words" in r.text for r in got.values())


def test_empty(spark):
    a, b = spark.createDataFrame([], ROWS), spark.createDataFrame([], RESULTS)
    assert lines.found(a, b).count() == 0 and lines.strip_lines(a, b).count() == 0
    one = spark.createDataFrame([(1, "d", 0, None)], ROWS)
    assert lines.strip_lines(one, b).collect()[0].text is None


def signatures(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(["s"] * len(texts)), pa.array(texts)], ["node", "site", "masked"])
    out = next(lines._signatures(iter([batch]))).to_pydict()
    assert out["node"] == list(range(len(texts))) and out["chars"] == [len(t) for t in texts]
    return [set(b) for b in out["buckets"]], list(zip(*(out[c] for c in lines.SKETCH)))


def test_buckets_agree_with_similarity():
    words = [f"word{i * i}" for i in range(40)]
    of, sketch = signatures([" ".join(words), " ".join(words[:-1] + ["z"]), "".join(reversed(" ".join(words))), "one", "日本", "😀", "x" * 9])
    assert of[0] & of[1] and not of[0] & of[2] and all(len(b) == lines.BANDS for b in of) and not of[3] & of[4]
    alone = signatures(["one"])[0][0]
    assert alone == of[3]


def test_shingles_and_agreement(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(50):
        a = [rng.randrange(256) for _ in range(8)]
        b = [x if rng.random() < 0.5 else rng.randrange(256) for x in a]
        pairs.append((*(int.from_bytes(bytes(x), "little", signed=True) for x in (a, b)), sum(x == y for x, y in zip(a, b))))
    df = spark.createDataFrame(pairs, "x long, y long, n int")
    assert df.where(lines._agreeing(F.col("x"), F.col("y")) != F.col("n")).count() == 0
    assert lines.shingles("abcdefg") == {"abcde", "bcdef", "cdefg"} and lines.shingles("ab") == {"ab"} and lines.similarity("abcdefg", "abcdefx") == 0.5


def sentence(rng, n):
    return [("".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "s"])) for _ in range(n)]


def variants(rng, n, many):
    """A notice of ``n`` words, and versions of it that have another word in the middle."""
    base = sentence(rng, n)
    return [" ".join([*base[: n // 2], sentence(rng, 1)[0], *base[n // 2 + 1 :]]) for _ in range(many)]


def test_recall_of_variants_against_brute_force(spark):
    """Of all pairs of lines at the similarity or more, nine in ten are linked, and no other pair is."""
    rng = random.Random(11)
    texts = []
    for n in (8, 12, 20, 30, 60):
        for _ in range(12):
            texts += variants(rng, n, 4)
    texts += [" ".join(sentence(rng, rng.randint(3, 30))) for _ in range(300)]
    nodes = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "node long, site string, masked string")
    got = {(r.key, r.other) for r in lines.close_lines(nodes.unionByName(nodes.where("node % 3 = 0"))).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if lines.similarity(texts[i], texts[j]) >= lines.SIMILARITY}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 200


@pytest.mark.parametrize("n", [12, 30])
def test_short_notices_with_another_word_are_stripped(spark, n):
    """Twelve rows whose notice differs in its middle word: nearly all of them; lines that only look alike stay."""
    rng = random.Random(n)
    notices = [v for _ in range(10) for v in variants(rng, n, 12)]
    rows = [(k, "d", k, f"{' '.join(sentence(rng, 9))}\n{v}\nthe {sentence(rng, 1)[0]} keeps its own {sentence(rng, 1)[0]} for {' '.join(sentence(rng, 3))}") for k, v in enumerate(notices)]
    results = [(f"dataset:d:{k}", "https://s.example/") for k in range(len(rows))]
    got = {r.row_id: r for r in lines.strip_lines(spark.createDataFrame(rows, ROWS), spark.createDataFrame(results, RESULTS)).collect()}
    gone = sum(v not in got[k].text for k, v in enumerate(notices))
    assert gone >= 0.9 * len(notices) and sum(r.removed for r in got.values()) == gone


@pytest.mark.parametrize(
    ("line", "masked"),
    [
        ("By Ann Lee, desk 4", "by n n, desk 0"), ("Views belong to their authors and not to Kelvaro.", "views belong to their authors and not to n."), ("Das Team von Kelvaro verschiebt Einträge", "das team von kelvaro verschiebt einträge"),
        ("Counting The Shared Lexicon", "counting the shared lexicon"), ("updated 2024-05-06 12:30", "updated 0 0"), ("ALL RIGHTS", "all rights"),
    ],
)
def test_mask(spark, line, masked):
    assert spark.createDataFrame([(line,)], "line string").select(lines.mask(F.col("line"))).first()[0] == masked


def test_all_near_lines_are_stripped(spark):
    """A chain of variants, each near to the next only, is one cluster whichever line has the least key."""
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    # Version k has the words of version k - 1 but for two neighbours: neighbours agree in 110 of 122 shingles.
    version = [" ".join([f"other{w}" if 6 + 12 * k > i >= 6 and i % 12 in (6, 7) else w for i, w in enumerate(words)]) for k in range(8)]
    rows = [(k, "d", k, f"Own words number {chr(97 + k)} {chr(98 + k)} alone\n{v}") for k, v in enumerate(version)]
    results = [(f"dataset:d:{k}", "https://s.example/") for k in range(8)]
    got = {r.row_id: r for r in lines.strip_lines(spark.createDataFrame(rows, ROWS), spark.createDataFrame(results, RESULTS)).collect()}
    assert [got[k].removed for k in range(8)] == [1] * 8 and all("Own words" in r.text for r in got.values())


@pytest.mark.parametrize("size", [2, 40])
def test_large_bucket_of_like_lines(spark, monkeypatch, size):
    """Those like the least line are linked by it, not each with each; others of the bucket are not lost."""
    monkeypatch.setattr(lines, "BUCKET", size)
    rng = random.Random(5)
    base = sentence(rng, 30)
    like = [" ".join([*base[:k], "zq" * 3, *base[k + 1 :]]) for k in range(20)] + [" ".join([*base, f"end{k}"]) for k in range(20)]
    data = [(k, "s", t) for k, t in enumerate(like)]
    pairs = lines.close_lines(spark.createDataFrame(data, "node long, site string, masked string"))
    assert {(r.key, r.cluster) for r in lines.components(pairs).collect()} == {(k, 0) for k in range(1, 40)}
    assert (pairs.distinct().count() < 200) == (size == 2)


def test_bucket_members_are_compared_in_blocks(spark, monkeypatch):
    """Lines that share a bucket whose least line resembles none of them are linked all the same."""
    monkeypatch.setattr(lines, "BUCKET", 2)
    notes = [" ".join(f"{c}{i}" for i in "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz") for c in "pqr"]
    data = [(3 * k + j, "s", note + end) for j, note in enumerate(notes) for k, end in enumerate((" u", " x", " y", " z", " n", " v"))]
    pairs = lines.close_lines(spark.createDataFrame(data, "node long, site string, masked string"))
    got = defaultdict(set)
    for r in lines.components(pairs).collect():
        got[r.cluster].add(r.key)
    assert {k | {c} for c, k in ((c, frozenset(v)) for c, v in got.items())} == {frozenset(range(j, 18, 3)) for j in range(3)}


def test_components(spark):
    rng = random.Random(1)
    chain = list(range(40))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r.key: r.cluster for r in lines.components(spark.createDataFrame(pairs, "key long, other long")).collect()}
    assert got == {k: 0 for k in range(1, 40)} | {101: 100, 102: 100} | {k: 300 for k in range(301, 330)}
    assert lines.components(spark.createDataFrame([], "key long, other long")).count() == 0


def test_like_entries_of_one_row_are_content(spark):
    """Six entries that are equal after masking count by their rows: once in one document, six times in six."""
    entry = ["- consistent draft Makabrand edge", "- consistent draft Tatameth edge", "- consistent draft Speicher edge", "- consistent draft Barimirn edge", "- consistent draft Cerad edge", "- consistent draft Ologor edge"]
    rows = [(0, "d", 0, "\n".join(entry))] + [(k, "d", k, f"Own words {chr(96 + k)} alone") for k in range(1, 8)]
    rows += [(20 + k, "e", k, e) for k, e in enumerate(entry)]
    results = [(f"dataset:d:{k}", "https://s.example/") for k in range(8)] + [(f"dataset:e:{k}", "https://t.example/") for k in range(6)]
    got = {r.row_id: r.removed for r in lines.strip_lines(spark.createDataFrame(rows, ROWS), spark.createDataFrame(results, RESULTS)).collect()}
    assert got == {k: 0 for k in range(8)} | {20 + k: 1 for k in range(6)}
