"""Text, URL and hashing functions against plain Python."""

import math
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry import config
from pagequarry.functions import hashing, text, urls
from pagequarry.functions.expr import let

SAMPLES = [
    "", " ", "one two  three", "a b\tc\r\nd\n\n e ", "日本語 text かな", "x_y z-1 2³", "# T\n\ntext\n\n- a\n- b\n\n1. c\n\n```py\n# no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n",
    "![alt](x.png) and [label](http://e.x) \n## Sub  \nmore line", "```\n\n\n```\n", "* x\n\n\n   + y\n\n#NoHeading\n####### seven\n   ### ok",
]


def words(s):
    return re.findall(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+", s)


def clean(s):
    return "\n".join(x for x in (" ".join(line.split()) for line in s.splitlines()) if x)


def test_text_functions(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    c = F.col("s")
    got = df.select(
        "i", text.count_words(c).alias("w"), text.word_units(c).alias("u"), text.clean_text(c).alias("c"), text.estimate_tokens(c).alias("t"), text.count_paragraphs(c).alias("p"),
        text.trim(c).alias("trim"), F.size(text.markdown_headings(c)).alias("h"), text.markdown_title(c).alias("title"), text.markdown_lists(c).alias("l"), text.markdown_tables(c).alias("tab"),
        text.markdown_code_blocks(c).alias("code"), text.strip_markdown(c).alias("plain"),
    ).orderBy("i")
    for r, s in zip(got.collect(), SAMPLES):
        heads = re.findall(r"^ {0,3}(#{1,6})\s+(.+)$", s, re.M)
        assert (r.w, r.u, r.c, r.t) == (len(words(s)), words(s), clean(s), math.ceil(len(s) / 4))
        assert r.trim == s.strip()
        assert r.p == len([p for p in re.split(r"\n\s*\n", s) if p.strip()])
        assert (r.h, r.title) == (len(heads), heads[0][1] if heads else None)
        assert r.l == len(re.findall(r"(?:\A|\n\s*\n)\s*(?:[-*+] |\d+\. )", s))
        assert r.tab == len(re.findall(r"^\s*\|?\s*:?-{3,}.*\|", s, re.M))
        assert r.code == len(re.findall(r"^\s*```", s, re.M)) // 2
        assert "](" not in r.plain and "```" not in r.plain


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Docs.Harbor.ORG:443/Guide?z=9&utm_source=mail&c=3&gclid=q#top", "https://docs.harbor.org/Guide?c=3&z=9"),
        ("http://example.com", "http://example.com/"),
        ("https://example.com:80/x", "https://example.com:80/x"),
        ("https://e.com/?k=2&k=1", "https://e.com/?k=2&k=1"),
        ("https://münchen.example/", "https://xn--mnchen-3ya.example/"),
        *[(u, None) for u in ("", None, "ftp://e.com", "https://u:p@e.com/", "https://e.com:8080/", "https://e .com", "javascript:x", "/path", "https:///x", "x" * 5000)],
    ],
)
def test_normalize_url(url, want):
    assert urls.normalize(url) == want


def test_relative_url():
    assert urls.normalize("../b?x=1#f", "https://e.com/a/c") == "https://e.com/b?x=1"


def test_public_addresses(spark):
    good = ["8.8.8.8", "2606:4700::1111"]
    bad = ["127.0.0.1", "10.0.0.1", "169.254.1.1", "192.0.2.1", "::1", "fc00::1", "::ffff:127.0.0.1", "2002:7f00:1::", "2001:0:1::", "64:ff9b::808:808", "224.0.0.1", "x", ""]
    assert all(map(urls.is_public_ip, good)) and not any(map(urls.is_public_ip, bad))
    df = spark.createDataFrame([(good,), (good + bad[:1],), ([],), (None,)], "ips array<string>")
    assert [r[0] for r in df.select(urls.all_public(F.col("ips"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("pattern", ["*", "*/docs/*", "a?c", "[ab]c", "[!ab]c", "*.pdf", "a[", "a.c", "[]a]c", "x^y", "[a-c]c"])
def test_globs(spark, pattern):
    from fnmatch import fnmatchcase

    values = ["abc", "ac", "bc", "cc", "x/docs/y", "x.pdf", "a[", "a.c", "]c", "x^y", "", "a\nc", "ABC"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.m for r in df.select("v", urls.matches_patterns(F.col("v"), (pattern,), ()).alias("m")).collect()}
    assert got == {v: fnmatchcase(v, pattern) for v in values}


def test_exclude_wins(spark):
    df = spark.createDataFrame([("https://e.com/docs/a",), ("https://e.com/docs/b.pdf",), ("https://e.com/x",)], "v string")
    assert [r[0] for r in df.select(urls.matches_patterns(F.col("v"), ("*/docs/*",), ("*.pdf",))).collect()] == [True, False, False]


def plain_simhash(s):
    import hashlib
    from collections import Counter

    w = words(s)
    total = [0] * 64
    for g, n in Counter(" ".join(w[i : i + 3]) for i in range(max(0, len(w) - 2))).items():
        code = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        for i in range(64):
            total[i] += min(n, 3) * (1 if code >> i & 1 else -1)
    return sum(1 << i for i, v in enumerate(total) if v > 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("alpha beta gamma delta 日 ab1".split()), max_size=60))
def test_simhash(parts):
    s = " ".join(parts)
    assert hashing.simhash(s) % (1 << 64) == plain_simhash(s)


def test_fingerprints(spark):
    rows = [("Straße  ﬁne ³", False), ("", True), (None, True), ("a b c d " * 30, True)]
    got = spark.createDataFrame(rows, "s string, e boolean").select("s", hashing.fingerprints(F.col("s"), F.col("e")).alias("f")).collect()
    import hashlib

    for r in got:
        if r.s is None:
            assert r.f.norm is None and r.f.bits is None
        else:
            n = " ".join(unicodedata.normalize("NFKC", r.s).casefold().split())
            assert r.f.norm == hashlib.sha256(n.encode()).hexdigest()
    assert got[0].f.bits is None and got[3].f.bits == hashing.simhash(hashing.normalize(rows[3][0]))


def test_let_evaluates_once(spark):
    df = spark.createDataFrame([("a b c d",)], "s string")
    got = df.select(let(F.split("s", " "), lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i))).alias("x")).first()
    assert got.x == ["a", "b", "c", "d"]


@pytest.mark.parametrize(
    "bad",
    [
        [], {"x": 1}, {"max_pages": 0}, {"max_pages": True}, {"max_pages": "5"}, {"max_depth": 11}, {"respect_robots_txt": 1}, {"include_patterns": "x"}, {"include_patterns": [""]},
        {"exclude_patterns": ["x"] * 21}, {"mode": "x"}, {"mode": 1}, {"mode": "website", "start_url": " "}, {"mode": "dataset", "dataset_id": "https://x"}, None,
    ],
)
def test_invalid_inputs(bad):
    assert config.problems(bad)
    with pytest.raises(ValueError):
        config.validate(bad)


def test_valid_input():
    c = config.validate({"mode": "dataset", "dataset_id": "owner~name", "include_patterns": ["*"], "max_pages": 7})
    assert (c.dataset_id, c.include_patterns, c.max_pages, c.max_depth) == ("owner~name", ("*",), 7, 3)
