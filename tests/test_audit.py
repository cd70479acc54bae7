"""The audit from source rows to the report."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry import api
from pagequarry.config import AuditConfig
from pagequarry.functions import hashing
from pagequarry.functions.html_kernel import extract
from pagequarry.operators import adapt, dedup, report, scoring

PARA = "Every crawler keeps a compact record of the pages it visits so that a later audit can compare them. "
GUIDE = (
    '<!doctype html><html><head><title>Guide</title><meta name="Description" content="d"><link rel="canonical" href="/g"><script type="application/ld+json">{}</script></head>'
    '<body><nav><a href="/a">A</a><a href="https://other.example/">O</a></nav><main><h1>Guide</h1><h3>Part</h3>'
    + f"<p>{PARA * 5}</p><p>{PARA * 4}</p><ul><li>x</li></ul><pre>code</pre><table><tr><td>1</td></tr></table></main><aside>side</aside><footer>foot</footer></body></html>"
)
ALL = AuditConfig(max_pages=None, dataset_id="d")
SOURCE = "dataset_id string, row_index long, markdown string, cleantext string, text string, content string, html string, loadedurl string, url string, canonicalurl string, title string"


def source(spark, rows):
    names = [f.split()[0] for f in SOURCE.split(", ")]
    return spark.createDataFrame([tuple({"dataset_id": "d", "row_index": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], SOURCE)


def by_index(df):
    return {int(r.source_id.rsplit(":", 1)[1]): r for r in df.collect()}


def test_kernel_measures():
    k = extract(GUIDE, "https://e.example/x")
    assert (k["title"], k["has_meta_description"], k["has_json_ld"], k["canonical_url"]) == ("Guide", True, True, "https://e.example/g")
    assert (k["heading_levels"], k["paragraph_count"], k["list_count"], k["table_count"], k["code_block_count"]) == ([1, 3], 2, 1, 1, 1)
    assert (k["internal_link_count"], k["external_link_count"], k["links"], k["js_shell"]) == (1, 1, ["https://e.example/a"], False)
    assert "foot" not in k["text"] and "side" not in k["text"] and k["boilerplate_ratio"] > 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("<p>a<p>b", "a\nb"), ("a<script>x</script>b<style>y</style>", "a\nb"), ("<p hidden>h</p><p aria-hidden='true'>i</p>ok", "ok"), ("x &amp; y &lt;z", "x & y <z"), ("</div>t<b>u", "t\nu"),
        ("<body>b<article>long text here</article><main>m</main></body>", "long text here"), ("<div role=dialog aria-label='Cookie note'>Accept</div>t", "t"), ("<!-- c --><template>q</template>t", "t"), ("<" * 50 + "x", "<" * 50 + "x"),
    ],
)
def test_kernel_text(html, text):
    assert extract(html)["text"] == text


def test_kernel_shell_and_canonical():
    assert extract('<div id="Root"></div><script></script>')["js_shell"]
    assert not extract('<div id="root"></div>')["js_shell"]
    assert extract('<link rel=canonical href="https://b.example/">', "https://a.example/")["kernel_issues"] == ["Canonical points to another hostname; it was not followed."]
    assert extract('<link rel=canonical href="x y">', "https://a.example/")["kernel_issues"] == ["Canonical URL is invalid."]
    assert extract("<a href='/x'>l</a>" * 1200, "https://a.example/")["kernel_issues"] == ["Link discovery truncated at the per-page limit."]


def test_precedence_and_errors(spark):
    long = "word " * 20
    rows = source(
        spark,
        [
            {"markdown": "tiny", "text": long}, {"markdown": " ", "text": "short"}, {}, {"html": "<script>x</script>"}, {"content": "<p>" + long + "</p>"}, {"text": "x" * 1_000_001},
            {"markdown": "# T\n\n" + long, "html": "<p>no</p>", "loadedurl": "bad url", "url": "https://E.example:443/a?utm_source=1"},
        ],
    )
    got = by_index(api.audit_pages(rows, ALL))
    assert len(got) == 7
    assert got[0].main_content_chars == 99 and got[1].content_status == "too_short" and got[1].url == ""
    assert [got[i].error_code for i in (2, 3, 5)] == ["dataset_row_unusable", "dataset_row_unusable", "too_large"]
    assert got[2].status == got[5].status == "skipped" and got[3].issues == ["HTML field contains no usable visible content."]
    assert got[4].metadata_available and got[4].raw_html_chars > 0
    assert (got[6].title, got[6].url, got[6].h1_count) == ("T", "https://e.example/a", 1)
    assert got[0].issues[0].startswith("Source URL missing")


def test_duplicates_and_report(spark):
    text = PARA * 8
    rows = source(spark, [{"text": text}, {"text": text}, {"text": text.upper().replace(" ", "  ")}, {"text": text + "One more."}, {"text": "tiny"}, {}, {"text": text + "One more."}])
    result = api.audit(rows, ALL)
    got = by_index(result.every)
    assert [got[i].duplicate_status for i in range(5)] == ["unique", "exact_duplicate", "exact_duplicate", "near_duplicate", "unique"]
    assert [got[i].duplicate_match for i in range(1, 4)] == ["exact", "normalized_exact", "simhash_64"]
    # A copy of a near-duplicate is an exact duplicate of the representative.
    assert (got[6].duplicate_status, got[6].duplicate_of) == ("exact_duplicate", "dataset:d:0")
    r = result.report()
    assert (r["pages_processed"], r["pages_successfully_audited"], r["pages_skipped"], r["exact_duplicates"], r["near_duplicates"], r["score_denominator"]) == (7, 6, 1, 3, 1, 2)
    assert list(report.violations(result.every).first()) == [0, 0, 0]
    off = by_index(api.audit_pages(rows, AuditConfig(max_pages=None, detect_duplicates=False)))
    assert {off[i].duplicate_status for i in range(5)} == {"not_checked"}


def test_empty_audit(spark):
    r = api.audit(source(spark, []), ALL).report()
    assert r["overall_score"] is None and r["score_breakdown"] == {} and r["pages_processed"] == 0 and r["warnings"] == [report.NO_ROWS]


def test_row_limit_and_other_columns(spark):
    rows = source(spark, [{"text": PARA}] * 5).withColumn("source_id", F.lit("clash")).withColumn("status", F.lit(7)).withColumn("k", F.lit(1))
    assert api.audit_pages(rows, AuditConfig(max_pages=3)).count() == 3


def sequential(docs):
    """Duplicates in one pass over rows in order: (idx, text, words)."""
    norm, reps, out = {}, [], {}
    for idx, s, n in docs:
        key = hashing.normalize(s)
        if key in norm:
            out[idx] = norm[key]
            continue
        bits = hashing.simhash(key) % (1 << 64)
        best = min(((bin(bits ^ b).count("1"), i) for i, b, m in reps if min(m, n) / max(m, n) >= 0.8 and bin(bits ^ b).count("1") <= 3), default=None)
        norm[key] = best[1] if best else idx
        if best:
            out[idx] = best[1]
        else:
            reps.append((idx, bits, n))
    return out


def test_near_duplicates_against_one_pass(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(90, 200))] for _ in range(12)]
    docs = []
    for idx in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((idx, " ".join(w), len(w)))
    df = spark.createDataFrame([("", i, str(i), s, n, 0.0) for i, s, n in docs], "scope string, idx long, ref string, text string, words long, boilerplate double")
    got = {int(r.ref): int(r.duplicate_of) for r in dedup.find_duplicates(df).where("duplicate_of is not null").collect()}
    want = sequential(docs)
    assert got == want and len(want) > 50
    again = {int(r.ref): int(r.duplicate_of) for r in dedup.find_duplicates(df.repartition(7)).where("duplicate_of is not null").collect()}
    assert again == got


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 3)
    rng = random.Random(1)
    w = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w + [f"x{i}"] * (i % 3)), 150 + i % 3) for i in range(30)]
    rng.shuffle(docs)
    df = spark.createDataFrame([("", i, str(i), s, n, 0.0) for i, s, n in docs], "scope string, idx long, ref string, text string, words long, boilerplate double")
    got = {int(r.ref): int(r.duplicate_of) for r in dedup.find_duplicates(df).where("duplicate_of is not null").collect()}
    assert got == sequential(sorted(docs))


CHUNKS = [(0, "article", 0, (0, 0)), (100, "article", 0, (100, 0)), (500, "article", 0, (384, 48)), (1000, "documentation", 0, (512, 64)), (3000, "article", 6, (768, 96)), (1000, "faq", 0, (256, 32))]


def test_chunking(spark):
    df = spark.createDataFrame([c[:3] for c in CHUNKS], "estimated_tokens long, page_profile string, heading_count long").select(scoring.chunking().alias("c"))
    assert [(r.c.size, r.c.overlap) for r in df.collect()] == [c[3] for c in CHUNKS]


def test_score_grid(spark):
    rows = [(w, s) for w in (0, 1, 29, 60, 80, 200, 5000) for s in ("unique", "exact_duplicate", "near_duplicate", "not_checked")]
    df = spark.createDataFrame(rows, "word_count long, duplicate_status string").selectExpr(
        "*", "'t' title", "'' url", "0L internal_link_count", "1L code_block_count", "3L paragraph_count", "2L heading_count", "1L list_count", "0L table_count", "5L heading_hierarchy_anomalies",
        "0.9D boilerplate_ratio", "'ok' content_status", "true has_meta_description", "false has_canonical", "false has_json_ld", "array('x', 'x') issues", "10L estimated_tokens",
    )
    for r in scoring.score(df).collect():
        assert 0 <= r.rag_readiness_score <= 100 and abs(sum(r.score_breakdown) - r.rag_readiness_score) < 1e-6
        assert r.issues.count("x") == 1 and r.recommendations


def test_source_rows_numbers_rows(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "Text string, title long")
    got = adapt.source_rows(df, ["Text"]).orderBy("row_index").collect()
    assert [(r.text, r.row_index, r.title, r.html) for r in got] == [("a", 0, None, None), ("b", 1, None, None)]


@pytest.mark.parametrize("most", [10, 100_000])
def test_chains_of_near_duplicates(spark, monkeypatch, most):
    """A long chain is decided as a whole, not a link a round; one too large for that goes on in rounds."""
    monkeypatch.setattr(dedup, "CHAIN", most)
    n = 9 if most == 10 else 300
    links = [("a", k, k + 1) for k in range(n)] + [("b", k, k + 1) for k in range(0, 40, 2)]
    if most == 10:
        links += [("c", k, k + 1) for k in range(14)]
    got = {(r.scope, r.idx): r.rep for r in dedup.representatives(spark.createDataFrame(links, "scope string, lo long, hi long")).collect()}
    want = {("a", k): k % 2 == 0 for k in range(n + 1)} | {("b", k): k % 2 == 0 for k in range(40)}
    if most == 10:
        want |= {("c", k): k % 2 == 0 for k in range(15)}
    assert got == want
