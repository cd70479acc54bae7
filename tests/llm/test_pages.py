"""Problems 2, 4 and 5: page operators."""

import random
import re
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import blocks, gbt, markup, pages, residue, train_blocks, train_markup
from pagequarry.llm.dom import parse

DATA = Path("/root/testdata/sf0.01/dataset_rows.parquet")
PROSE = "The old harbor keeps a record of every visit, and the editor compares it with the notes of last year. "


def body(inner, title="The old harbor", head=""):
    return f"<!doctype html><html><head><title>{title}</title>{head}</head><body>{inner}</body></html>"


def numbered(html):
    out, n = [], 0
    for part in html.split("@"):
        out.append(part)
        n += 1
        out.append(f'data-nid="{n}"')
    return "".join(out[:-1])


ARTICLE = numbered(
    "<nav><ul><li @><a href='/a'>Docs</a></li><li @><a href='/b'>Pricing</a></li></ul></nav><main><h1 @>The old harbor</h1>"
    f"<p @>{PROSE * 3}</p><ul><li @>First entry of the list</li></ul><pre @><code>run x {{{{name}}}}</code></pre><p @>{PROSE * 2}</p></main><footer><p @>© 2020 Acme</p><small @>Terms of use</small></footer>"
)


def detect(html, address="https://e.example/docs/the-old-harbor-12", title="The old harbor"):
    d = residue.detect(parse(html), address, title)
    return d["placeholder"] or d["filler"] or d["notice"] or (d["short"] and (d["errors"] >= 2 or (d["errors"] == 1 and d["match"] < 0.5)))


CASES = [
    "<h1 @>Welcome back, {{user}}</h1><p @>" + PROSE * 3 + "</p>", "<h1 @>T</h1><p @>Dear ${user.name}, " + PROSE * 2 + "</p>", "<h1 @>[object Object]</h1><p @>" + PROSE * 3 + "</p>", "<p @>[INSERT NAME HERE] " + PROSE + "</p>",
    "<p @>Dear %%NAME%%, " + PROSE + "</p>", "<p @>{% include x %} " + PROSE + "</p>", "<h1 @>Your heading goes here</h1><p @>Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.</p>",
    "<h1 @>404 Not Found</h1><p @>The page you asked for could not be found.</p>", "<h1 @>Seite nicht gefunden</h1><p @>Die angeforderte Seite existiert nicht mehr.</p>", "<div @>Please enable JavaScript to view this page.</div><div id=root></div>",
    "<noscript>JavaScript is required to read this.</noscript><div id=root></div>", "<h1 @>Access denied</h1><p @>Your request was blocked. Reference 8d6d98ef.</p>",
]
FINE = [
    ARTICLE, f"<h1 @>The old harbor</h1><p @>{PROSE * 4} When a page is not found the server returns a 404 status and logs it.</p>", f"<noscript>JavaScript is required.</noscript><h1 @>H</h1><p @>{PROSE * 4}</p>",
    f"<h1 @>H</h1><p @>{PROSE * 4} Filler text such as lorem ipsum should be gone before it is published.</p>", f"<h1 @>H</h1><p @>{PROSE * 4} $\\frac{{c}}{{t+4}}$ \\emph{{corpus}} [2] [sic] {{{{card|name=x}}}} costs $2 and $7</p>",
    f"<h1 @>H</h1><p @>{PROSE * 4}</p><pre @>Dear {{{{name}}}}, ${{x}}</pre>", "<div></div>", "", f"<h1 @>H</h1><p @>{PROSE * 4} Readers who switch JavaScript off still get the text.</p>",
]


@pytest.mark.parametrize("inner", CASES)
def test_residue(inner):
    assert detect(body(numbered(inner) if "@" in inner else inner))


@pytest.mark.parametrize("inner", FINE)
def test_no_residue(inner):
    assert not detect(body(numbered(inner) if "@" in inner else inner))


def rows(spark, data):
    return spark.createDataFrame([(i, h, m, None, None, None, None) for i, (h, m) in enumerate(data)], "row_id long, html string, markdown string, loadedurl string, url string, canonicalurl string, title string")


def test_residue_rows(spark):
    data = [(body(numbered(c) if "@" in c else c), None) for c in CASES + FINE] + [(None, None), ("<p", None), ("<" * 3000, None), ("x" * 200_000, None)]
    df = rows(spark, data).withColumn("print", F.lit(1)).withColumn("host", F.lit("x"))
    assert {r.row_id for r in pages.residue_rows(df).collect()} == set(range(len(CASES)))
    assert pages.without_residue(df).count() == len(data) - len(CASES)
    assert pages.residue_rows(rows(spark, [])).count() == 0


def test_body_blocks(spark):
    df = rows(spark, [(body(ARTICLE), None), (None, None), ("", None), ("<p>no ids</p>", None)])
    assert {r.nid for r in pages.aside_blocks(df).collect()} == {1, 2, 8, 9}
    got = {r.row_id: r for r in pages.main_bodies(df).collect()}
    assert "harbor" in got[0].body and "Acme" not in got[0].body and got[3].body == "no ids" and set(got) == {0, 3}
    assert pages.aside_blocks(rows(spark, [])).count() == 0


def plain(html):
    return re.sub(r'\s*data-nid="\d+"', "", html)


def test_bodies_do_not_need_ids(spark):
    page = body(plain(ARTICLE))
    got = pages.main_bodies(rows(spark, [(page, None)])).collect()[0]
    assert got.body.startswith("The old harbor") and "First entry" in got.body and "Acme" not in got.body and "Pricing" not in got.body
    assert pages.aside_blocks(rows(spark, [(page, None)])).count() == 0  # nothing has an id to report
    assert detect(page.replace("First entry", "First {{ user.name }}")) and not detect(page)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_bodies_and_residue_are_the_same_without_ids(spark):
    df = spark.read.parquet(str(DATA)).where("html != ''")
    bare = df.withColumn("html", F.regexp_replace("html", r' data-nid="?[0-9]+"?', ""))
    assert bare.where("html like '%data-nid%'").count() == 0
    a, b = ({(r.row_id, r.body) for r in pages.main_bodies(x).collect()} for x in (df, bare))
    assert a == b and len(a) > 300 and sum(t != "" for _, t in a) > 300
    a, b = ({r.row_id for r in pages.residue_rows(x).collect()} for x in (df, bare))
    assert a == b and len(a) > 20


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_blocks_are_the_elements_around_text():
    import duckdb

    for (h,) in duckdb.sql(f"SELECT html FROM '{DATA}' WHERE html <> ''").fetchall():
        page = parse(h)
        assert page.blocks == [i for i, n in enumerate(page.nid) if n]


@pytest.mark.parametrize(
    ("html", "shown"),
    [
        ("<nav><a>A</a> | <a>B</a></nav>", ["A", "B"]), ("<div>One <b>two</b> three</div>", ["One two three"]), ("<li>x<ul><li>y</ul>", ["x", "y"]), ("<table><tr><td>1<td><b>2</b></table>", ["1 2"]),
        ("<table><tr><td><p>a</p><td>b</table>", ["a", "b"]), ("<p>Use <code>x</code>, please", ["Use x, please"]), ("<span><div>in</div> out</span>", ["out", "in"]), ("text", ["text"]), ("<pre>a <b>b</b>\n<i>c</i></pre>", ["a b c"]), ("\x1dq\x1f<p>\x1e</p>", ["q"]),
    ],
)
def test_blocks(html, shown):
    page = parse(html)
    assert [page.string(i) for i in page.blocks] == shown


def test_ids_of_other_elements():
    page = parse('<main data-nid="1"><h1 data-nid="2">H</h1><p data-nid="3">a <b data-nid="4">b</b></p><hr><i data-nid="5"></i></main><footer data-nid="6"><p>c</p></footer>')
    items = page.blocks
    assert blocks.aside_ids(page, items, [page.tag[page.parent[i]] == "main" for i in items]) == [6]
    assert blocks.aside_ids(page, items, [False] * len(items)) == [1, 2, 3, 4, 5, 6]


def test_long_error_pages_and_notices():
    error = "<h1>404 Not Found</h1>" + "<p>The page you asked for could not be found, since the link has expired.</p>" * 9
    assert detect(body(error)) and len(parse(error).blocks) == 10
    assert detect(body("<p>Please turn on JavaScript. Scripts are required for this site to work, so enable them and reload the page once more.</p>" * 5))
    assert not detect(body(f"<h1>The old harbor</h1><p>{PROSE * 6}</p><p>The page was not found. Turn on JavaScript, which is required.</p>"))
    assert detect(body("<p>" + PROSE + "{% if " + "x and " * 40 + "y %}</p>")) and detect(body("<p>" + PROSE + "[insert " + "a very long name " * 9 + "here]</p>"))


def test_every_error_phrase_holds_a_hint():
    for phrase in ("error 404", "HTTP 503", "404 oh", "page not found", "no longer exists", "did not exist", "has been removed", "could not be found", "can't be found", "timed out", "gone", "access is denied", "log in to view", "captcha", "slow down", "whoops", "incident 12ab34"):
        assert residue.ERROR.search(phrase) and any(h in phrase.lower() for h in residue.HINTS)


def test_host_evidence_counts_addresses(spark):
    """A short page of its own, delivered three times from one address, is kept; one body at many addresses that fits none is not."""
    flag = body("<h1>Flags</h1><p>The flag --fast is no longer available. Use --quick.</p>", "Flags")
    data = [(k, flag, None, f"https://e.example/docs/flags{'#a' if k else ''}", None, None, "Flags for beginners and others") for k in range(3)]
    sorry = body("<p>We made a change here and will be back soon with more.</p>", "Acme")
    data += [(10 + k, sorry, None, f"https://e.example/docs/{w}-guide", None, None, f"{w.title()} guide") for k, w in enumerate(("apple", "banana", "cherry", "damson", "elder", "fig"))]
    df = spark.createDataFrame(data, "row_id long, html string, markdown string, loadedurl string, url string, canonicalurl string, title string")
    signs = {r.row_id: r for r in pages.residue_signs(df).collect()}
    assert {signs[k].shown for k in range(3)} == {1} and signs[10].shown == 6 and signs[10].hosts == 1
    assert {r.row_id for r in pages.residue_rows(df.where("row_id >= 10")).collect()} == set(range(10, 16))
    kept = df.withColumn("title", F.when(F.col("row_id") < 3, "Flags").otherwise(F.col("title")))
    assert {r.row_id for r in pages.residue_rows(kept).collect()} == set(range(10, 16))


def test_large_flow():
    """Undecided nodes in a long chain: the labels are found, and a cut of the least cost."""
    n = 4000
    rng = random.Random(4)
    unary = [rng.choice((1, -1)) * rng.random() * 0.4 for _ in range(n)]
    edges = [(i, i + 1, 0.5) for i in range(n - 1)]
    got = blocks.minimum_cut(unary, edges)
    best = [max(-unary[0], 0.0), max(unary[0], 0.0)]  # of chains that end in True, in False
    for i in range(1, n):
        best = [min(best[0], best[1] + 0.5) + max(-unary[i], 0.0), min(best[1], best[0] + 0.5) + max(unary[i], 0.0)]
    assert cost(got, unary, edges) == pytest.approx(min(best))


def cost(label, unary, edges):
    return sum(max(u, 0) if not x else max(-u, 0) for x, u in zip(label, unary)) + sum(w for a, b, w in edges if label[a] != label[b])


@pytest.mark.parametrize("seed", range(25))
def test_minimum_cut(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    unary = [rng.choice([0, 1, -1]) * rng.random() * 3 for _ in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randint(0, 2 * n))]
    edges = [e for e in edges if e[0] != e[1]]
    best = min(cost(x, unary, edges) for x in product([False, True], repeat=n))
    assert cost(blocks.minimum_cut(unary, edges), unary, edges) == pytest.approx(best)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_block_accuracy():
    """On pages whose layout labels its parts (their names are no features), not those it was fitted on."""
    import duckdb

    wrong = total = 0
    for (h,) in duckdb.sql(f"SELECT html FROM '{DATA}' WHERE html <> ''").fetchall():
        page = parse(h)
        items, _, labels = blocks.classify(page)
        for y, b in zip(train_blocks.labels(page, items), labels):
            if y is not None:
                total += 1
                wrong += b != bool(y)
    assert total > 2000 and wrong / total < 0.002


@pytest.mark.parametrize(
    ("field", "text", "kinds"),
    [
        ("markdown", "# T\n\n**b** [x](https://e.example) text\n\n- a\n- b\n\n| a | b |\n| --- | --- |\n", set()), ("markdown", "a <b>x</b> y", {"html"}), ("markdown", "a <!-- note --> y", {"html"}), ("markdown", "a &nbsp; y", {"html"}),
        ("markdown", "see [[Page|label]] and '''bold'''", {"wiki"}), ("markdown", "== Title ==\n", {"wiki"}), ("markdown", "{| class=\"wikitable\"\n! a\n|-\n| b || 7\n|}", {"wiki"}), ("markdown", "a \\textbf{x} $\\frac{a}{b}$", {"latex"}),
        ("markdown", "```\n<b>x</b> [[y]] \\emph{z}\n```\n`<i>`", set()), ("markdown", "<https://e.example/x> C:\\section\\part costs $2 and $7, [3] [sic] a < b > c 7 * 5 * 6", set()), ("markdown", "Dear {{name}}, {{ x | upper }}", set()),
        ("html", "<p>a &lt;b&gt;x&lt;/b&gt;</p>", {"html"}), ("html", "<p>a &amp;nbsp; y</p>", {"html"}), ("html", "<p>x &amp; y <b>z</b></p>", set()), ("html", "<p>a **bold** b</p>", {"markdown"}), ("html", "<p>a [x](https://e.example/y)</p>", {"markdown"}),
        ("html", "<p>t\n## Title here\n</p>", {"markdown"}), ("html", "<p>[[Category:X]] \\cite{a2001}</p>", {"wiki", "latex"}), ("html", "<pre>**x** [[y]]</pre><p>t</p>", set()), ("html", "<p>\\[ \\sqrt{x} \\approx 3 \\]</p>", {"latex"}),
    ],
)
def test_markup_kinds(spark, field, text, kinds):
    doc = markup.html_texts(parse(text)) if field == "html" else markup.markdown_texts(text)
    assert markup.kinds(markup.label([doc], field == "html")[0], "" if field == "html" else "markdown") == kinds


@pytest.mark.parametrize(
    ("field", "text", "kinds"),
    [
        ("markdown", "Sum is\n\n$$\nx^2+y^2\n$$\n", {"latex"}), ("markdown", "$$ " + "x^2+y_1 " * 90 + "$$", {"latex"}), ("markdown", "\\[ " + "\\frac{a}{b} + " * 60 + "c \\]", {"latex"}), ("markdown", "\\( " + "x + y + " * 60 + "c^2 \\)", {"latex"}),
        ("markdown", 'a <img src="data:image/png;base64,' + "Ab1/" * 300 + '" alt="z"> b', {"html"}), ("markdown", 'a <img\n  src="x.png"\n  alt="z"\n> b', {"html"}), ("markdown", "a <b and c\n\n> d", set()), ("markdown", "[[" + "Page of words " * 30 + "|x]]", {"wiki"}),
        ("markdown", "{{Infobox|name=" + "x y " * 150 + "|b=2}}", {"wiki"}), ("markdown", "{{Infobox|name={{lang|de=Haus}}|b=2}}", {"wiki"}), ("html", "<p>a **" + "bold text " * 50 + "** b</p>", {"markdown"}), ("html", "<p>[x](https://e.example/" + "y" * 500 + ")</p>", {"markdown"}),
    ],
)
def test_long_pieces(field, text, kinds):
    doc = markup.html_texts(parse(text)) if field == "html" else markup.markdown_texts(text)
    assert markup.kinds(markup.label([doc], field == "html")[0], "" if field == "html" else "markdown") == kinds


def test_long_pieces_are_cleaned():
    assert "$$" in markup.render_markdown("Sum\n\n$$\nx^2+y^2\n$$\n") and markup.render_markdown('a <img\n  src="x.png"\n  alt="z"\n> b') == "a z b"
    assert markup.render_markdown("a {{Infobox|name={{lang|de=Haus}}|b=2}} b") == "a b"


def test_markup_rows(spark):
    df = rows(spark, [("<p>[[x y]]</p>", "a <b>x</b>"), (None, None), ("", ""), ("<p", "`" * 5000), ("x" * 100_000, "[[" * 5000 + "$" * 3000)]).withColumn("markup", F.lit(1))
    got = {(r.row_id, r.field_name, r.markup) for r in pages.markup_kinds(df).collect()}
    assert {(0, "html", "wiki"), (0, "markdown", "html")} <= got and {r for r, _, _ in got} <= {0, 4}
    assert pages.clean_texts(df).count() == 6 and pages.markup_kinds(rows(spark, [])).count() == 0


def test_clean_text():
    md = "# T\n\nA **b** [[P|q]] <b>x</b> &amp; $\\frac{a}{b}$ \\cite{z1}\n\n== S ==\n\n- one\n- two\n\n```\ncode <b>\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    got = markup.render_markdown(md)
    for keep in ("# T", "A b q x & $\\frac{a}{b}$", "## S", "- one", "```\ncode <b>\n```", "| 1 | 2 |"):
        assert keep in got
    page = markup.render_page(parse("<h2>T</h2><p>a '''b''' &lt;br&gt; c</p><ul><li>x</li></ul><pre>k  = 1\n y</pre><table><tr data-nid=1><td>1</td><td>2</td></tr></table>"))
    assert page.splitlines()[0] == "## T" and "- x" in page and "```\nk  = 1\n y\n```" in page and "'''" not in page and "<br>" not in page


def test_clean_table_rows_and_nested_pieces():
    page = markup.render_page(parse("<table><tr data-nid=1><td>1</td><td>2</td></tr><tr data-nid=2>\n<th>a '''b''' &lt;br&gt; c</th> <td></td><td>[[P|q]]</td></tr></table>"))
    assert page.splitlines() == ["| 1 | 2 |", "| a b c |  | q |"]
    assert markup.render_markdown("see '''[[P|q]]''' there") == "see q there"
    assert "[[" not in markup.render_markdown("x\n\n{| class=\"wikitable\"\n! a\n|-\n| [[P|q]] || 7\n|}")


@pytest.mark.parametrize(
    "md",
    [
        "Sum\n\n$$a = \\frac{1}{2}$$", "# T\n\n| a | b |\n|---|---|\n| 1 | 2 |", "- one\n  - two\n    - three\n\n1. x\n2. y\n\n    code of the entry", "Text\n\n    indented <b>code</b>\n      more [[x]]\n\nend",
        "Use `<i>` and ``a ` b`` here", "```\nx  [[y]]\n```", "a formula $x^2_1$ and a price of $5", "",
    ],
)
def test_clean_text_stays_as_it_is(md):
    assert markup.render_markdown(md) == md


@pytest.mark.parametrize(
    ("md", "clean"),
    [
        ("$$\na = \\frac{1}{2}\n$$", "$$a = \\frac{1}{2}$$"), ("x <table><tr><td>1</td><td>2</td></tr></table> y", "x\n\n| 1 | 2 |\n\ny"), ("\\begin{itemize}\n\\item one\n\\item \\emph{two}\n\\end{itemize}", "- one\n- two"),
        ("\\begin{align}\na&=b\\\\\nc&=d\n\\end{align}", "$$a&=b\\\\\nc&=d$$"), ('{| class="wikitable"\n! h !! i\n|-\n| [[P|q]] || 7\n|}', "| h | i |\n| --- | --- |\n| q | 7 |"), ("**bold [[P|q]]** `[[r]]`", "bold q `[[r]]`"),
        ('a <img alt="it\'s" src="x"> b', "a it's b"),
    ],
)
def test_structure_is_kept(md, clean):
    assert markup.render_markdown(md) == clean


def test_page_structure_is_kept():
    page = "<table><tr><th>h<th>i<tr><td>one<td>two three</table><ol><li>a<ul><li>b<li>c</ul><li><p>d</p><p>e</p></ol><pre>k  = 1\n y</pre><h2>T</h2><p>Use <code>x &lt;b&gt; [[y]]</code> here</p><blockquote>q</blockquote>"
    parts = ["| h | i |\n| --- | --- |\n| one | two three |", "1. a\n  - b\n  - c\n2. d\n  e", "```\nk  = 1\n y\n```", "## T", "Use `x <b> [[y]]` here", "> q"]
    assert markup.render_page(parse(page)) == "\n\n".join(parts)
    assert markup.kinds(markup.label([markup.html_texts(parse(page))], True)[0], "") == set()


def test_node_features():
    page = parse('<div class="note math"><p>a **b** c</p><p>plain</p><ul><li>[[x]] y</li></ul></div>')
    a, b = markup.html_texts(page)
    depth, size, chars, links, density, signs, kin, share = a[2][0][:8]
    assert (depth, size, chars, links, density) == (2, 1, 9, 0, 9) and signs == pytest.approx(4 / 9) and kin == 3 and share == pytest.approx(2 / 3)
    assert a[2][0][12:].sum() > 1 and b[2][0][0] == 3 and a[2].shape == (1, markup.NODE_FEATURES)
    text, starts, nodes = markup.markdown_texts("# T\n\ntext [[x]]\n\n- a\n\n- b")[0]
    assert len(starts) == len(nodes) == 4 and [int(v[12:19].argmax()) for v in nodes] == [1, 0, 2, 2]


def test_deep_pieces():
    text = "{{{1|" * 3 + "x" + "}}}" * 3 + " " + "\\[ " * 3000 + "**__" * 3000
    assert markup.pieces(text) is not None
    deep = "'''" + "**" + "''" + "__" + "[[P|q]]" + "__" + "''" + "**" + "'''"
    assert any(f == "double" for f, *_ in markup.pieces(deep))


def test_hierarchy_has_no_contradictions():
    found = [("wikitable", 0, 50, -1), ("rule", 5, 10, 0), ("link", 12, 20, 0), ("link", 60, 70, -1)]
    odds = np.array([[-5, -5, 4, -5], [-5, 6, -5, -5], [-5, 1, -5, -5], [-5, 2, -5, -5]], float)
    got = markup.decode(found, odds)
    assert got[0] == 0 and got[1] == 2 or got[0] == 3 and got[1] in (0, 3)
    assert got[3] == 2


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = np.where(x[:, 0] > 0.5, np.where(x[:, 1] > 0.5, 1, 2), 0)
    odds = gbt.scores(gbt.fit(x[:400], y[:400], 2), x[400:])
    assert (np.where(odds.max(1) > 0, odds.argmax(1) + 1, 0) == y[400:]).mean() > 0.95


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_markup_accuracy():
    import duckdb

    wrong = total = 0
    for (m,) in duckdb.sql(f"SELECT markdown FROM '{DATA}' WHERE markdown <> ''").fetchall():
        for t, f, labels in markup.label([markup.markdown_texts(m)], False)[0]:
            for (form, a, b, up), x in zip(f, labels):
                total += 1
                wrong += x != train_markup.rule(t, form, a, b, f[up][0] if up >= 0 else None) and not (up >= 0 and labels[up])
    assert total > 500 and wrong / total < 0.01
