"""Fits the trees of problem 4 on pieces that strict rules of each syntax label.

    python -m pagequarry.llm.train_markup /root/testdata/sf0.1

At most ``SAMPLE`` rows of each field, those with the least hash of their id, are
labelled; a fifth of them is held out.
"""

from __future__ import annotations

import json
import random
import re
import sys
import zlib

import numpy as np

from pagequarry.llm import gbt, markup
from pagequarry.llm.dom import parse

SAMPLE = 3000
RULES = {
    "comment": "html", "entity": "html", "wikitable": "wiki", "image": "markdown", "double": "wiki", "link": "markdown", "outside": "wiki", "quotes": "wiki", "equals": "wiki",
    "display": "latex", "paren": "latex", "square": "latex", "environment": "latex", "strong": "markdown", "strike": "markdown", "hash": "markdown", "rule": "markdown", "fence": "markdown", "tick": "markdown",
}
#: Words that belong to a syntax.
KEPT = frozenset("http https www category file image class wikitable style href align color size thumb nbsp quot mdash ndash hellip example".split())
#: Commands of LaTeX that take an argument in running text, and signs of formulas.
COMMANDS = frozenset("section subsection subsubsection chapter paragraph emph textbf textit texttt underline cite citep citet ref label footnote url href item title author caption frac sqrt sum int begin end mathbf mathrm left right".split())


def rule(text: str, form: str, a: int, b: int, parent: str | None) -> int:
    s = text[a:b]
    kind = RULES.get(form)
    if form == "angle":
        m = re.match(r"</?([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])", s)
        kind = "html" if m and m[1].lower() in markup.TAGS and text[a - 1 : a] != "<" else None
    elif form == "template":
        kind = "wiki" if re.match(r"\{\{[^{}|]+\|[^{}|\s][^{}]*\}\}$", s) and "=" in s else None
    elif form == "command":
        m = re.match(r"\\([a-zA-Z]+)\*?(.*)", s, re.S)
        inner = text[b : b + 1] != "\\" and text[a - 1 : a] not in (":", "\\") and not (text[a - 1 : a].isalnum() and not parent)
        kind = "latex" if (parent in ("display", "dollar", "paren", "square", "environment")) or (inner and m[1] in COMMANDS and m[2].startswith(("{", "["))) else None
    elif form == "dollar":
        kind = "latex" if re.search(r"[\\^_]", s) and not re.match(r"\$\d+(?:[.,]\d+)?\s", s) else None
    elif form == "hash" and not re.match(r"[ \t]*#{1,6} \S", s):
        kind = None
    elif form == "strong" and s.startswith("__"):
        kind = None
    return 1 + markup.KINDS.index(kind) if kind else 0


def alone(text: str, draw: random.Random) -> list[str]:
    """The outermost pieces of a text with little around them: what a piece is does not hang on these."""
    out = []
    for form, a, b, up in markup.pieces(text):
        if up < 0 and form in markup.INDEX:
            room = draw.choice((0, 0, 5, 30))
            lo = text.rfind("\n", 0, a) + 1 if form in ("equals", "hash", "rule") else max(0, a - room)
            near = text[lo:b] + ("" if form in ("equals", "hash", "rule") else text[b : b + room])
            out += [near, re.sub(r"(?<![\\\\</&])\b[A-Za-z]{4,}\b", lambda m: other(m[0], draw), near)]
    return out


def other(word: str, draw: random.Random) -> str:
    """Some word in place of another that has no part in a syntax."""
    if word.lower() in KEPT or word.lower() in markup.TAGS or word in COMMANDS:
        return word
    new = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 9)))
    return draw.choice((new, new, new.capitalize(), new.upper()))


def main(folder: str) -> None:
    import duckdb

    rows = duckdb.sql(f"SELECT row_id, markdown, html FROM '{folder}/dataset_rows.parquet' WHERE markdown <> '' OR html <> ''").fetchall()
    rows.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
    docs = [(False, markup.markdown_texts(m)) for m in [m for _, m, _ in rows if m][:SAMPLE]] + [(True, markup.html_texts(parse(h))) for h in [h for _, _, h in rows if h][:SAMPLE]]
    xs, ys, held = [], [], []
    draw = random.Random(7)
    pool = [v for is_html, texts in docs[::7] for _, _, nodes in texts for v in nodes]
    for k, (is_html, texts) in enumerate(docs):
        # Pieces alone stand in any node, so that no tag or token of the pages at hand decides.
        for t in [*texts, *((s, [0], draw.choice(pool)[None]) for t, _, _ in texts for s in alone(t, draw))]:
            f = markup.pieces(t[0])
            if f:
                y = [rule(t[0], form, a, b, f[up][0] if up >= 0 else None) for form, a, b, up in f]
                xs.append(markup.describe(t, f, is_html))
                ys += y
                held += [k % 5 == 0] * len(f)
    x, y, held = np.concatenate(xs), np.array(ys), np.array(held)
    rng = np.random.default_rng(7)
    train = np.flatnonzero(~held)
    form = x[:, : markup.CONTEXT].argmax(1) * 10 + y  # rare forms count as much as common ones
    plain = np.concatenate([rng.permutation(train[form[train] == c])[:300] for c in np.unique(form[train])])
    trees = gbt.fit(x[plain], y[plain], len(markup.KINDS), rounds=25)
    markup.MODEL.write_text(json.dumps(trees, separators=(",", ":")))
    odds = gbt.scores(trees, x[held])
    got = np.where(odds.max(1) > 0, odds.argmax(1) + 1, 0)
    print(f"{len(docs)} documents, {len(y)} pieces, labels {np.bincount(y)}; held out {held.sum()}: {(got != y[held]).sum()} wrong")


if __name__ == "__main__":
    main(sys.argv[1])
