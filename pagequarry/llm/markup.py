"""Problem 4: markup residue in Markdown and HTML, and clean text without it.

A document is a tree: its blocks (elements of a page, paragraphs of Markdown),
below them the pieces of text that may be markup, below these the pieces within
them. Gradient-boosted trees score each piece for each kind of markup, over
features of the piece (its delimiters, what it holds) and of the node it stands
in: depth, tag, density of text, links and signs in its subtree and its
container's, attribute tokens of it and its ancestors, how like its siblings it
is. Hierarchical decoding picks the best joint labelling in which a piece has no
other kind than the piece around it, and none within a code sample.

Defined results: null and empty fields have no rows. Unclosed markup is text.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Generator
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np

from pagequarry.llm import gbt
from pagequarry.llm.dom import ATTR, CELL, CODE_OFF, CODE_ON, SAMPLE, Page

MODEL = Path(__file__).parent / "models" / "markup.json"
KINDS = ("html", "markdown", "wiki", "latex")



def one(but: str) -> str:
    """A sign other than these; a line break if the next line is not blank."""
    return rf"(?:[^{but}\n]|\n(?![ \t]*\n))"


ATTRIBUTE = r"[a-zA-Z_:@][-\w:.]*+\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|[^\s\"'<>=`]++)"
TARGET = r"\((?:(?!\]\()[^)\n])++\)"
#: A template, and within it others to this depth.
TEMPLATES = 6
TEMPLATE = r"\{\{[^{}]++\}\}"
for _ in range(TEMPLATES):
    TEMPLATE = rf"\{{\{{(?:[^{{}}]|{TEMPLATE})++\}}\}}"
#: Pieces that may be markup, by the form of their delimiters.
FORMS = {
    "comment": r"<!--.*?-->",
    "angle": rf"<[a-zA-Z][a-zA-Z0-9]*+(?:\s++{ATTRIBUTE})*+\s*+/?>|</?[a-zA-Z!][^<>\n]*+>",
    "entity": r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});",
    "wikitable": r"\{\|.*?\n\|\}",
    "image": rf"!\[(?:(?!!\[){one('\\]')})*+\]{TARGET}",
    "double": rf"\[\[{one('\\[\\]')}++\]\]",
    "link": rf"\[{one('\\[\\]')}++\]{TARGET}",
    "outside": r"\[https?://[^\s\]]+(?:[ ][^\]\n]*)?\]",
    "bracket": r"\[[^\[\]\n]++\]",
    "triple": rf"\{{\{{\{{{one('{}')}++\}}\}}\}}",
    "template": TEMPLATE,
    "quotes": r"'{2,5}[^'\n]++'{2,5}",
    "equals": r"(?m:^[ \t]*={2,6}[ \t]*[^=\n]+?[ \t]*={2,6}[ \t]*$)",
    "display": rf"\$\${one('$')}++\$\$",
    "dollar": r"(?<![\w$])\$(?![\s${])[^$\n]*+(?<=[^\s$])\$(?!\w)",
    "paren": r"\\\((?:(?!\\[()]).)++\\\)",
    "square": r"\\\[(?:(?!\\[\[\]]).)++\\\]",
    "environment": r"\\begin\{([a-zA-Z*]+)\}.*?\\end\{\1\}",
    "command": r"\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*+\])?(?:\{[^{}\n]*+\})*",
    "strong": rf"\*\*{one('*')}++\*\*|__{one('_')}++__",
    "strike": rf"~~{one('~')}++~~",
    "fence": r"(?s:```.*?```)",
    "tick": rf"`{one('`')}++`",
    "hash": r"(?m:^[ \t]*#{1,6}[ ][^\n]+$)",
    "rule": r"(?m:^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$)",
    "star": r"(?<![\w*])\*[^*\s][^*\n]*+\*(?!\w)",
}
PIECE = re.compile("|".join(f"(?P<{k}>{v.replace(chr(92) + '1', '(?P=env)').replace('([a-zA-Z*]+)', '(?P<env>[a-zA-Z*]+)')})" for k, v in FORMS.items()), re.S)
NAMES = list(FORMS)
INDEX = {k: i for i, k in enumerate(NAMES)}
#: Pieces whose content is searched for further pieces.
NESTING = frozenset("wikitable double link bracket template quotes equals display dollar paren square environment strong strike hash star".split())
FORMULAS = frozenset("display dollar paren square environment".split())
#: Elements of HTML; an angle with another name is no tag.
TAGS = frozenset(
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del div dl dt em embed figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins "
    "kbd label li link main meta nav nowiki ol option p pre q ref s samp script section select small span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul var video wbr".split()
)
SIGNS = re.compile(r"[<>\[\]{}\\$*_`#|=~^&]")
CONTEXT = len(NAMES)
PIECE_FEATURES = 21
#: Features of a node: numbers, tag groups, bins of attribute tokens.
GROUPS = {"p": 0, "li": 2, "dt": 2, "dd": 2, "tr": 3, "td": 3, "th": 3, "a": 4, "span": 4, "small": 4, "div": 5} | {f"h{k}": 1 for k in range(1, 7)}
TAG_GROUPS, TOKEN_BINS = 7, 8
NODE_FEATURES = 12 + TAG_GROUPS + TOKEN_BINS
FEATURES = CONTEXT + PIECE_FEATURES + NODE_FEATURES
#: A text with the places where its nodes begin and their features.
Text = tuple[str, list[int], np.ndarray]


def pieces(text: str) -> list[tuple[str, int, int, int]]:
    """(form, start, end, index of the enclosing piece or -1) of the pieces of a text, outer ones first."""
    out: list[tuple[str, int, int, int]] = []
    todo = [(0, len(text), -1)]
    while todo:
        lo, hi, up = todo.pop()
        for m in PIECE.finditer(text, lo, hi):
            form = next(k for k in (m.lastgroup, "environment") if k in INDEX)
            out.append((form, m.start(), m.end(), up))
            if form in NESTING and m.end() - m.start() > 4:
                todo.append((m.start() + 1, m.end() - 1, len(out) - 1))  # always shorter: ends
    return out


def describe(text: Text, found: list[tuple[str, int, int, int]], is_html: bool) -> np.ndarray:
    """Features of the pieces of a text."""
    s_all, starts, nodes = text
    x = np.zeros((len(found), FEATURES), np.float32)
    same: dict[str, int] = {}
    for form, *_ in found:
        same[form] = same.get(form, 0) + 1
    density = len(SIGNS.findall(s_all)) / max(1, len(s_all))
    for k, (form, a, b, up) in enumerate(found):
        s = s_all[a:b]
        inner = s.strip("<>[]{}()*'=~`$!&;|\\/ \t\n#")
        name = re.match(r"[a-zA-Z]+[0-9]?", inner)
        before, after = s_all[a - 1 : a], s_all[b : b + 1]
        n = max(1, len(s))
        x[k, INDEX[form]] = 1
        x[k, CONTEXT : CONTEXT + PIECE_FEATURES] = (
            len(s), len(s.split()), sum(c.isdigit() for c in s) / n, sum(c.isupper() for c in s) / n, "=" in s, s.count("|"), "://" in s, s.count("\\"),
            "^" in s or "_" in s, s.count("{"), inner[:1].isalpha(), (name[0].lower() in TAGS) if name else 0, s[1:2] == "/", "@" in s,
            before.isalnum(), after.isalnum() or after == "\\", before in (":", "\\"), same[form], density, is_html, 0 if up < 0 else 1 + INDEX[found[up][0]],
        )
        x[k, CONTEXT + PIECE_FEATURES :] = nodes[bisect_right(starts, a) - 1]
    return x


def _node(numbers: tuple, tag: str, tokens: set[str]) -> np.ndarray:
    v = np.zeros(NODE_FEATURES, np.float32)
    v[:12] = numbers
    v[12 + GROUPS.get(tag, 6)] = 1
    for t in tokens:
        v[12 + TAG_GROUPS + zlib.crc32(t.encode()) % TOKEN_BINS] = 1
    return v


@lru_cache(1)
def model() -> list[list]:
    import pkgutil

    return json.loads(pkgutil.get_data("pagequarry.llm", "models/markup.json"))


def decode(found: list[tuple[str, int, int, int]], odds: np.ndarray, own: int = 0) -> list[int]:
    """The best joint labelling (0 for no markup, else 1 + kind): within a piece of one kind there is no other kind.

    Pieces of the kind ``own``, the syntax that the document is written in, may hold any.
    """
    n = len(found)
    if not n:
        return []
    below: dict[int, list[int]] = {}
    for k, (_, _, _, up) in enumerate(found):
        below.setdefault(up, []).append(k)
    p = np.concatenate([np.zeros((n, 1)), odds], axis=1)  # log-odds against no markup
    best = p.copy()
    for k in range(n - 1, -1, -1):  # children come after their parents
        for c in below.get(k, ()):
            top = best[c].max()
            best[k, 0] += top
            for kind in range(1, p.shape[1]):
                best[k, kind] += top if kind == own else max(best[c, 0], best[c, kind])
    out = [0] * n
    for k in range(n):
        up = found[k][3]
        if up >= 0 and out[up] and out[up] != own:
            out[k] = out[up] if best[k, out[up]] > best[k, 0] else 0
        else:
            out[k] = int(best[k].argmax())
    return out


FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
#: Lines set in by four spaces or a tab after a blank line, where the text before is no list.
INDENTED = re.compile(r"(?m)(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")
SPAN = re.compile(r"(`+)(?!`)(?:(?!\n[ \t]*\n).)*?(?<!`)\1(?!`)", re.S)
ENTRY = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]")
PARAGRAPH = re.compile(r"\n(?:[ \t]*\n)+")


def code_blocks(md: str) -> list[tuple[int, int]]:
    """Where the fenced and indented code of Markdown stands, in order."""
    out = [(m.start(), m.end()) for m in FENCE.finditer(md)]
    edges, at = [*out, (len(md), len(md))], 0
    for a, b in edges:
        for m in INDENTED.finditer(md, at, a):
            before = md[:0] if m.start() == at else md[at : m.start()].rstrip().rpartition("\n\n")[2]
            if not ENTRY.match(before) and m[0].strip():
                out.append((m.start(), m.end()))
        at = b
    return sorted(out)


def _kind(paragraph: str) -> str:
    p = paragraph.lstrip()
    return "h1" if p.startswith("#") else "li" if ENTRY.match(paragraph) else "tr" if p.startswith("|") or "|" in p.partition("\n")[0] else "p"


def markdown_nodes(text: str) -> Text:
    """A stretch of Markdown with the features of its paragraphs."""
    starts = [0, *(m.end() for m in PARAGRAPH.finditer(text))]
    parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    tags = [_kind(p) for p in parts]
    signs = [len(SIGNS.findall(p)) for p in parts]
    n, whole, every = len(parts), max(1, len(text)), sum(signs)
    share = {t: tags.count(t) / n for t in set(tags)}
    nodes = []
    for k, (p, t) in enumerate(zip(parts, tags)):
        rows, size = 1 + p.strip().count("\n"), max(1, len(p))
        numbers = (1 + (len(p) - len(p.lstrip())) // 2, rows, size, 0.0, size / rows, signs[k] / size, n, share[t], every / whole, whole / n, k > 0 and tags[k - 1] == t, k + 1 < n and tags[k + 1] == t)
        nodes.append(_node(numbers, t, set()))
    return text, starts, np.stack(nodes)


def markdown_texts(md: str) -> list[Text]:
    """The Markdown without its code."""
    for a, b in reversed(code_blocks(md)):
        md = md[:a] + "\n" + md[b:]
    return [markdown_nodes(SPAN.sub(" ", md))]


def html_nodes(page: Page, chosen: list[int]) -> list[np.ndarray]:
    """Features of the chosen blocks of a page as nodes of its tree."""
    n = len(page.tag)
    size, chars, links, signs, below = [1] * n, [0] * n, list(page.link_chars), [0] * n, [0] * n
    for i in page.blocks:
        s = "".join(page.text[i])
        chars[i], signs[i] = len(s), len(SIGNS.findall(s))
    kin: dict[tuple[int, str], int] = {}
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = page.parent[i]
        size[up] += size[i]
        chars[up] += chars[i]
        links[up] += links[i]
        signs[up] += signs[i]
        below[up] += 1
        kin[up, page.tag[i]] = kin.get((up, page.tag[i]), 0) + 1
    last: dict[int, str] = {}
    before, after = [""] * n, [""] * n
    for i in range(1, n):
        before[i] = last.get(page.parent[i], "")
        last[page.parent[i]] = page.tag[i]
    last = {}
    for i in range(n - 1, 0, -1):
        after[i] = last.get(page.parent[i], "")
        last[page.parent[i]] = page.tag[i]
    out = []
    for i in chosen:
        up, tag, tokens, j = max(0, page.parent[i]), page.tag[i], set(), i
        while j > 0:
            for m in ATTR.finditer(page.attrs[j]):
                if m[1].lower() in ("class", "id", "role"):
                    tokens.update(re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower()))
            j = page.parent[j]
        c, of = max(1, chars[i]), max(1, chars[up])
        numbers = (page.depth[i], size[i], c, links[i] / c, c / size[i], signs[i] / c, below[up], kin.get((up, tag), 1) / max(1, below[up]), signs[up] / of, of / size[up], before[i] == tag, after[i] == tag)
        out.append(_node(numbers, tag, tokens))
    return out


def html_texts(page: Page) -> list[Text]:
    """What the blocks of a page show outside code samples."""
    chosen, texts = [], []
    for i in page.blocks:
        if page.tag[i] not in ("pre", "code", "textarea"):
            s = "".join(page.text[i]).replace(CELL, " ")
            if SIGNS.search(s) or "''" in s:
                chosen.append(i)
                texts.append(SAMPLE.sub(" ", s))
    return [(t, [0], v[None]) for t, v in zip(texts, html_nodes(page, chosen))] if chosen else []


def label(docs: list[list[Text]], is_html: bool) -> list[list[tuple[str, list, list[int]]]]:
    """For each document and text: its pieces and their labels. One evaluation for all."""
    found = [[pieces(t[0]) for t in texts] for texts in docs]
    parts = [describe(t, f, is_html) for texts, fs in zip(docs, found) for t, f in zip(texts, fs) if f]
    odds = gbt.scores(model(), np.concatenate(parts)) if parts else np.zeros((0, len(KINDS)))
    out, at = [], 0
    for texts, fs in zip(docs, found):
        doc = []
        for t, f in zip(texts, fs):
            doc.append((t[0], f, decode(f, odds[at : at + len(f)], 0 if is_html else 1 + KINDS.index("markdown"))))
            at += len(f)
        out.append(doc)
    return out


def kinds(doc: list[tuple[str, list, list[int]]], own: str) -> set[str]:
    """Kinds of markup in a labelled document, but for its own."""
    return {KINDS[x - 1] for _, _, labels in doc for x in labels if x} - {own}


SAMPLE_TAGS = frozenset(("code", "kbd", "samp", "tt"))
BREAKS = frozenset("br p div table ul ol hr blockquote section article h1 h2 h3 h4 h5 h6".split())


def table(rows: list[list[str]], headed: bool) -> str:
    """Rows of cells, the first set off where it is a head."""
    lines = ["| " + " | ".join(" ".join(c.split()) for c in r) + " |" for r in rows if r]
    if headed and lines:
        lines.insert(1, "|" + " --- |" * len(rows[0]))
    return "\n".join(lines)


def _plain(s: str, form: str, kind: str) -> str:
    """What a piece of markup stands for, in plain text."""
    if kind == "html":
        if form == "entity":
            return unescape(s).replace("\xa0", " ")
        if form == "comment":
            return ""
        name = re.match(r"</?\s*([a-zA-Z0-9]+)", s)
        tag = name[1].lower() if name else ""
        alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", s)
        if alt:
            return alt[1] or alt[2] or ""
        if tag in ("tr", "td", "th"):  # a row of cells
            return ("\n" if tag == "tr" else " |") if s.startswith("</") else "\n|" if tag == "tr" else " "
        if s.startswith("</"):
            return "`" if tag in SAMPLE_TAGS else "\n```\n" if tag == "pre" else "\n" if tag in BREAKS else ""
        if tag == "li":
            return "\n- "
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            return "\n" + "#" * int(tag[1]) + " "
        return "`" if tag in SAMPLE_TAGS else "\n```\n" if tag == "pre" else "\n" if tag in BREAKS else ""
    if kind == "wiki":
        if form == "double":
            inner = s[2:-2]
            if re.match(r"(?i)(category|kategorie|catégorie|categoría)\s*:", inner):
                return ""
            return inner.split("|")[-1]
        if form == "outside":
            return s[1:-1].partition(" ")[2]
        if form == "quotes":
            return s.strip("'")
        if form == "equals":
            level = len(s.strip()) - len(s.strip().lstrip("="))
            return "#" * level + " " + s.strip().strip("=").strip()
        if form == "wikitable":
            rows = [r for r in re.split(r"\n\|-[^\n]*", s[2:-2].partition("\n")[2]) if r.strip()]
            cells = [[c.strip() for c in re.split(r"\n[!|]|\|\||!!", "\n" + r.strip())[1:]] for r in rows]
            return table(cells, rows[0].lstrip().startswith("!") if rows else False)
        return ""
    if kind == "latex":
        if form == "environment":
            name = s[7 : s.index("}")].rstrip("*")
            inner = s[s.index("}") + 1 : s.rindex("\\end")].strip()
            if name in ("itemize", "enumerate", "description"):
                items = re.split(r"\\item(?![a-zA-Z])(?:\[[^\]]*\])?", inner)[1:]
                return "\n" + "\n".join((f"{k}. " if name == "enumerate" else "- ") + " ".join(x.split()) for k, x in enumerate(items, 1)) + "\n"
            if name in ("verbatim", "lstlisting"):
                return f"\n```\n{inner}\n```\n"
            if name in ("tabular", "array", "longtable") and "&" in inner:
                rows = [r for r in re.split(r"\\\\|\\(?:hline|toprule|midrule|bottomrule)", re.sub(r"^(?:\[[^\]]*\])?\{[^{}]*\}", "", inner)) if r.strip()]
                return "\n" + table([[c.strip() for c in r.split("&")] for r in rows], False) + "\n"
            if name in ("center", "quote", "abstract", "document", "figure"):
                return inner
        if form in ("display", "square", "environment"):
            body = re.sub(r"^(?:\$\$|\\\[|\\begin\{[^}]*\})|(?:\$\$|\\\]|\\end\{[^}]*\})$", "", s).strip()
            return f"$${body}$$"
        if form in ("dollar", "paren"):
            return "$" + re.sub(r"^(?:\$|\\\()|(?:\$|\\\))$", "", s).strip() + "$"
        m = re.match(r"\\([a-zA-Z]+)\*?(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", s)
        if m and m[1] in ("section", "subsection", "subsubsection", "chapter", "paragraph"):
            return "\n## " + (m[2] or "") + "\n"
        return "" if m and m[1] in ("cite", "ref", "label", "citep", "citet", "pageref", "footnote") else (m[2] or "") if m else s
    if form == "image":
        return s[2 : s.index("]")]
    if form == "link":
        return s[1 : s.index("]")]
    if form in ("strong", "strike", "star"):
        return s.strip("*~_")
    return s


#: Environments that are no formulas.
PROSE = re.compile(r"\\begin\{(?:itemize|enumerate|description|tabular|longtable|center|quote|abstract|document|figure)\*?\}")


PARTS = re.compile(r"\\(?:begin|end|item|hline|toprule|midrule|bottomrule)(?![a-zA-Z])")


def clean(text: str, found: list[tuple[str, int, int, int]], labels: list[int]) -> str:
    """The text with its pieces of markup put plainly, those within others first."""
    below: dict[int, list[int]] = {}
    held = [False] * len(found)  # within a formula, which keeps its commands
    for k, (_, _, _, up) in enumerate(found):
        held[k] = up >= 0 and (held[up] or found[up][0] in FORMULAS and (found[up][0] != "environment" or not PROSE.match(text, found[up][1])))
    for k, x in enumerate(labels):
        if x and not held[k]:
            up = found[k][3]
            if up >= 0 and found[up][0] == "environment" and PARTS.match(text, found[k][1]):  # read with the environment
                continue
            while up >= 0 and not labels[up]:
                up = found[up][3]
            below.setdefault(up, []).append(k)

    def put(lo: int, hi: int, of: int) -> str:
        out, at = [], lo
        for k in sorted(below.get(of, ()), key=lambda k: (found[k][1], -found[k][2])):
            form, a, b, _ = found[k]
            if a >= at and b <= hi:
                out += [text[at:a], _plain(put(a, b, k), form, KINDS[labels[k] - 1])]
                at = b
        return "".join(out) + text[at:hi]

    return put(0, len(text), -1)


BLANKS = re.compile(r"[^\S\n\x1c-\x1f]+")


def tidy(text: str) -> str:
    """Single spaces and at most one blank line, at either end none; lists keep their indents."""
    out, in_list = [], False
    for line in text.split("\n"):
        flat = BLANKS.sub(" ", line).strip(" ")
        entry = ENTRY.match(line) is not None
        set_in = line[:1] in (" ", "\t")
        in_list = flat != "" and (entry or (in_list and set_in)) or (flat == "" and in_list)
        out.append(re.match(r"[ \t]*", line)[0] + flat if flat and in_list and set_in else flat)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def _hide(text: str, samples: list[str], pattern: re.Pattern) -> str:
    """The text with its inline code put aside, each sample named by its number."""

    def name(m: re.Match) -> str:
        samples.append(m[0])
        return f"{CODE_ON}{len(samples) - 1}{CODE_OFF}"

    return pattern.sub(name, text)


def _show(text: str, samples: list[str]) -> str:
    return re.sub(f"{CODE_ON}([0-9]+){CODE_OFF}", lambda m: samples[int(m[1])], text)


def render_all(steps: list[Generator], is_html: bool) -> list[str]:
    """The texts of several renderings; the pieces of all are labelled by one evaluation of the trees."""
    asked = [next(g) for g in steps]
    done = label([doc for docs in asked for doc in docs], is_html)
    out, at = [], 0
    for g, docs in zip(steps, asked):
        try:
            g.send(done[at : at + len(docs)])
        except StopIteration as end:
            out.append(end.value)
        at += len(docs)
    return out


def render_markdown(md: str) -> str:
    """Clean text of Markdown: headings, lists, tables, code and formulas keep their signs."""
    return render_all([markdown_steps(md)], False)[0]


def render_page(page: Page) -> str:
    """Clean text of a page: headings, lists, tables, code and formulas are shown by signs."""
    return render_all([page_steps(page)], True)[0]


def markdown_steps(md: str) -> Generator:
    """Asks for the labels of its texts and returns the clean text."""
    md = re.sub("[\x1d-\x1f]", " ", md)
    out, at, samples = [], 0, []
    spans = code_blocks(md)
    prose = []
    for a, b in [*spans, (len(md), len(md))]:
        prose.append(_hide(md[at:a], samples, SPAN))
        at = b
    done = yield [[markdown_nodes(p)] for p in prose]
    for k, doc in enumerate(done):
        out += [_show(tidy(clean(*t)), samples) for t in doc]
        if k < len(spans):
            out.append(md[spans[k][0] : spans[k][1]].strip("\n"))
    return "\n\n".join(x for x in out if x.strip())


def _entries(page: Page) -> dict[int, tuple[str, int]]:
    """For each block in a list, its mark ('' where it continues an entry) and depth."""
    out: dict[int, tuple[str, int]] = {}
    number: dict[int, int] = {}
    ranks: dict[int, int] = {}
    begun = set()
    for i, t in enumerate(page.tag):
        if t in ("li", "dt", "dd"):
            up = page.parent[i]
            ranks[i] = number[up] = number.get(up, 0) + 1
    for i in page.blocks:
        j = i
        while j > 0 and j not in ranks and page.tag[j] not in ("td", "th"):
            j = page.parent[j]
        if j in ranks:
            depth, k = 0, page.parent[j]
            while k > 0:
                depth += page.tag[k] in ("ul", "ol", "dl")
                k = page.parent[k]
            mark = "" if j in begun else f"{ranks[j]}. " if page.tag[page.parent[j]] == "ol" else "- "
            begun.add(j)
            out[i] = (mark, max(0, depth - 1))
    return out


def page_steps(page: Page) -> Generator:
    """Asks for the labels of its texts and returns the clean text."""
    samples: list[str] = []
    chosen, texts, where = [], [], {}
    for i in page.blocks:
        if page.tag[i] in ("pre", "code"):
            continue
        s = "".join(page.text[i])
        # Each cell of a table row is a text of its own; what is before the first counts only if it shows something.
        cells = s.split(CELL) if page.tag[i] == "tr" else [s.replace(CELL, " ")]
        cells = cells[1:] if len(cells) > 1 and not cells[0].strip() else cells
        where[i] = (len(texts), len(texts) + len(cells))
        chosen += [i] * len(cells)
        texts += [_hide(c, samples, SAMPLE) for c in cells]
    samples = ["`" + " ".join(x.strip(CODE_ON + CODE_OFF).split()) + "`" for x in samples]
    # Only texts with signs of markup can have pieces, and need the features of their nodes.
    signed = [k for k, t in enumerate(texts) if SIGNS.search(t) or "''" in t]
    docs = [(texts[k], [0], v[None]) for k, v in zip(signed, html_nodes(page, [chosen[k] for k in signed]))] if signed else []
    labelled = dict(zip(signed, (yield [docs])[0]))
    done = [_show(tidy(clean(*labelled[k]) if k in labelled else t), samples) for k, t in enumerate(texts)]
    entries = _entries(page)
    heads = {page.parent[i] for i, t in enumerate(page.tag) if t == "th"} - {page.parent[i] for i, t in enumerate(page.tag) if t == "td"}
    out: list[str] = []
    kinds_: list[str] = []
    for i in page.blocks:
        tag = page.tag[i]
        mark, depth = entries.get(i, (None, 0))
        kind = "entry" if mark is not None else "row" if tag == "tr" else tag
        if tag in ("pre", "code"):
            t = "```\n" + "".join(page.text[i]).strip("\n") + "\n```"
        elif tag == "tr":
            cells = done[slice(*where[i])]
            first = not (kinds_ and kinds_[-1] == "row")
            t = table([cells], first and i in heads)
        else:
            t = done[where[i][0]].strip()
            if t and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                t = "#" * int(tag[1]) + " " + t
        if not t:
            continue
        j, quoted = i, 0
        while j > 0:
            quoted += page.tag[j] == "blockquote"
            j = page.parent[j]
        if quoted:
            t = "> " * quoted + t.replace("\n", "\n" + "> " * quoted)
        if mark is not None:
            pad = "  " * depth
            t = pad + mark + t.replace("\n", "\n" + pad + "  ") if mark else pad + "  " + t.replace("\n", "\n" + pad + "  ")
        if out:
            out.append("\n" if kind == kinds_[-1] and kind in ("entry", "row") else "\n\n")
        out.append(t)
        kinds_.append(kind)
    return "".join(out)
