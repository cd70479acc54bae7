"""A small, fast reader of HTML for the page operators.

``parse`` gives the elements of a page in document order, as parallel lists,
with implied end tags for paragraphs, list entries and table parts, and its
blocks: the elements around the smallest self-contained runs of shown text.
Comments, declarations, scripts, styles, templates and the head (but for the
title) hold no text. Malformed markup never raises: a stray ``<`` is text, an
end tag without its start is dropped, and open elements end with the page.

What is a block follows from the tree alone:

- a heading, paragraph, list entry or other element made for text, with the
  inline elements in it; blocks nested in it (a list in a list entry) are their own;
- a table row whose cells hold no further blocks, and preformatted text, whole;
- any other element with words of its own, with the inline elements in it;
- where a container holds inline elements but no words between them (a menu, a
  trail of links), each of these.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NID = re.compile(r"data-nid\s*=\s*[\"']?(\d+)")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template title noscript".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol"), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
CLOSED_BY = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements made for text: the inline elements in them are no blocks.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd figcaption caption legend summary address option button".split())
CELLS = frozenset(("td", "th"))
SAMPLES = frozenset(("code", "kbd", "samp", "tt"))
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w")
#: Stand in the text of a block: before each cell of a row, and around an inline code sample.
CELL, CODE_ON, CODE_OFF = "\x1f", "\x1d", "\x1e"
_MARKS = str.maketrans("", "", CODE_ON + CODE_OFF)
_CONTROL = re.compile("[\x1d-\x1f]")
SAMPLE = re.compile(f"{CODE_ON}[^{CODE_OFF}]*+(?:{CODE_OFF}|\\Z)")


class Page:
    """The elements of a page: parallel lists over elements in document order. ``blocks`` are those that own shown text."""

    __slots__ = ("tag", "attrs", "parent", "depth", "nid", "text", "link_chars", "title", "noscript", "scripts", "blocks", "owner")

    def __init__(self):
        self.tag, self.attrs, self.parent, self.depth, self.nid = ["#page"], [""], [-1], [0], [0]
        self.text: list[list[str]] = []
        self.link_chars: list[int] = []
        self.blocks: list[int] = []
        self.owner: list[int] = []
        self.title, self.noscript, self.scripts = "", [], 0

    def string(self, i: int) -> str:
        """What block ``i`` shows."""
        return SPACE.sub(" ", "".join(self.text[i]).translate(_MARKS)).strip()

    def prose(self, i: int) -> str:
        """What block ``i`` shows outside its code samples."""
        s = "".join(self.text[i])
        return SPACE.sub(" ", SAMPLE.sub(" ", s) if CODE_ON in s else s).strip()

    def get(self, i: int, name: str) -> str:
        for m in ATTR.finditer(self.attrs[i]):
            if m[1].lower() == name:
                return m[2] or m[3] or m[4] or ""
        return ""


def parse(html: str) -> Page:
    """Elements and blocks of ``html``."""
    if _CONTROL.search(html):
        html = _CONTROL.sub(" ", html)
    page = Page()
    tag, attrs, parent, depth, nid = page.tag, page.attrs, page.parent, page.depth, page.nid
    runs: list[tuple[int, str]] = []  # (element, text that stands directly in it), in order
    stack = [0]
    raw = ""
    raw_parts: list[str] = []
    pos = 0

    def close(k: int) -> None:
        for i in reversed(stack[k:]):
            if tag[i] in SAMPLES:
                runs.append((i, CODE_OFF))
        del stack[k:]

    for m in TOKEN.finditer(html):
        start = m.start()
        if start > pos:
            piece = html[pos:start]
            if raw:
                raw_parts.append(piece)
            else:
                runs.append((stack[-1], unescape(piece) if "&" in piece else piece))
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if raw:
            if m[1] and name == raw:
                if raw == "title":
                    page.title = page.title or unescape("".join(raw_parts))
                elif raw == "noscript":
                    page.noscript.append(unescape("".join(raw_parts)))
                raw = ""
            else:
                raw_parts.append(m[0] if raw != "noscript" else " ")
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == name:
                    close(k)
                    break
            continue
        if name in RAW:
            if name == "script":
                page.scripts += 1
            if not m[0].endswith("/>"):
                raw, raw_parts = name, []
            continue
        if name in CLOSES_P or name in CLOSED_BY:
            closes = ("p",) if name in CLOSES_P else CLOSED_BY[name]
            stop = SAME.get(name, ("div", "section", "article", "main", "td", "body"))
            for k in range(len(stack) - 1, 0, -1):
                t = tag[stack[k]]
                if t in closes:
                    close(k)
                    if len(closes) == 1 or t == closes[0]:
                        break
                elif t in stop:
                    break
        if name in VOID:
            runs.append((stack[-1], "\n" if name in ("br", "hr") else " "))
            continue
        a = m[3]
        up = stack[-1]
        n = NID.search(a) if "data-nid" in a else None
        i = len(tag)
        tag.append(name)
        attrs.append(a)
        parent.append(up)
        depth.append(depth[up] + 1)
        nid.append(int(n[1]) if n else 0)
        if name in SAMPLES:
            runs.append((i, CODE_ON))
        elif name not in INLINE:
            runs.append((i, CELL if name in CELLS else ""))  # "" is where an element begins
        if m[0].endswith("/>") and name not in ("a", "p", "div", "span"):
            if name in SAMPLES:
                runs.append((i, CODE_OFF))
            continue
        stack.append(i)
    if pos < len(html) and not raw:
        runs.append((stack[-1], unescape(html[pos:])))
    _blocks(page, runs)
    return page


def _blocks(page: Page, runs: list[tuple[int, str]]) -> None:
    """Find the element that owns each run of text, and so the blocks."""
    tag, parent = page.tag, page.parent
    n = len(tag)
    deep, rich, worded = bytearray(n), bytearray(n), bytearray(n)
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = parent[i]
        if deep[i] or tag[i] not in INLINE:
            deep[up] = 1
        if rich[i] or not (tag[i] in INLINE or tag[i] in CELLS):
            rich[up] = 1
    for i, s in runs:
        if not worded[i] and WORD.search(s):
            worded[i] = 1
    owner, sealed, linked = list(range(n)), bytearray(n), bytearray(n)
    for i in range(1, n):
        up, t = parent[i], tag[i]
        linked[i] = linked[up] or t == "a"
        if sealed[up]:
            owner[i], sealed[i] = owner[up], 1
        elif t in INLINE:
            if not deep[i]:
                sealed[i] = 1
                if tag[up] in TEXTUAL or worded[up]:
                    owner[i] = owner[up]
        else:
            sealed[i] = t == "pre" or (t == "tr" and not rich[i]) or (t in TEXTUAL and not deep[i])
    text: list[list[str]] = [[] for _ in range(n)]
    link_chars = [0] * n
    shown = bytearray(n)
    for i, s in runs:
        at = owner[i]
        if s in (CODE_ON, CODE_OFF) and tag[at] in ("pre", "code"):
            continue
        if not s:
            if at == i:
                continue
            s = "\n" if tag[at] == "pre" else " "
        text[at].append(s)
        if not s.isspace() and s not in (CODE_ON, CODE_OFF):
            if worded[i] or tag[at] in TEXTUAL or tag[at] in INLINE or tag[at] in ("pre", "tr"):  # signs between blocks are none
                shown[at] = 1
            if linked[i]:
                link_chars[at] += len(s.strip())
    page.text, page.link_chars, page.owner = text, link_chars, owner
    page.blocks = [i for i in range(n) if shown[i]]
