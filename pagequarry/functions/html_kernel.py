"""One pass over an HTML document: metadata, links, sizes, main text and structure.

The tree has no implied end tags: an end tag closes the nearest open element of
its name and all within; without such an element it is dropped. Void elements
close at once, scripts and styles are raw text, character references are
decoded, and of a repeated attribute the last counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.urls import host_of, normalize

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE_RUN = re.compile(r"\s+")
WORDS = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+")
# Elements without end tag, of raw text, and those that hold no text of the page.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
RAW_TEXT = ("script", "style")
UNSEEN = frozenset("script style noscript template head".split())
CHROME = frozenset("nav footer aside form".split())
NO_STRING = frozenset("script style template rt rp".split())
# Signs of an application shell.
SHELL_IDS = frozenset(("root", "app", "__next", "__nuxt"))
FRAMEWORK_SIGNS = ("__NEXT_DATA__", "ng-version=", "data-reactroot", "__NUXT__")
MAX_LINKS = 1000
# Issues that this kernel raises.
CANONICAL_INVALID = "Canonical URL is invalid."
CANONICAL_ELSEWHERE = "Canonical points to another hostname; it was not followed."
LINKS_TRUNCATED = "Link discovery truncated at the per-page limit."

RESULT = (
    "title string, has_meta_description boolean, has_json_ld boolean, canonical_url string, has_canonical boolean, raw_text_chars long, text string, heading_levels array<int>, paragraph_count long, "
    "list_count long, table_count long, code_block_count long, internal_link_count long, external_link_count long, links array<string>, kernel_issues array<string>, js_shell boolean, "
    "word_count long, boilerplate_ratio double, parse_error string"
)
FIELDS = [f.split()[0] for f in RESULT.split(", ")]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "") for m in ATTRIBUTE.finditer(raw)}


class Tree:
    """Elements in document order; each element ends before ``end``. Texts know the element that holds them."""

    def __init__(self, html: str):
        self.name, self.raw, self.parent, self.end = ["#document"], [""], [-1], [0]
        self.texts: list[tuple[int, str]] = []
        stack, raw, pos = [0], None, 0
        for m in MARKUP.finditer(html):
            closing, name = m[1], m[2] and m[2].lower()
            if raw and not (closing and name == raw):
                continue
            self._text(stack[-1], html[pos : m.start()], raw)
            pos, raw = m.end(), None
            if name is None:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.name[stack[k]] == name:
                        for i in stack[k:]:
                            self.end[i] = len(self.name)
                        del stack[k:]
                        break
                continue
            self.name.append(name)
            self.raw.append(m[3])
            self.parent.append(stack[-1])
            self.end.append(len(self.name))
            if name not in VOID and not m[3].endswith("/"):
                stack.append(len(self.name) - 1)
                raw = name if name in RAW_TEXT else None
        self._text(stack[-1], html[pos:], raw)
        for i in stack:
            self.end[i] = len(self.name)

    def _text(self, at: int, s: str, raw: str | None) -> None:
        if s:
            self.texts.append((at, s if raw or "&" not in s else unescape(s)))

    def removed(self, gone: bytearray, roots: list[int]) -> None:
        """Mark the elements under ``roots``."""
        for i in roots:
            gone[i : self.end[i]] = b"\x01" * (self.end[i] - i)

    def strings(self, gone: bytearray, root: int = 0) -> list[str]:
        end = self.end[root]
        return [s for at, s in self.texts if root <= at < end and not gone[at] and self.name[at] not in NO_STRING]


def _joined(strings: list[str], between: str) -> str:
    return between.join(t for t in (s.strip() for s in strings) if t)


def _clean(text: str) -> str:
    lines = (SPACE_RUN.sub(" ", line).strip() for line in text.splitlines())
    return "\n".join(line for line in lines if line)


def extract(html: str, url: str = "") -> dict:
    """Everything that the audit needs of a page found at ``url``."""
    tree = Tree(html)
    names, n = tree.name, len(tree.name)
    gone = bytearray(n)
    attributes = [_attributes(r) if r and not r.isspace() else {} for r in tree.raw]
    first = lambda test: next((i for i in range(1, n) if test(i)), None)
    issues: list[str] = []

    at = first(lambda i: names[i] == "title")
    title = _joined(tree.strings(gone, at), " ")[:500] if at is not None else ""
    at = first(lambda i: names[i] == "meta" and attributes[i].get("name", "").lower() == "description")
    described = at is not None and bool(attributes[at].get("content", "").strip())
    json_ld = first(lambda i: names[i] == "script" and attributes[i].get("type") == "application/ld+json") is not None
    at = first(lambda i: names[i] == "link" and "canonical" in attributes[i].get("rel", ""))
    canonical = None
    if at is not None and attributes[at].get("href"):
        canonical = normalize(attributes[at]["href"], url or None)
        if canonical is None:
            issues.append(CANONICAL_INVALID)
        elif host_of(canonical) != host_of(url):
            issues.append(CANONICAL_ELSEWHERE)
    scripts = names.count("script")
    marked = any(a.get("id", "").lower() in SHELL_IDS for a in attributes if "id" in a)
    framed = any(s in html for s in FRAMEWORK_SIGNS)

    internal = external = 0
    links: dict[str, None] = {}
    here = host_of(url)
    hrefs = [attributes[i]["href"] for i in range(1, n) if names[i] == "a" and "href" in attributes[i]]
    for href in hrefs[: MAX_LINKS + 1]:
        target = normalize(href, url or None)
        if target is None:
            continue
        if host_of(target) == here:
            internal += 1
            if len(links) < MAX_LINKS:
                links[target] = None
        else:
            external += 1
    if internal + external > MAX_LINKS:
        issues.append(LINKS_TRUNCATED)

    tree.removed(gone, [i for i in range(1, n) if names[i] in UNSEEN])
    tree.removed(gone, [i for i in range(1, n) if "hidden" in attributes[i] or attributes[i].get("aria-hidden") == "true"])
    raw_chars = len(_clean(_joined(tree.strings(gone), "\n")))
    tree.removed(gone, [i for i in range(1, n) if names[i] in CHROME])
    for i in range(1, n):
        if not gone[i] and attributes[i].get("role") in ("dialog", "alertdialog") and "cookie" in attributes[i].get("aria-label", "").lower():
            if re.search("accept|consent|reject", " ".join(tree.strings(gone, i)).lower()):
                tree.removed(gone, [i])

    mains = [i for i in range(1, n) if not gone[i] and (names[i] in ("main", "article") or attributes[i].get("role") == "main")]
    body = first(lambda i: names[i] == "body" and not gone[i])
    main = max(mains, key=lambda i: sum(map(len, tree.strings(gone, i))), default=body or 0)
    text = _clean(_joined(tree.strings(gone, main), "\n"))
    within = [names[i] for i in range(main + 1, tree.end[main]) if not gone[i]]
    words = len(WORDS.findall(text))
    shell = words < 30 and ((marked and scripts >= 1) or (framed and scripts >= 2) or (scripts >= 5 and len(html) > 2000))
    return {
        "title": title, "has_meta_description": described, "has_json_ld": json_ld, "canonical_url": canonical, "has_canonical": canonical is not None, "raw_text_chars": raw_chars, "text": text,
        "heading_levels": [int(t[1]) for t in within if len(t) == 2 and t[0] == "h" and t[1] in "123456"], "paragraph_count": within.count("p"), "list_count": within.count("ul") + within.count("ol"),
        "table_count": within.count("table"), "code_block_count": within.count("pre"), "internal_link_count": internal, "external_link_count": external, "links": list(links), "kernel_issues": issues,
        "js_shell": shell, "word_count": words, "boilerplate_ratio": round(max(0.0, min(1.0, 1 - len(text) / max(raw_chars, 1))), 4), "parse_error": None,
    }


def extract_column(html: Column, url: Column) -> Column:
    """``extract`` in Arrow batches: a struct of RESULT, null where the html is null."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for htmls, urls in batches:
            out = []
            for h, u in zip(htmls, urls):
                try:
                    out.append(dict.fromkeys(FIELDS) if h is None else extract(h, u or ""))
                except (ValueError, RecursionError) as e:
                    out.append(dict.fromkeys(FIELDS) | {"parse_error": type(e).__name__})
            yield pd.DataFrame(out, columns=FIELDS).astype({c: "object" for c in FIELDS})

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT)(html, url)


def with_kernel(df: DataFrame, html: Column, url: Column, name: str = "k") -> DataFrame:
    return df.withColumn(name, extract_column(html, url))
