"""Problem 5: the main body of a page, by minimum-cut labelling of its blocks.

Blocks are the elements of the page that own shown text (``dom``); ids that the
elements may carry (``data-nid``) only name them in results. A logistic
classifier over text, tag, length, links and container gives each block a cost
for either label; these costs are the terminal capacities of a graph in which
blocks are tied to their neighbours and to their containers. The minimum cut,
found by maximum flow, is the labelling.

Defined results: null, empty and block-less pages give no rows. Markup never
raises. An id stands for the block its element belongs to; an element that
holds several blocks does not belong to the body if none of them does, one
without shown text if the container it stands in has no block of the body.
Repeated ids of one page are reported once each.
"""

from __future__ import annotations

import json
import re
from collections import deque
from functools import lru_cache
from pathlib import Path

from pagequarry.llm.dom import Page

MODEL = Path(__file__).parent / "models" / "blocks.json"
#: Strength of the ties between adjacent blocks, of a block and its container, of nested containers.
ADJACENT, PROXIMITY, NESTED = 0.5, 0.6, 0.15
CLIP = 8.0
WORD = re.compile(r"[^\W\d_]+|\d+|[©›|/&]")
SEMANTIC = frozenset("nav footer aside form main article section header td".split())


def _bucket(n: int) -> str:
    for k, top in enumerate((0, 1, 2, 4, 8, 15, 30, 80)):
        if n <= top:
            return str(k)
    return "9"


def _words(s: str) -> list[str]:
    """Words with numbers as 0 and names as N (a capital inside the text)."""
    out = []
    for w in WORD.findall(s):
        if w[0].isdigit():
            out.append("0")
        elif out and w[0].isupper() and w[1:].islower():
            out.append("N")
        else:
            out.append(w.lower())
    return out


def _share(x: float) -> str:
    return "0" if x <= 0.02 else "1" if x < 0.5 else "2" if x < 0.95 else "3"


def features(page: Page) -> tuple[list[int], list[list[str]]]:
    """The blocks, and the names of the features that each has."""
    items = page.blocks
    if not items:
        return items, []
    strings = [page.string(i) for i in items]
    words = [_words(s) for s in strings]
    tags = [page.tag[i] for i in items]
    box = []
    for i in items:
        j = page.parent[i]
        while j > 0 and page.tag[j] in ("ul", "ol", "tbody", "table", "tr", "span"):
            j = page.parent[j]
        box.append(j)
    dense = [min(1.0, page.link_chars[i] / max(1, len(s))) if page.tag[i] != "a" else 1.0 for i, s in zip(items, strings)]
    by_box: dict[int, list[int]] = {}
    for k, b in enumerate(box):
        by_box.setdefault(b, []).append(k)
    info = {}
    place_of = {k: at for ks in by_box.values() for at, k in enumerate(ks)}
    for b, ks in by_box.items():
        mean = sum(len(words[k]) for k in ks) // len(ks)
        links = sum(dense[k] for k in ks) / len(ks)
        stops = sum(strings[k][-1:] in ".!?。" for k in ks) / len(ks)
        sem = []
        j = b
        while j > 0:
            if page.tag[j] in SEMANTIC:
                sem.append(page.tag[j])
            j = page.parent[j]
        if page.tag[b] == "div" and page.get(b, "role") == "main":
            sem.append("main")
        info[b] = [
            f"Cn{_bucket(len(ks))}", f"Cw{_bucket(mean)}l{_share(links)}", f"Cs{_share(stops)}w{_bucket(mean)}", f"Ct{page.tag[b]}",
            "Ch" + ",".join(sorted({tags[k] for k in ks})), *[f"A{x}" for x in set(sem)],
        ]
    head = next((k for k, t in enumerate(tags) if t == "h1"), None)
    home = box[head] if head is not None else -1
    title = page.title.strip()
    out = []
    for k, i in enumerate(items):
        w, t, s = words[k], tags[k], strings[k]
        n = len(w)
        end = s[-1:] if s[-1:] in ".!?:。›/" else "-"
        j, inside = box[k], False
        while j > 0:
            if j == home:
                inside = True
                break
            j = page.parent[j]
        place = "same" if box[k] == home else "under" if inside else "out" if head is not None else "none"
        f = [
            "bias", f"T{t}", f"T{t}<{page.tag[page.parent[i]]}", f"L{_bucket(n)}", f"L{_bucket(n)}{t}", f"E{end}{_bucket(n)}", f"K{_share(dense[k])}{t}",
            f"H{place}", f"H{place}{t}", f"O{place}{'<' if head is not None and k < head else '>'}",
        ]
        f += ["W" + x for x in set(w)]
        f += [f"B{a} {b}" for a, b in zip(w[:4], w[1:5])]
        if w:
            f += [f"F{t}{w[0]}", f"Z{w[-1]}"]
        f += info[box[k]]
        ks = by_box[box[k]]
        at = place_of[k]
        f.append(f"P{tags[ks[at - 1]]}{_bucket(len(words[ks[at - 1]]))}{t}" if at else f"P-{t}")
        if at:
            first = words[ks[0]]
            f.append("G" + " ".join(first[:2]) if len(first) < 6 else "G*")
        f.append(f"N{tags[ks[at + 1]]}{t}" if at + 1 < len(ks) else f"N-{t}")
        if title and s == title:
            f.append(f"S{t}")
        out.append(f)
    return items, out


@lru_cache(1)
def weights() -> dict[str, float]:
    import pkgutil

    return json.loads(pkgutil.get_data("pagequarry.llm", "models/blocks.json"))


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the least cost: a node pays ``unary`` if False where that is positive, its
    amount if True where negative; an edge pays its weight if its ends differ.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    # A node whose own cost outweighs all its ties has its label in some least cut: contract it into its terminal.
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    reached = _source_side(rest, u, near)
    for i in rest:
        label[i] = i in reached
    return [bool(x) for x in label]


def _source_side(rest: list[int], u: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches once the flow is at its maximum (blocking flows over levels)."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
    cap[s], cap[t] = {}, {}
    for i in rest:
        if u[i] > 0:
            cap[s][i], cap[i][s] = u[i], 0.0
        elif u[i] < 0:
            cap[i][t], cap[t][i] = -u[i], 0.0
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return set(level)
        ahead = {i: [j for j in cap[i] if level.get(j) == d + 1] for i, d in level.items()}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                cut_at = len(path) - 1
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cap[a][b] <= 1e-12:
                        cut_at = k + 1
                del path[cut_at:]
                continue
            while ahead[i] and cap[i][ahead[i][-1]] <= 1e-12:
                ahead[i].pop()
            if ahead[i]:
                path.append(ahead[i][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def aside_ids(page: Page, items: list[int], body: list[bool]) -> list[int]:
    """The ids of a page whose elements do not belong to its main body."""
    out = set()
    label = dict(zip(items, body))
    rest = []
    for i, n in enumerate(page.nid):
        if n:
            own = label.get(page.owner[i])
            if own is None:
                rest.append(i)
            elif not own:
                out.add(n)
    if rest:
        held = _held(page, label)
        for i in rest:
            j = i
            while j > 0 and j not in held:
                j = page.parent[j]
            if j in held and not held[j]:
                out.add(page.nid[i])
    return sorted(out)


def _held(page: Page, label: dict[int, bool]) -> dict[int, bool]:
    """For each element that holds blocks, whether one of them belongs to the body."""
    held: dict[int, bool] = {}
    for i in range(len(page.tag) - 1, -1, -1):
        if i in label:
            held[i] = held.get(i, False) or label[i]
        if i in held and i > 0:
            up = page.parent[i]
            held[up] = held.get(up, False) or held[i]
    return held


def classify(page: Page) -> tuple[list[int], list[float], list[bool]]:
    """The blocks of a page, their scores, and whether each belongs to the body."""
    items, names = features(page)
    if not items:
        return [], [], []
    w = weights()
    get = w.get
    scores = [max(-CLIP, min(CLIP, sum([get(f, 0.0) for f in fs]))) for fs in names]
    boxes: dict[int, int] = {}
    unary = list(scores)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, i in enumerate(items):
        b = page.parent[i]
        if b not in boxes:
            boxes[b] = len(unary)
            unary.append(0.0)
        edges.append((k, boxes[b], PROXIMITY))
        if b in last:
            edges.append((last[b], k, ADJACENT))
        last[b] = k
    for b in list(boxes):
        j = page.parent[b]
        while j > 0 and j not in boxes:
            j = page.parent[j]
        if j > 0 and j in boxes:
            edges.append((boxes[b], boxes[j], NESTED))
    body = minimum_cut(unary, edges)[: len(items)]
    if not any(body) and len(boxes) == 1 and not any(page.link_chars[i] for i in items):
        body = [True] * len(items)  # a page that is one run of text has nothing beside its body
    return items, scores, body
