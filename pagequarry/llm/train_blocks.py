"""Fits the block classifier of problem 5 on pages whose layout labels its own parts.

    python -m pagequarry.llm.train_blocks /root/testdata/sf0.1

Pages that name their containers (class="nav", "foot", ...), or use the elements
made for it, label most of their blocks; these names are no features, so what is
learned holds for pages that name nothing. At most ``SAMPLE`` such pages, those
with the least hash of their id, are used; a fifth of them is held out.
"""

from __future__ import annotations

import json
import sys
import zlib

import numpy as np

from pagequarry.llm import blocks
from pagequarry.llm.dom import Page, parse

SAMPLE = 3000
LEAST_COUNT = 4
#: Names of containers that hold no part of the body.
ASIDE = frozenset("foot nav related side cookie news crumb login comment share".split())
ROUNDS, RATE, DECAY = 300, 0.05, 2e-5


def labels(page: Page, items: list[int]) -> list[int | None]:
    """1 for the body, 0 for the rest, None where the layout does not tell."""
    classes = [page.get(i, "class") for i in range(len(page.tag))]
    parents = [page.parent[i] for i in items]
    named = "nav" in classes or "foot" in classes
    out: list[int | None] = []
    for i in items:
        y: int | None = None
        chain = []
        j = page.parent[i]
        while j > 0:
            chain.append(j)
            j = page.parent[j]
        if named:
            y = 0 if any(classes[j] in ASIDE for j in chain) else 1
        else:
            tags = [page.tag[j] for j in chain]
            body = next((k for k, j in enumerate(chain) if page.tag[j] in ("main", "article", "section") or page.get(j, "role") == "main"), None)
            lone = "aside" in tags and sum(chain[tags.index("aside")] == j for j in parents) == 1  # a note
            if body is None and {"nav", "footer", "form", "aside"} & set(tags) and not lone:
                y = 0
            elif body is not None and set(tags[:body]) <= {"ul", "ol", "table", "tbody", "tr"}:
                y = 1
        out.append(y)
    return out


def fit(names: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Logistic regression by Adam over the features that occur ``LEAST_COUNT`` times."""
    counts: dict[str, int] = {}
    for fs in names:
        for f in fs:
            counts[f] = counts.get(f, 0) + 1
    index = {f: k for k, f in enumerate(f for f, c in counts.items() if c >= LEAST_COUNT)}
    rows = np.concatenate([np.full(sum(f in index for f in fs), r) for r, fs in enumerate(names)])
    cols = np.array([index[f] for fs in names for f in fs if f in index])
    w, m, v = np.zeros(len(index)), np.zeros(len(index)), np.zeros(len(index))
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.bincount(rows, w[cols], len(y))))
        g = np.bincount(cols, (p - y)[rows], len(index)) / len(y) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {f: round(float(w[k]), 2) for f, k in sorted(index.items()) if abs(w[k]) >= 0.05}


def main(folder: str) -> None:
    import duckdb

    rows = duckdb.sql(f"SELECT row_id, html FROM '{folder}/dataset_rows.parquet' WHERE html <> ''").fetchall()
    pages = []
    for r, h in sorted(rows, key=lambda x: zlib.crc32(str(x[0]).encode())):
        page = parse(h)
        items, names = blocks.features(page)
        ys = labels(page, items)
        if any(y is not None for y in ys):
            pages.append((page, [(f, y) for f, y in zip(names, ys) if y is not None], items, ys))
        if len(pages) == SAMPLE:
            break
    cut = len(pages) * 4 // 5
    train = [x for _, p, _, _ in pages[:cut] for x in p]
    model = fit([f for f, _ in train], np.array([y for _, y in train], float))
    blocks.MODEL.write_text(json.dumps(model, indent=0, ensure_ascii=False, separators=(",", ":")))
    blocks.weights.cache_clear()
    alone = flow = total = 0
    for page, _, items, ys in pages[cut:]:
        _, scores, body = blocks.classify(page)
        for i, s, b, y in zip(items, scores, body, ys):
            if y is not None:
                total += 1
                alone += (s > 0) != bool(y)
                flow += b != bool(y)
                if b != bool(y):
                    print("   wrong", y, page.tag[i], page.string(i)[:90])
    print(f"{len(pages)} pages, {len(train)} blocks, {len(model)} weights; held out {total} blocks: {alone} wrong by the classifier, {flow} after the cut")


if __name__ == "__main__":
    main(sys.argv[1])
