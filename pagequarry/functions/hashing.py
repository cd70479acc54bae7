"""Digests and similarity fingerprints of texts."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions import text
from pagequarry.functions.expr import let
from pagequarry.functions.html_kernel import WORDS

#: Words per shingle (``simhash`` zips three), and the most that one shingle weighs.
SHINGLE, MOST = 3, 3


def normalize(s: str) -> str:
    """Compatibility-composed, case-folded, with single spaces."""
    return " ".join(unicodedata.normalize("NFKC", s).casefold().split())


@lru_cache(1 << 17)
def _code(shingle: str, digest: str = "blake2b") -> bytes:
    data = shingle.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(data, digest_size=8).digest() if digest == "blake2b" else hashlib.new(digest, data).digest()[:8]


def simhash(s: str, digest: str = "blake2b") -> int:
    """64 bits of the weighted shingles of a normalized text, as a signed number; a tie gives 0."""
    words = WORDS.findall(s)
    counts = Counter(map(" ".join, zip(words, words[1:], words[2:])))
    if not counts:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join([_code(g, digest) for g in counts]), np.uint8).reshape(-1, 8), axis=1)
    weights = np.minimum(np.fromiter(counts.values(), np.float64, len(counts)), MOST)
    votes = 2 * (weights @ bits.astype(np.float64)) - weights.sum()
    return int(np.packbits(votes > 0).view(">i8")[0])


def fingerprints(content: Column, eligible: Column, digest: str = "blake2b") -> Column:
    """Struct of the normalized text's SHA-256 (``norm``) and, where eligible, its SimHash (``bits``)."""

    def run(contents: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        norms, bits = [], []
        for s, w in zip(contents, wanted):
            n = None if s is None else normalize(s)
            norms.append(None if n is None else hashlib.sha256(n.encode("utf-8", "surrogatepass")).hexdigest())
            bits.append(simhash(n, digest) if n is not None and w else None)
        return pd.DataFrame({"norm": norms, "bits": pd.array(bits, dtype="Int64")})

    return F.pandas_udf(run, "norm string, bits long")(content, eligible)


def shingles(content: Column) -> Column:
    """Runs of three words; none where there are fewer."""

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))

    return let(text.word_units(content), runs)
