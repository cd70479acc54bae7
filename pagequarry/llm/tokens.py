"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of ranks (token in base64, rank). It lies outside the repository, at the same place on every executor.
TOKENIZER = os.environ.get("PAGEQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits text before the merges of the rank files (fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*batch.schema.names[:-1], "tokens"])

    return run


def token_counts(docs: DataFrame, columns: dict[str, str], text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns named (with their types) and the number of tokens of each text; 0 where it is null."""
    chosen = docs.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()], F.col(text_col).cast("string").alias("_text"))
    return chosen.mapInArrow(_count(tokenizer), ", ".join(f"{c} {t}" for c, t in columns.items()) + ", tokens long")
