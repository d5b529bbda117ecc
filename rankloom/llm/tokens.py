"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this public vocabulary cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoder(path: str):
    """The tokenizer, once in each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text))


def token_counts(docs: DataFrame, *, id: str, text: str, keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:  # noqa: A002
    """``(id, *keep, n_tokens)``; a null or empty text has no token, a null id is no document."""
    rows = docs.select(F.col(id).cast("bigint").alias("id"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield b.drop(columns="text").assign(n_tokens=pd.Series([len(enc.encode_ordinary(t)) for t in b["text"]], b.index, "int64"))

    schema = "id bigint, " + "".join(f"k{i} string, " for i in range(len(keep))) + "n_tokens bigint"
    return rows.mapInPandas(count, schema).select("id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
