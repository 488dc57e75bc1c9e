"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where tokenizer files lie unless a path is given, the default file, and the public pre-tokenization pattern that belongs to it.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str) -> Any:
    """The byte-pair encoding of a rank file; loaded once a Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of the whole text; 0 for null and for empty text. Strings of special tokens are ordinary text."""
    path = path or f"{TOKENIZERS}/{RANKS}"

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(path)
        for s in texts:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count(text)


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document."""
    return documents.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens"))
