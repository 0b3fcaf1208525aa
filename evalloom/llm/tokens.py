"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rank file of byte-level BPE; any other path with the same layout works.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column; null for null. Special tokens' strings count as ordinary text."""

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in texts:
            yield pd.Series([None if t is None else len(encode(t)) for t in batch], dtype="Int32")

    return count(text)


def source_name(column: str | Column) -> Column:
    """A source's name however spelled: small letters, blanks around dropped, blanks and hyphens as underscores."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")
