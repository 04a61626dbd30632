"""Numbers of tokens of texts under a public tokenizer, whose files lie outside the repository."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``documents`` with ``tokens``, the number of tokens of the whole ``text``; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = encoder(path)
        for texts in batches:
            yield texts.map(lambda t: len(tokenizer.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int64")

    return documents.withColumn("tokens", count(F.col(text)))
