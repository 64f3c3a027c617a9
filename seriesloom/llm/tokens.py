"""Token counts of texts by a public tokenizer read from a file."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default vocabulary; the path is a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def encoding(path: str):
    """Byte-level BPE from a file of ranks, read once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([len(e.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return count(text)
