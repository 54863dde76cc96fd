"""Sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("PAPYRA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """f(texts) -> lists of token ids; .tiktoken rank files, .json and .model vocabularies."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_ordinary(x) for x in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [x.ids for x in t.encode_batch(list(texts), add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: s.encode(list(texts), num_threads=1)


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; null text: null, empty text: 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            sizes = encoder(path)([x if isinstance(x, str) else "" for x in b])
            yield pd.Series([len(n) if isinstance(x, str) else None for x, n in zip(b, sizes)], dtype="Int64")

    return count(text)
