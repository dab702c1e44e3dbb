"""Sizing texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.common import cut, spread

#: A byte-level vocabulary as ranks; any other such file may be given instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this family splits text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of each whole text; 0 for null and empty texts.

    The texts are read and encoded once: the result is written to the shared folder, a few bytes a document.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return cut(spread(documents.select(*keep, "text")).select(*keep, count("text").alias("tokens")))
