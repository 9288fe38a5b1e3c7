"""Sizes of texts: words, or tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of letters, numbers and underscore; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def token_sizes(documents: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``size``, the text's number of tokens under a byte-level BPE rank file.

    ``vocabulary`` is the path of a ``.tiktoken`` file that every executor can read;
    null and empty texts have size 0.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            b["size"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.pop("_text")]
            yield b

    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.select(*keep).dtypes) + ", size bigint"
    return rows.mapInPandas(count, schema)
