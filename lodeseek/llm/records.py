"""The current records of a lexical index: one row per path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_records(docs: DataFrame) -> DataFrame:
    """(path, term_frequency, token_count, tags) of each path's row with the greatest mtime.

    A null mtime is the smallest; rows that tie are told apart by size, token
    count, tags and a hash of the map, so the choice is repeatable. Null paths
    are no records.
    """
    order = F.struct("mtime", "size", "token_count", "tags", F.xxhash64(F.map_entries("term_frequency")))
    row = F.struct("term_frequency", "token_count", "tags")
    return docs.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(row, order).alias("_r")).select("path", "_r.*")


def valid_terms(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, term, tf, token_count) and ``keep``: void entries gone, terms in lower case, frequencies added up."""
    entries = records.select("path", "token_count", *keep, F.explode("term_frequency").alias("_t", "_f"))
    entries = entries.filter((F.col("_f") >= 1) & (F.col("_t") != ""))
    return entries.groupBy("path", "token_count", *keep, F.lower("_t").alias("term")).agg(F.sum("_f").alias("tf"))
