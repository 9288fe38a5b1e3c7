"""Joins of many rows with one or few rows per key, where some keys hold most of the rows, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may meet in one task.
LOAD = 100_000


#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with the hint to broadcast it where it has no more than ``rows`` rows, else as it is; counted, so ``df`` should be stored or small to make."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(counts: DataFrame, keys: list[str], n: str, load: int | None = None) -> DataFrame:
    """(keys, _salts): the keys of ``counts`` with more than ``load`` rows.

    There are at most as many as all rows divided by ``load``, which bounds the broadcast of them.
    """
    load = load or LOAD
    return counts.filter(F.col(n) > load).select(*keys, F.ceil(F.col(n) / load).cast("bigint").alias("_salts"))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on ``keys``; the rows of a hot key are cut by a hash of ``by``, and its rows in ``few`` repeated for each cut."""
    salts = F.coalesce("_salts", F.lit(1)).cast("bigint")
    cut = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts)).drop("_salts")
    copies = few.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")
    return cut.join(copies, [*keys, "_salt"]).drop("_salt")
