"""Exact ranks inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values a bucket may hold before it is cut into cells, and cells it is cut into.
CELL_VALUES, CELLS = 100_000, 16_384


def order_bucket(value: Column) -> Column:
    """A coarse key that never decreases with ``value`` (binary exponent and ten further bits)."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    key = (exponent + 1100) * 4096 + F.floor(size / F.pow(F.lit(2.0), exponent) * 1024)
    key = F.when(size == float("inf"), F.lit(1 << 40)).otherwise(key.cast("bigint"))
    return F.when(value == 0, F.lit(0)).when(value > 0, key).otherwise(-key).cast("bigint")


def competition_rank(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Add ``out`` = 1 + number of rows of the group with a strictly greater ``value``.

    Null and NaN values are missing: they get a null rank and count for nobody.
    Equal values share a rank. Groups are null-safe.

    Rows are first reduced to distinct values with their counts, values fall
    into order-preserving buckets, and a value's rank is the size of the greater
    buckets plus its place inside its own bucket, so even a group that holds
    most of the rows is spread over many tasks. A bucket with very many distinct
    values (scores with a large offset lie in few) is cut once more, into equal
    cells between its own least and greatest value.
    """
    valid = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = (
        df.filter(valid)
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", order_bucket(F.col(value).cast("double")))
    )
    number = F.col(value).cast("double")
    buckets = counts.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_d"), F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    crowded = buckets.filter((F.col("_d") > CELL_VALUES) & (F.col("_hi") > F.col("_lo"))).drop("_d")  # at most all values / CELL_VALUES
    cell = F.floor((number - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS)
    counts = _join(counts, F.broadcast(crowded), [*group, "_b"], "left").withColumn("_c", F.coalesce(cell, F.lit(0)).cast("bigint")).drop("_lo", "_hi")
    before = Window.unboundedPreceding, -1
    offsets = (
        counts.groupBy(*group, "_b", "_c")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_off", F.coalesce(F.sum("_bn").over(Window.partitionBy(*group).orderBy(F.desc("_b"), F.desc("_c")).rowsBetween(*before)), F.lit(0)))
        .drop("_bn")
    )
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*group, "_b", "_c").orderBy(F.desc(value)).rowsBetween(*before)), F.lit(0))
    placed = counts.withColumn("_in", inside)
    ranks = _join(placed, offsets, [*group, "_b", "_c"], "inner").withColumn(out, (F.lit(1) + F.col("_off") + F.col("_in")).cast("bigint")).select(*group, value, out)
    # Missing values match nothing; a salt keeps them from meeting in one task.
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.when(valid, F.lit(0)).otherwise(F.pmod(F.xxhash64(*hashed), F.lit(64)) + 1).cast("int")
    return _join(df.withColumn("_salt", salt), ranks.withColumn("_salt", F.lit(0)), [*group, value, "_salt"], "left").drop("_salt")


def spread_number(df: DataFrame, group: list[str], key: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in an arbitrary but repeatable order.

    A group is cut into hashed buckets by ``key``; a row's number is the size of
    the buckets before its own plus its place inside it.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    offsets = (
        df.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    numbered = df.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*key)) - 1)
    return _join(numbered, offsets, [*group, "_b"], "inner").withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_b", "_off", "_in")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the left side's columns once."""
    renamed = right.select([F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in keys])
