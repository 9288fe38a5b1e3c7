"""Frequencies of values and n-grams by suffix sorting.

Every record emits the suffixes of its sequences, cut to ``sigma`` values.
Suffixes are combined and routed by ranges of their first value, and where very
many suffixes begin alike, of the values behind it: ranges are drawn so that each
has about as many suffixes, so no first value or pair is one task's. Each range is
sorted in reverse lexicographic order and reduced by a stack that holds one counter
per prefix length: a longer suffix comes before its own prefixes, so when the sort
leaves a prefix, its counts are complete. Only a prefix that a border of ranges
cuts has its counts in two or more parts, which are added up.

Record sets are kept as counts: a suffix carries how far it agrees with the
suffix before it in the same record's own sorted list. Prefixes longer than
that agreement are new to the record, shorter ones were counted with the
suffix before, so adding "new" marks gives the size of each record set exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.runtime import shuffle_partitions


def suffix_counts(records: DataFrame, sequences: Column, sigma: int = 1, min_total: int = 1) -> DataFrame:
    """Count every n-gram of 1..sigma values over all records.

    ``records`` has one row per record; ``sequences`` is an
    array<struct<values array<string>, weight bigint>> of the record: each
    sequence counts ``weight`` times. Returns (ngram array<string>, total
    bigint, records bigint) of the n-grams with at least ``min_total``.

    Null sequences, null weights and weights below 1 count nothing; a null
    value inside a sequence ends the n-grams that would hold it. Empty tables give
    no rows.
    """
    pieces = F.flatten(
        F.transform(
            F.filter(sequences, lambda s: (s["weight"] >= 1) & (F.size(s["values"]) > 0)),
            lambda s: F.transform(F.sequence(F.lit(1), F.size(s["values"])), lambda i: F.struct(_until_null(F.slice(s["values"], i, sigma)).alias("v"), s["weight"].alias("w"))),
        )
    )
    own = records.select(F.array_sort(F.filter(pieces, lambda p: F.size(p["v"]) > 0)).alias("_s"))
    before = F.concat(F.array(F.lit(None).cast("struct<v:array<string>,w:bigint>")), F.col("_s"))
    pairs = F.arrays_zip(F.col("_s").alias("c"), F.slice(before, F.lit(1), F.size("_s")).alias("p"))
    rows = own.select(F.explode(pairs).alias("_e")).select(F.col("_e.c.v").alias("suffix"), F.col("_e.c.w").alias("w"), F.col("_e.p.v").alias("_p"))
    fresh = [F.sum(((F.size("suffix") >= k) & ~F.coalesce(F.slice("suffix", 1, k) == F.slice("_p", 1, k), F.lit(False))).cast("bigint")).alias(f"f{k}") for k in range(1, sigma + 1)]
    combined = rows.groupBy("suffix").agg(F.sum("w").alias("w"), *fresh)
    routed = combined.repartitionByRange(shuffle_partitions(records.sparkSession), "suffix").sortWithinPartitions(F.desc("suffix"))
    counted = routed.select("suffix", "w", F.array(*[f"f{k}" for k in range(1, sigma + 1)]).alias("f")).mapInPandas(_stack(sigma), "ngram array<string>, total bigint, records bigint")
    if sigma > 1:
        counted = counted.groupBy("ngram").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))
    return counted.filter(F.col("total") >= min_total)


def _until_null(values: Column) -> Column:
    first = F.array_position(F.transform(values, lambda v: v.isNull()), True)
    return F.when(first > 0, F.slice(values, F.lit(1), (first - 1).cast("int"))).otherwise(values)


def _stack(sigma: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path: list[str] = []
        totals = [0] * (sigma + 1)
        records = [0] * (sigma + 1)
        out: list[tuple] = []

        def leave(depth: int) -> None:
            while len(path) > depth:
                k = len(path)
                out.append((list(path), totals[k], records[k]))
                totals[k - 1] += totals[k]
                totals[k] = records[k] = 0
                path.pop()

        for batch in batches:
            for suffix, weight, fresh in zip(batch["suffix"], batch["w"], batch["f"]):
                suffix = list(suffix)
                same = 0
                while same < len(path) and same < len(suffix) and path[same] == suffix[same]:
                    same += 1
                leave(same)
                path.extend(suffix[same:])
                totals[len(suffix)] += int(weight)
                for k in range(1, len(suffix) + 1):
                    records[k] += int(fresh[k - 1])
            if len(out) > 20000:
                yield pd.DataFrame(out, columns=["ngram", "total", "records"])
                out = []
        leave(0)
        yield pd.DataFrame(out, columns=["ngram", "total", "records"])

    return count


def term_sequences() -> Column:
    """Each valid term of ``term_frequency`` as a sequence of one value, counted as often as it occurs."""
    entries = F.filter(F.map_entries("term_frequency"), lambda e: (e["value"] >= 1) & (e["key"] != ""))
    return F.transform(entries, lambda e: F.struct(F.array(F.lower(e["key"])).alias("values"), e["value"].alias("weight")))


def tag_sequences() -> Column:
    """Each tag as a sequence of one value: lower case, one leading ``#`` removed, empty ones left out."""
    tags = F.filter(F.transform("tags", lambda t: F.regexp_replace(F.lower(t), "^#", "")), lambda t: t != "")
    return F.transform(tags, lambda t: F.struct(F.array(t).alias("values"), F.lit(1).cast("bigint").alias("weight")))


def tag_lists() -> Column:
    """The tags of a record in their order as one sequence, in the form of ``tag_sequences``."""
    return F.array(F.struct(F.transform(tag_sequences(), lambda s: s["values"][0]).alias("values"), F.lit(1).cast("bigint").alias("weight")))


def marked_values(records: DataFrame, rare: int = 2, common: float = 0.3) -> DataFrame:
    """(field, value, total, records, mark) of every term and tag of the records.

    ``mark`` is 'rare' when at most ``rare`` records hold the value, else
    'common' when more than ``common`` of all records do, else null. Records
    with null or empty maps and tags still count as records.
    """
    size = records.agg(F.count(F.lit(1)).alias("_all"))
    both = [suffix_counts(records, s).select(F.lit(f).alias("field"), F.col("ngram")[0].alias("value"), "total", "records") for f, s in (("term", term_sequences()), ("tag", tag_sequences()))]
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("_all"), "common")
    return both[0].unionByName(both[1]).crossJoin(F.broadcast(size)).withColumn("mark", mark).drop("_all")
