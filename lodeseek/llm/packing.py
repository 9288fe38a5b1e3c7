"""Filling containers of several permitted lengths by best fit over a size histogram.

Only item sizes decide a packing, and no item is larger than the capacity, so
the histogram of sizes has at most ``capacity`` entries however many documents
there are. Best fit runs on the driver over that histogram, whole groups of
equal bins at a time; the documents of a size are then numbered without a
single-task sort and look up their container by number.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.ranks import spread_number
from lodeseek.runtime import materialize


def best_fit(histogram: dict[int, int], permitted: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Pack ``histogram`` (size -> count, sizes from 1 to the largest permitted length).

    Sizes go from large to small. An item goes into the open bin with the least
    room that takes it. If none does, a bin of the length is opened that costs
    least: the one whose filling with items of this size wastes the smallest
    share, the longest of equals. In the end every bin is cut down to the
    shortest permitted length that holds its contents.

    Returns runs (size, first item, items per bin, first bin, bins), by size and
    item, and bins (first bin, bins, content, length), by bin.
    """
    permitted = sorted(set(permitted))
    groups: dict[int, list[list[int]]] = {}  # room -> [first bin, bins, length]
    rooms: list[int] = []  # rooms with groups, ascending
    runs: list[tuple] = []
    opened = 0

    def put(room: int, group: list[int]) -> None:
        if group[1] > 0:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append(group)

    for size in sorted(histogram, reverse=True):
        left, number = histogram[size], 0
        while left > 0:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                group = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                length = min((x for x in permitted if x >= size), key=lambda x: ((x % size) / x, -x))
                room, group = length, [opened, -(-left // (length // size)), length]
                opened += group[1]
            each = min(room // size, left)
            bins = min(group[1], left // each)
            runs.append((size, number, each, group[0], bins))
            number, left = number + each * bins, left - each * bins
            put(room - each * size, [group[0], bins, group[2]])
            rest = [group[0] + bins, group[1] - bins, group[2]]
            if rest[1] and 0 < left < each:  # the last few go into one bin of the same group
                runs.append((size, number, left, rest[0], 1))
                put(room - left * size, [rest[0], 1, rest[2]])
                rest = [rest[0] + 1, rest[1] - 1, rest[2]]
                left = 0
            put(room, rest)
    bins = []
    for room, own in groups.items():
        for first, count, length in own:
            content = length - room
            bins.append((first, count, content, next(x for x in permitted if x >= content)))
    return sorted(runs, key=lambda r: (r[0], r[1])), sorted(bins)


def too_large(packed: DataFrame, item: str = "doc_id") -> DataFrame:
    """(limit_name, item) of the items that had to be cut."""
    return packed.filter((F.col("pieces") > 1) & (F.col("piece") == 0)).select("limit_name", item).distinct()


def pack(sizes: DataFrame, limits: DataFrame, item: str = "doc_id") -> DataFrame:
    """Pack the items of ``sizes`` (item, size) once for every limit of ``limits`` (limit_name, capacity).

    Under a limit the permitted lengths are its capacity and all smaller ones of the table,
    chosen jointly. An item above the capacity is cut into full pieces and a
    rest; no other item is split. Returns (limit_name, container, item, piece,
    pieces, piece_size, fill, length): ``fill`` is the content of the container and
    ``length`` its permitted length.

    * items of size 0 or null take no room and get a null container and fill 0;
    * repeated items are items of their own;
    * limits with a null name, or a null or non-positive capacity, are left out;
      a limit given twice counts once; limits and their capacities must fit the driver.
    """
    spark = sizes.sparkSession
    given = sorted({(r.limit_name, r.capacity) for r in limits.select("limit_name", "capacity").collect() if r.limit_name is not None and (r.capacity or 0) > 0})
    schema = f"limit_name string, container bigint, `{item}` {sizes.schema[item].dataType.simpleString()}, piece bigint, pieces bigint, piece_size bigint, fill bigint, length bigint"
    if not given:
        return spark.createDataFrame([], schema)
    caps = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(c).cast("bigint").alias("_c")) for k, (_, c) in enumerate(given)]))
    whole = sizes.select(F.col(item).alias("_id"), F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint").alias("_size"), caps.alias("_l"))
    pieces = F.greatest(F.ceil(F.col("_size") / F.col("_c")), F.lit(1)).cast("bigint")
    cut = whole.select("_id", "_size", "_l.*").withColumn("pieces", pieces)
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    cut = cut.withColumn("piece_size", F.least(F.col("_c"), F.col("_size") - F.col("piece") * F.col("_c"))).drop("_size", "_c")
    cut = materialize(cut, "pieces")  # read for the histogram, the numbering and the result
    counts = cut.filter(F.col("piece_size") > 0).groupBy("_k", "piece_size").count().collect()  # at most the capacity's number of rows a limit
    plans = []
    for k, (_, capacity) in enumerate(given):
        runs, bins = best_fit({r.piece_size: r["count"] for r in counts if r._k == k}, [c for _, c in given if c <= capacity])
        plans.append((*[np.array(x, dtype=np.int64).reshape(-1, w) for x, w in ((runs, 5), (bins, 4))],))
    shared = spark.sparkContext.broadcast((plans, [name for name, _ in given]))
    numbered = spread_number(cut, ["_k", "piece_size"], ["_id", "piece"], "_number")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans, names = shared.value
        keys = [r[:, 0] * (1 << 40) + r[:, 1] for r, _ in plans]
        for b in batches:
            if not len(b):
                continue
            limit, size, number = (b[c].to_numpy() for c in ("_k", "piece_size", "_number"))
            container = np.zeros(len(b), dtype=np.int64)
            fill, length = container.copy(), container.copy()
            for k, (runs, bins) in enumerate(plans):
                own = np.flatnonzero((limit == k) & (size > 0))
                if len(own):
                    run = runs[np.searchsorted(keys[k], size[own] * (1 << 40) + number[own], side="right") - 1]
                    container[own] = run[:, 3] + (number[own] - run[:, 1]) // run[:, 2]
                    of = bins[np.searchsorted(bins[:, 0], container[own], side="right") - 1]
                    fill[own], length[own] = of[:, 2], of[:, 3]
            room = pd.array(container, dtype="Int64")
            room[size <= 0] = pd.NA
            yield pd.DataFrame({"limit_name": [names[k] for k in limit], "container": room, item: b["_id"], "piece": b["piece"], "pieces": b["pieces"], "piece_size": size, "fill": fill, "length": length})

    return numbered.mapInPandas(place, schema)
