"""Mixing sources to target weights by pivotal rounding of copy numbers.

Every document of a source gets the same expected number of copies. Its whole
part is sure; the fractions are rounded by the pivotal method: two documents
meet, and size moves at random from one to the other until the fraction of one
of them is 0 or 1. Documents meet within blocks, the largest first, so that
small ones are left to even out; the one fraction that a block leaves over meets
those of other blocks, level by level, until one per source is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.skew import sized
from lodeseek.runtime import materialize

BLOCK = 20_000
FAN_IN = 1_000
_EPS = 1e-12
_ROUNDED = "source string, blk bigint, doc_id bigint, size bigint, base bigint, part double, take bigint"


def pivotal(parts: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round the fractions one after another; returns 0/1 decisions and the index of the one left open (-1: none).

    ``parts`` then holds the fraction that was left. What moves between two
    documents is size, so the expected total size is kept exactly at every
    step, and the directions are drawn so that each fraction keeps its expectation.
    """
    draws = np.random.default_rng(seed).random(len(parts))
    take = np.zeros(len(parts), dtype=np.int64)
    held, p, s = -1, 0.0, 0.0
    for i, (q, r) in enumerate(zip(parts.tolist(), sizes.tolist())):
        if q <= 0.0 or q >= 1.0:
            take[i] = int(q >= 1.0)
        elif r <= 0:
            take[i] = int(draws[i] < q)  # changes no size
        elif held < 0:
            held, p, s = i, q, r
        else:
            up, down = min((1.0 - p) * s, q * r), min(p * s, (1.0 - q) * r)
            move = up if draws[i] * (up + down) < down else -down
            p, q = p + move / s, q - move / r
            if _EPS < p < 1.0 - _EPS:
                take[i] = int(q > 0.5)
            else:
                take[held] = int(p > 0.5)
                held, p, s = (i, q, r) if _EPS < q < 1.0 - _EPS else (-1, 0.0, 0.0)
                if held < 0:
                    take[i] = int(q > 0.5)
    if held >= 0:
        parts[held] = p
    return take, held


def _level(seed: int, last: bool):
    def round_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        own = np.random.SeedSequence([seed, *key[0].encode(), int(key[1]) & 0xFFFFFFFF]).generate_state(1)[0]
        parts = rows["part"].to_numpy(np.float64).copy()
        take, held = pivotal(parts, rows["size"].to_numpy(np.float64), own)
        decided = pd.array(take, dtype="Int64")
        if held >= 0:
            if last:
                decided[held] = int(np.random.default_rng(own + 1).random() < parts[held])
            else:
                decided[held] = pd.NA
        return rows.assign(part=parts, take=decided, blk=int(key[1]))[["source", "blk", "doc_id", "size", "base", "part", "take"]]

    return round_block


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats), one row per source; null sources, and weights that are null, NaN or not above 0, are left out.

    A source listed twice has the sum of its weights and its smallest cap; a null cap is 1.
    """
    valid = targets.filter(F.col("source").isNotNull() & (F.col("weight") > 0) & ~F.isnan("weight"))
    return valid.groupBy("source").agg(F.sum("weight").alias("weight"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: documents, size, target size and share, copies expected, and whether it can fill its share."""
    listed = clean_targets(targets)
    have = sizes.join(sized(listed.select("source")), "source").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("size"))
    both = listed.join(have, "source", "left").fillna(0, ["documents", "size"])
    sums = both.agg(F.sum("size").alias("_size"), F.sum("weight").alias("_weight"))
    plan = both.crossJoin(F.broadcast(sums))
    target = F.col("_size") * F.col("weight") / F.col("_weight")
    return plan.select(
        "source", "weight", "max_repeats", "documents", "size", (F.col("weight") / F.col("_weight")).alias("target_share"), target.alias("target_size"),
        F.when(F.col("size") > 0, F.least(F.col("max_repeats").cast("double"), target / F.col("size"))).otherwise(0.0).alias("copies"),
        (F.col("max_repeats") * F.col("size") >= target).alias("fills"),
    )


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draw a mix from ``sizes`` (doc_id, source, size): the mix and a report.

    The mix has (doc_id, source, size, copies) of the documents drawn at least
    once, never more than the source's ``max_repeats`` times. The total to
    reach is the size of all texts of the listed sources; a source that cannot
    fill its share gives all copies it may. The report has the row of
    ``source_plan`` and the size and share actually reached, for each listed
    source, with or without documents. The list of sources is broadcast where it is short.

    Documents without a source, or of a source that is not listed, are not
    drawn; a null size counts 0; repeated ids are documents of their own; the
    same seed gives the same mix.
    """
    spark = sizes.sparkSession
    plan = materialize(source_plan(sizes, targets), "mix-plan")
    most = plan.agg(F.max("documents")).first()[0] or 0
    per_doc = sized(plan.select("source", F.floor("copies").alias("base"), (F.col("copies") - F.floor("copies")).alias("part"), F.greatest(F.ceil(F.col("documents") / BLOCK), F.lit(1)).alias("_blocks")))
    rows = sizes.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size")).join(per_doc, "source")
    rows = rows.withColumn("blk", F.expr("pmod(xxhash64(doc_id, size), _blocks)"))
    blocks = max(1, -(-most // BLOCK))
    done, level = [], 0
    while True:
        last = blocks == 1
        rounded = rows.withColumn("take", F.lit(None).cast("bigint")).select("source", "blk", "doc_id", "size", "base", "part", "take").groupBy("source", "blk").applyInPandas(_level(seed + level, last), _ROUNDED)
        if last and not done:
            done.append(rounded)
            break
        rounded = materialize(rounded, f"mix-level-{level}")
        done.append(rounded.filter(F.col("take").isNotNull()))
        if last:
            break
        rows = rounded.filter(F.col("take").isNull()).withColumn("blk", F.floor(F.col("blk") / FAN_IN))
        blocks, level = -(-blocks // FAN_IN), level + 1
    drawn = done[0]
    for other in done[1:]:
        drawn = drawn.unionByName(other)
    drawn = materialize(drawn.select("doc_id", "source", "size", (F.col("base") + F.col("take")).alias("copies")).filter(F.col("copies") > 0), "mix")
    reached = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached_size"))
    total = reached.agg(F.sum("reached_size").alias("_all"))
    report = plan.join(reached, "source", "left").crossJoin(F.broadcast(total)).withColumn("reached_size", F.coalesce("reached_size", F.lit(0)))
    return drawn, report.withColumn("reached_share", F.coalesce(F.col("reached_size") / F.col("_all"), F.lit(0.0))).drop("_all")
