"""One ranking from several differently scaled scores by reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.ranks import competition_rank

SCORES = ("lexical_score", "semantic_score", "score")


def fuse_ranks(results: DataFrame, group: str = "query_id", item: str = "path", scores: tuple[str, ...] = SCORES, constant: float = 60.0, position: bool = True) -> DataFrame:
    """Rank the items of each group once per score and fuse the ranks.

    Returns one row per (group, item): a rank per score (``<score>_rank``, null
    where the score is missing), ``fused`` = sum of 1 / (constant + rank) over
    the scores that are present, and with ``position`` the rank of ``fused``.

    * null and NaN scores are missing; infinite ones are ordinary extremes;
    * ties share a rank (1 + number of strictly greater);
    * repeated rows of an item count once, each score by its greatest value;
    * an item without any score has fused 0 and comes last;
    * rows with a null group or item are no results; other columns are ignored.
    """
    clean = {s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")) for s in scores}
    items = (
        results.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[c.alias(f"_s{k}") for k, c in enumerate(clean.values())])
        .groupBy("_g", "_i")
        .agg(*[F.max(f"_s{k}").alias(f"_s{k}") for k in range(len(scores))])
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_s{k}").alias("_v")) for k in range(len(scores))]))
    long = items.select("_g", "_i", kinds.alias("_e")).select("_g", "_i", "_e._k", "_e._v")
    ranked = competition_rank(long, ["_g", "_k"], "_v", "_r")
    fused = ranked.groupBy("_g", "_i").agg(*[F.max(F.when(F.col("_k") == k, F.col("_r"))).alias(f"{s}_rank") for k, s in enumerate(scores)])
    parts = [F.coalesce(1.0 / (F.lit(constant) + F.col(f"{s}_rank")), F.lit(0.0)) for s in scores]
    fused = fused.withColumn("fused", reduce(add, parts))
    if position:
        fused = competition_rank(fused, ["_g"], "fused", "position")
    return fused.withColumnsRenamed({"_g": group, "_i": item})


def best_by_every_score(fused: DataFrame, top: int = 5, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Rows of ``fuse_ranks`` that are among the best ``top`` by each score."""
    return fused.filter(reduce(lambda a, b: a & b, [F.col(f"{s}_rank") <= top for s in scores]))
