"""Ranking metrics, percentiles and result digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.ranks import competition_rank


def rank_metrics(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, hits, relevant) per judged query.

    ``ranking`` has (query_id, path, place), ``qrels`` (query_id, path).
    Precision divides by ``k`` however short the ranking; recall is 0 without
    relevant paths; the reciprocal rank looks at the whole ranking.
    """
    judged = qrels.select("query_id", "path").distinct()
    found = ranking.join(judged, ["query_id", "path"], "left_semi").groupBy("query_id").agg(F.count_if(F.col("place") <= k).alias("hits"), F.min("place").alias("_first"))
    wanted = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    queries = ranking.select("query_id").union(judged.select("query_id")).distinct()
    rows = queries.join(wanted, "query_id", "left").join(found, "query_id", "left").fillna(0, ["hits", "relevant"])
    recall = F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)
    return rows.select("query_id", (F.col("hits") / k).alias("precision"), recall.alias("recall"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"), "hits", "relevant")


def average_metrics(metrics: DataFrame) -> DataFrame:
    """Means of the ratios and sums of the counts; zeros without queries."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "reciprocal_rank")]
    return metrics.agg(*means, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "relevant")])


def fixture_scores(docs: DataFrame, listed: DataFrame, default: float = 0.05) -> DataFrame:
    """(path, score) for every document: the listed score, else ``default``."""
    return docs.select("path").join(listed.select("path", "score"), "path", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def nearest_rank(column: str, fraction: float) -> Column:
    """The smallest value that at least ``fraction`` of the values do not exceed."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY `{column}`)")


def floor_rank(sorted_values: Column, fraction: float) -> Column:
    """The value at index floor(n * fraction) of a sorted array, at most the last."""
    at = F.least(F.floor(F.size(sorted_values) * fraction), F.size(sorted_values) - 1)
    return F.get(sorted_values, at.cast("int"))


def summary(df: DataFrame, by: list[str], value: str, rule: str = "nearest") -> DataFrame:
    """Count, extremes, mean, median and 95th percentile of ``value`` per group.

    ``rule`` is 'nearest' (nearest rank) or 'floor' (the value at index
    floor(n * fraction), as for the timings of a session). Both are exact and
    count equal values together, so a group is never sorted as one array.
    """
    stats = [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")]
    if rule == "nearest":
        return df.groupBy(*by).agg(*stats, nearest_rank(value, 0.5).alias("median"), nearest_rank(value, 0.95).alias("p95"))
    rows = df.groupBy(*by).agg(*stats)
    ranked = competition_rank(df.filter(F.col(value).isNotNull()).select(*by, value), by, value, "_above").groupBy(*by, value).agg(F.max("_above").alias("_above"), F.count(F.lit(1)).alias("_same"))
    keys = [rows[c].eqNullSafe(ranked[c]) for c in by]
    both = rows.join(ranked.select(*[F.col(c) for c in by], F.col(value).alias("_x"), "_above", "_same"), keys, "left").select(*[rows[c] for c in by], "n", "least", "most", "mean", "_x", "_above", "_same")
    first = F.col("n") - F.col("_above") - F.col("_same") + 1  # index of the value's first copy in ascending order

    def at(fraction: float) -> Column:
        index = F.least(F.floor(F.col("n") * fraction), F.col("n") - 1)
        return F.max(F.when((first <= index) & (index < first + F.col("_same")), F.col("_x")))

    return both.groupBy(*by, "n", "least", "most", "mean").agg(at(0.5).alias("median"), at(0.95).alias("p95"))


def digest(value) -> str:
    """SHA-256 of the compact JSON of a driver-side value."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
