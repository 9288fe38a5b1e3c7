"""Keyed merges of file states: reconciliation, journal replay, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, mtime, size, status): new, changed and unchanged files of ``current``, removed ones of ``cached``.

    Both sides have one row per path; mtime and size are compared null-safely.
    """
    a = current.select("path", F.struct("mtime", "size").alias("_now"))
    b = cached.select("path", F.struct("mtime", "size").alias("_old"))
    both = a.join(b, "path", "full_outer")
    same = F.col("_now.mtime").eqNullSafe(F.col("_old.mtime")) & F.col("_now.size").eqNullSafe(F.col("_old.size"))
    status = F.when(F.col("_now").isNull(), "removed").when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    state = F.coalesce("_now", "_old")
    return both.select("path", state["mtime"].alias("mtime"), state["size"].alias("size"), status.alias("status"))


def replay(snapshot: DataFrame, log: DataFrame, key: str, payload: list[str], order: str = "seq") -> DataFrame:
    """State after the operations of ``log`` (key, order, op, payload) on ``snapshot`` (key, payload): last writer wins.

    The last operation per key is found by a partial maximum, so a key with most
    of the log is combined before the shuffle. ``op`` 'remove' deletes, 'upsert'
    writes; rows with another op, or a null key, are skipped.
    """
    ops = log.filter(F.col("op").isin("upsert", "remove") & F.col(key).isNotNull())
    rows = ops.select(key, F.col(order).cast("bigint").alias("_o"), "op", F.struct(*payload).alias("_p"))
    base = snapshot.select(key, F.lit(-1).cast("bigint").alias("_o"), F.lit("upsert").alias("op"), F.struct(*payload).alias("_p"))
    last = base.unionByName(rows).groupBy(key).agg(F.max_by(F.struct("op", "_p"), "_o").alias("_l")).filter("_l.op = 'upsert'")
    return last.select(key, *[F.col(f"_l._p.{c}").alias(c) for c in payload])


def stale_embeddings(docs: DataFrame, cached: DataFrame, provider: str) -> DataFrame:
    """Documents whose embedding is missing or was made from another state or by another provider.

    A cached row without a size counts as made from the document's size.
    """
    c = cached.select("path", F.col("mtime").alias("_m"), F.coalesce(F.col("size"), F.lit(None)).alias("_s"), F.col("provider_id").alias("_p"))
    fresh = F.col("_m").eqNullSafe(F.col("mtime")) & (F.col("_s").isNull() | F.col("_s").eqNullSafe(F.col("size"))) & F.col("_p").eqNullSafe(F.lit(provider))
    return docs.join(c, "path", "left").filter(~fresh).select(docs.columns)


def live_embeddings(cached: DataFrame, docs: DataFrame) -> DataFrame:
    """Embeddings whose document still exists."""
    return cached.join(docs.select("path"), "path", "left_semi")
