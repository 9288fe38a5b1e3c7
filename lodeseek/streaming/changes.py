"""A stream of file changes kept as an index's log and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.operators.index import NOTE, indexed, stored_form
from lodeseek.sources.store import IndexStore

EVENT = "seq bigint, event string, path string, old_path string, note struct<path string, basename string, extension string, content string, tags array<string>, ctime bigint, mtime bigint, size bigint>"


def read_changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def operations(events: DataFrame) -> DataFrame:
    """(seq, op, path, note): create, modify and metadata events write, deletes remove, a rename removes the old path and writes the new one.

    Each event takes two numbers of the log, so that both halves of a rename keep their order.
    """
    writes = events.filter("event IN ('create', 'modify', 'metadata', 'rename') AND note.path IS NOT NULL").select((F.col("seq") * 2 + 1).alias("seq"), F.lit("upsert").alias("op"), F.col("note.path").alias("path"), "note")
    gone = F.when(F.col("event") == "rename", F.col("old_path")).when(F.col("event") == "delete", F.col("path"))
    removals = events.select((F.col("seq") * 2).alias("seq"), F.lit("remove").alias("op"), gone.alias("path"), F.lit(None).cast(events.schema["note"].dataType).alias("note"))
    return writes.unionByName(removals.filter(F.col("path").isNotNull()))


def newest(ops: DataFrame) -> DataFrame:
    """The last operation per path."""
    return ops.groupBy("path").agg(F.max_by(F.struct("seq", "op", "note"), "seq").alias("_o")).select("path", "_o.*")


def still_there(ops: DataFrame, listing: DataFrame) -> DataFrame:
    """``ops`` in which the writes of paths that ``listing`` (path) no longer holds have become removals."""
    seen = listing.select("path", F.lit(True).alias("_seen")).distinct()
    gone = (F.col("op") == "upsert") & F.col("_seen").isNull()
    both = ops.join(seen, "path", "left")
    return both.select("seq", F.when(gone, F.lit("remove")).otherwise(F.col("op")).alias("op"), "path", F.when(~gone, F.col("note")).alias("note"))


def log_batch(store: IndexStore, events: DataFrame) -> None:
    """Index the newest change per path of one batch and append it to the store's log."""
    last = newest(operations(events)).persist()
    try:
        writes = last.filter("op = 'upsert'")
        documents = stored_form(indexed(writes.select("note.*"))).select(F.struct(*NOTE, "term_frequency", "token_count").alias("document"), F.col("path").alias("_p"))
        rows = writes.join(documents, F.col("path") == F.col("_p")).select("seq", "op", "path", "document")
        removals = last.filter("op = 'remove'").select("seq", "op", "path", F.lit(None).cast(rows.schema["document"].dataType).alias("document"))
        store.append(rows.unionByName(removals))
    finally:
        last.unpersist()


def follow(store: IndexStore, changes: DataFrame, checkpoint: str, once: bool = False, signature: str | None = None) -> StreamingQuery:
    """Keep ``store``'s log up with the stream; with the settings' ``signature`` the log is compacted as the policy says.

    A trigger collects the changes of 250 ms, of which the newest per path counts.

    A batch that is run again after a failure appends operations with the same
    numbers and contents, and replay takes one of them, so the state is the same.
    """

    def batch(events: DataFrame, _: int) -> None:
        log_batch(store, events)
        if signature is not None:
            store.maintain(signature)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()
