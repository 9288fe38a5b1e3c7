"""Incremental runs whose only state is the target they have written.

Each output row carries the key and version of the source row it came from. A
run anti-joins the source against the newest version per key in the target,
processes what is left, and publishes the outcome as one new target version by
a single directory rename. A run that dies before the rename leaves nothing a
reader can see; a run that is started again after the rename finds itself
published and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.runtime import fresh_dir, materialize
from lodeseek.storage import Folder


class VersionedTarget:
    """A target table of published versions under ``root``.

    ``change=<n>`` holds the rows that version n added; ``base=<n>`` (written
    every ``compact_every`` versions) the newest row per key up to n, so that a
    run reads one base and at most ``compact_every`` changes.
    Rows with a null in the key or the version are no source rows.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], version: list[str], compact_every: int = 16):
        self.spark, self.key, self.version, self.compact_every = spark, key, version, compact_every
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField("run_id", T.LongType()), T.StructField("seq", T.LongType())])
        self.folder = Folder(spark, root)
        self.root = self.folder.root

    def versions(self) -> list[int]:
        return self.folder.numbers("change")

    def published(self, run_id: int) -> bool:
        """Whether a version of this run exists (a marker in the version's folder names its run)."""
        return bool(self.folder.matching(f"change=*/_RUN-{run_id}"))

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def changes(self) -> DataFrame:
        """Every row ever published."""
        return self._read([f"{self.root}/change={n}" for n in self.versions()])

    def current(self) -> DataFrame:
        """The newest published row per key."""
        base = max(self.folder.numbers("base"), default=0)
        paths = [f"{self.root}/base={base}"] * (base > 0) + [f"{self.root}/change={n}" for n in self.versions() if n > base]
        rest = [c for c in self.schema.names if c not in self.key]
        return self._read(paths).groupBy(*self.key).agg(*[F.max_by(c, "seq").alias(c) for c in rest])  # column by column, so that numbers are aggregated by hash

    def pending(self, source: DataFrame) -> DataFrame:
        """Source rows whose key is new or whose version differs from the target's.

        The anti-join hashes the key alone, as the target's newest rows are
        spread by it already; versions are compared in the join.
        """
        whole = F.lit(True)
        for c in [*self.key, *self.version]:
            whole = whole & F.col(c).isNotNull()
        known = self.current().select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)], F.struct(*self.version).alias("_v"))
        same = F.lit(True)
        for i, c in enumerate(self.key):
            same = same & (F.col(c) == F.col(f"_k{i}"))
        own = F.struct(*self.version)
        return source.filter(whole).join(known, same & (own <= F.col("_v")) & (own >= F.col("_v")), "left_anti")

    def run(self, source: DataFrame, run_id: int, process: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
        """Process what is pending in ``source`` (one row per key) and publish it.

        Returns the version's number, or None when the run is published already.
        Of two runs that start from the same version one publishes; the other
        raises ``Taken`` and has to start again, as its anti-join did not see the first.
        """
        if self.published(run_id):
            return None
        self.folder.sweep()
        seq = max(self.versions(), default=0) + 1
        staging = self.folder.staging()
        rows = self.pending(source)
        rows = process(rows) if process else rows
        rows = rows.withColumns({"run_id": F.lit(run_id).cast("bigint"), "seq": F.lit(seq).cast("bigint")}).select(*self.schema.names)
        rows.write.parquet(self.folder.at(staging))
        self.folder.touch(f"{staging}/_RUN-{run_id}")
        self.folder.publish(staging, f"change={seq}")
        if seq % self.compact_every == 0:
            staging = self.folder.staging()
            self.current().select(*self.schema.names).write.parquet(self.folder.at(staging))
            self.folder.publish(staging, f"base={seq}")
        return seq


def newest_per_slice(rows: DataFrame, bounds: list, key: str, version: list[str], order: list[str]) -> DataFrame:
    """The last row per key of each slice of time between two runs.

    ``bounds`` are the runs' ascending start times; slice i holds the rows after
    bound i-1 up to bound i, by the first column of ``order``. Rows after the
    last bound belong to no run. The maximum per key and slice is combined
    before the shuffle, so a key with most of the rows costs one row per task.
    """
    at = F.col(order[0])
    times = F.array(*[F.lit(b) for b in bounds])
    sliced = rows.withColumn("slice", F.size(F.filter(times, lambda b: b < at))).filter(F.col("slice") < len(bounds))
    newest = F.max_by(F.struct(*version), F.struct(*order)).alias("_v")
    return sliced.groupBy(key, "slice").agg(newest).select(key, *[F.col(f"_v.{c}") for c in version], "slice")


def replay_runs(scans: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """The work of every successful run, as (run_id, path).

    ``scans`` are stat observations (path, mtime, size, seen_at, scan_id) in any
    order; ``runs`` (run_id, started_at, finished_at, status) are few enough to
    be walked one after another, as they ran. Successful runs have status 'ok'
    and a finish; a run without a start sees nothing. Runs that start together
    follow their ids. Each run goes through ``VersionedTarget.run``: what a run
    sees beyond the run before it is its own slice of the scans, and a path
    without a row in the slice has not changed.
    Rows with a null path, mtime, size or time are ignored.
    """
    spark = scans.sparkSession
    ok = runs.filter((F.col("status") == "ok") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
    todo = ok.select("run_id", "started_at").distinct().orderBy("started_at", "run_id").collect()
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("size", T.LongType())])
    target = VersionedTarget(spark, root or fresh_dir(spark, "target"), schema, ["path"], ["mtime", "size"])
    if todo:
        valid = scans.dropna(subset=["path", "mtime", "size", "seen_at", "scan_id"]).select("path", "mtime", "size", "seen_at", "scan_id")
        slices = newest_per_slice(valid, [r.started_at for r in todo], "path", ["mtime", "size"], ["seen_at", "scan_id"])
        slices = materialize(slices, "slices", ["slice"])
        for i, r in enumerate(todo):
            target.run(slices.filter(F.col("slice") == i).drop("slice"), r.run_id)
    return target.changes().select("run_id", "path")
