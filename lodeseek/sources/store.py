"""A stored index: versioned snapshots and a log of operations since."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.index import NOTE, valid_stored
from lodeseek.operators.reconcile import replay
from lodeseek.storage import Folder

VERSION = 1
COMPACT_OPS, COMPACT_IDLE_S = 500, 30
PAYLOAD = [*[c for c in NOTE if c != "path"], "term_frequency", "token_count"]
STORED = "path string, basename string, extension string, tags array<string>, ctime bigint, mtime bigint, size bigint, term_frequency map<string,bigint>, token_count bigint"
LOG = f"seq bigint, op string, path string, document struct<{STORED}>"


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine."""

    result_limit: int = 10
    semantic_weight: float = 0.78
    embedding_batch: int = 8
    max_file_size_kb: int = 1024
    search_delay_ms: int = 650
    verbose_context: int = 100
    ignored_folders: tuple[str, ...] = ()

    def signature(self) -> str:
        """The settings an index depends on; the order and outer slashes of folders do not matter."""
        folders = sorted(f for f in (x.strip().strip("/") for x in self.ignored_folders) if f)
        return json.dumps({"ignoredFolders": folders, "maxFileSizeKb": int(self.max_file_size_kb)}, separators=(",", ":"))


def should_compact(operations: int, idle_s: float, first_build: bool = False, changed: int = 0) -> bool:
    return first_build or changed >= COMPACT_OPS or operations >= COMPACT_OPS or (operations > 0 and idle_s >= COMPACT_IDLE_S)


class IndexStore:
    """Snapshots and log under ``root``, on any file system Spark can write.

    A snapshot is a folder that is renamed into place when it is whole; it names the
    last operation it holds. Readers take the newest snapshot whose version and settings fit,
    and the operations after it. Log lines are JSON; a damaged one is skipped wherever it stands.
    Each append is a segment named by its last operation; a segment that every kept
    snapshot holds already is dropped when a new snapshot is published.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.root = self.folder.root
        self.segments = Folder(spark, f"{self.root}/log")

    def _snapshots(self) -> list[int]:
        return self.folder.numbers("snapshot")

    def _meta(self, number: int) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/snapshot={number}/meta", wholetext=True).first().value)
        except Exception:  # noqa: BLE001 - whatever is wrong with it, the index is built again
            return None

    def log(self) -> DataFrame:
        """Valid operations of the log."""
        raw = self.spark.read.schema("value string").option("recursiveFileLookup", "true").text(f"{self.root}/log")
        ops = raw.select(F.from_json("value", LOG, {"mode": "PERMISSIVE"}).alias("o")).select("o.*")
        documents = ops.filter("op = 'upsert'").select("seq", "op", "document.*")
        removals = ops.filter("op = 'remove' AND path IS NOT NULL AND seq IS NOT NULL").select("seq", "op", "path", *[F.lit(None).alias(c) for c in PAYLOAD])
        return valid_stored(documents).filter("seq IS NOT NULL").unionByName(removals)

    def append(self, operations: DataFrame) -> None:
        """Add operations (seq, op, path, document) to the log as one segment; seq must grow."""
        staging = self.segments.staging()
        operations.select(F.to_json(F.struct("seq", "op", "path", "document"))).write.text(self.segments.at(staging))
        lines = self.spark.read.schema("value string").text(self.segments.at(staging))
        last = lines.agg(F.max(F.get_json_object("value", "$.seq").cast("bigint"))).first()[0]
        if last is None:
            self.segments.delete(staging)
        else:
            self.segments.publish(staging, f"upto={last}-{uuid.uuid4().hex}")

    def _upto(self) -> dict[str, int]:
        return {n: int(n.split("=")[1].split("-")[0]) for n in self.segments.names() if n.startswith("upto=")}

    def load(self, signature: str) -> DataFrame | None:
        """The stored documents after replay, or None when no snapshot fits the version and settings."""
        numbers = self._snapshots()
        meta = self._meta(numbers[-1]) if numbers else None
        if not meta or meta.get("version") != VERSION or meta.get("settingsSignature") != signature:
            return None
        snapshot = self.spark.read.schema(STORED).parquet(f"{self.root}/snapshot={numbers[-1]}/documents")
        return replay(valid_stored(snapshot), self.log().filter(F.col("seq") > meta["seq"]), "path", PAYLOAD)

    def last(self) -> int:
        """The last operation in the log or the newest snapshot, -1 for none; a rebuild takes it before it begins, and what is appended meanwhile is replayed on its snapshot."""
        numbers = self._snapshots()
        meta = self._meta(numbers[-1]) if numbers else None
        return max([*self._upto().values(), meta["seq"] if meta else -1], default=-1)

    def operations(self) -> int:
        numbers = self._snapshots()
        meta = self._meta(numbers[-1]) if numbers else None
        return self.log().filter(F.col("seq") > (meta["seq"] if meta else -1)).count()

    def compact(self, documents: DataFrame, signature: str, seq: int) -> int:
        """Publish ``documents``, the state after operation ``seq``, as a new snapshot, then drop older ones and their log.

        The last but one snapshot stays for readers that have begun, and with it the operations after it.
        """
        self.folder.sweep()
        number = max(self._snapshots(), default=0) + 1
        staging = self.folder.staging()
        documents.select("path", *PAYLOAD).write.parquet(self.folder.at(f"{staging}/documents"))
        meta = json.dumps({"version": VERSION, "settingsSignature": signature, "seq": seq, "at": int(time.time() * 1000)})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(self.folder.at(f"{staging}/meta"))
        self.folder.publish(staging, f"snapshot={number}")
        for old in self._snapshots()[:-2]:
            self.folder.delete(f"snapshot={old}")
        held = min((m["seq"] if (m := self._meta(n)) else -1) for n in self._snapshots())
        for name, last in self._upto().items():
            if last <= held:
                self.segments.delete(name)
        return number

    def maintain(self, signature: str, idle_s: float = 0.0, first_build: bool = False, changed: int = 0) -> int | None:
        """Compact if the policy says so; returns the new snapshot's number."""
        if not should_compact(self.operations(), idle_s, first_build, changed):
            return None
        last = self.last()  # operations appended from here on stay in the log
        state = self.load(signature)
        return None if state is None else self.compact(state, signature, last)
