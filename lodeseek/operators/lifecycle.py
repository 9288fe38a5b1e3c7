"""What surrounds an index while it works: status, cached query scores, superseded runs, removal everywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.index import removed
from lodeseek.sources.store import LOG, IndexStore

PHASES = ("idle", "lexical", "semantic", "ready")


@dataclass(frozen=True)
class Status:
    phase: str = "idle"
    indexed: int = 0
    total: int = 0
    semantic: int = 0
    error: str = ""


@dataclass
class StatusFeed:
    """The newest status and everyone who wants to hear of a change."""

    status: Status = field(default_factory=Status)
    listeners: list[Callable[[Status], None]] = field(default_factory=list)

    def subscribe(self, listener: Callable[[Status], None]) -> Callable[[], None]:
        """Tell ``listener`` the status now and whenever it changes; returns what ends that."""
        self.listeners.append(listener)
        listener(self.status)
        return lambda: self.listeners.remove(listener)

    def set(self, **changes) -> None:
        status = replace(self.status, **changes)
        if status.phase not in PHASES:
            raise ValueError(f"{status.phase!r} is no phase; phases are {PHASES}")
        if status != self.status:
            self.status = status
            for listener in list(self.listeners):
                listener(status)


class ScoreCache:
    """Scores of the last query texts by provider: the one that came first leaves first, however often it is asked for."""

    def __init__(self, most: int = 20):
        self.most, self._kept = most, {}

    def get(self, provider: str, text: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (provider, text)
        if key not in self._kept:
            scores = make()  # nothing is kept of a failure
            while len(self._kept) >= self.most:
                self._kept.pop(next(iter(self._kept))).unpersist()
            self._kept[key] = scores.persist()
        return self._kept[key]

    def clear(self) -> None:
        for scores in self._kept.values():
            scores.unpersist()
        self._kept.clear()

    def __len__(self) -> int:
        return len(self._kept)


_RUNNING: dict[str, int] = {}


@contextmanager
def superseding(spark: SparkSession, name: str) -> Iterator[Callable[[], bool]]:
    """Run jobs as the newest of their ``name``: jobs of an older run are cancelled.

    Yields a function that says whether this run is still the newest, to be asked between steps.
    """
    sc, own = spark.sparkContext, _RUNNING.get(name, 0) + 1
    sc.cancelJobGroup(f"{name}-{own - 1}")
    _RUNNING[name] = own
    before = sc.getLocalProperty("spark.jobGroup.id")
    sc.setJobGroup(f"{name}-{own}", name, interruptOnCancel=True)
    try:
        yield lambda: _RUNNING[name] == own
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)


def removed_everywhere(paths: DataFrame, docs: DataFrame, embeddings: DataFrame, store: IndexStore | None = None, seq: int = 0, scores: ScoreCache | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and embeddings without ``paths``; the removals go to the store's log from number ``seq`` on, and cached scores are forgotten.

    Only paths the documents hold are logged. All removals of one call may share
    a number, as each is of another path.
    """
    gone = paths.select("path").distinct()
    if store is not None:
        held = gone.join(docs.select("path"), "path", "left_semi")
        empty = F.from_json(F.lit(None).cast("string"), LOG).getField("document")
        store.append(held.select(F.lit(seq).cast("bigint").alias("seq"), F.lit("remove").alias("op"), "path", empty.alias("document")))
    if scores is not None:
        scores.clear()
    return removed(docs, gone), removed(embeddings, gone)
