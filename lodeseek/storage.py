"""Folders on any file system Spark can write, and publication that only one of several writers wins."""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

#: A claim or a staging folder that is older than this many seconds was left by a writer that died.
LEASE_S, STAGING_S = 600, 86_400


class Taken(RuntimeError):
    """Another writer has published, or is just publishing, the same name."""


class Folder:
    """A folder and what is published in it.

    A writer stages its files in a folder of its own, claims the final name by
    creating a file that must not exist, looks whether the name is free, and
    renames. Only the holder of a claim renames, so two writers never move
    their folders to one name; a claim left by a dead writer ends with its lease.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.root))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        folder = self._path(self.at(name).rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def numbers(self, kind: str) -> list[int]:
        """The numbers n of the published folders ``<kind>=n``."""
        return sorted(int(x.split("=")[1]) for x in self.names() if x.startswith(kind + "="))

    def matching(self, pattern: str) -> list[str]:
        """Names that fit a glob pattern, by one listing."""
        found = self.fs.globStatus(self._path(self.at(pattern)))
        return sorted(s.getPath().toString() for s in found or [])

    def touch(self, name: str) -> None:
        self.fs.create(self._path(self.at(name)), True).close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)

    def staging(self) -> str:
        return f"_staging-{uuid.uuid4().hex}"

    def sweep(self, older_s: float = STAGING_S) -> list[str]:
        """Delete staging folders of dead writers; returns their names."""
        now, gone = time.time() * 1000, []
        for s in self.fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("_staging-") and now - s.getModificationTime() > older_s * 1000:
                self.delete(name)
                gone.append(name)
        return gone

    def _create(self, name: str) -> bool:
        """Create an empty file, atomically failing where it exists."""
        url = urlparse(self._path(self.at(name)).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toString())
        if url.scheme == "file":  # the local file system of Hadoop looks first and creates then
            try:
                os.close(os.open(unquote(url.path), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self.fs.create(self._path(self.at(name)), False).close()
        except Exception as e:  # noqa: BLE001 - the JVM's exception for a file that exists
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _age(self, name: str) -> float:
        """Seconds since a file was written; 0 where it is just gone."""
        try:
            return time.time() - self.fs.getFileStatus(self._path(self.at(name))).getModificationTime() / 1000
        except Exception as e:  # noqa: BLE001 - the JVM's exception for a file that is gone
            if "FileNotFound" in str(e):
                return 0.0
            raise

    def publish(self, staging: str, final: str) -> None:
        """Rename ``staging`` to ``final`` or raise ``Taken``."""
        claim = f"_claim-{final}"
        if not self._create(claim):
            if self._age(claim) > LEASE_S:
                self.delete(claim)
            if self.exists(claim) or not self._create(claim):
                raise Taken(f"{final} is being published by another writer")
        try:
            if self.exists(final):
                raise Taken(f"{final} exists already: another writer has published it")
            if not self.fs.rename(self._path(self.at(staging)), self._path(self.at(final))):
                raise RuntimeError(f"{staging} could not be renamed to {final}")
        finally:
            self.delete(claim)
