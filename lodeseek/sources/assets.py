"""Model files with pinned digests: checked manifests, staged installs, verified reads."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

MOST_FILE, MOST_TOTAL = 256 * 10**6, 512 * 10**6
_MARKER = "installed.json"


# Characters of a cache key, which starts with one of the first 36.
_KEY = "abcdefghijklmnopqrstuvwxyz0123456789._-"


def _plain(key: str) -> bool:
    return bool(key) and key[0] in _KEY[:36] and set(key) <= set(_KEY)


@dataclass(frozen=True)
class Asset:
    path: str
    url: str
    bytes: int
    sha256: str


@dataclass(frozen=True)
class Manifest:
    cache_key: str
    revision: str
    assets: tuple[Asset, ...]

    @property
    def total_bytes(self) -> int:
        return sum(a.bytes for a in self.assets)

    def problems(self) -> list[str]:
        """What is wrong with the manifest; nothing may be installed while there is anything."""
        out = []
        if not re.fullmatch(r"[0-9a-f]{40}", self.revision):
            out.append("the revision is no 40-digit hash")
        if not _plain(self.cache_key):
            out.append("the cache key is no plain name")
        if len({a.path for a in self.assets}) < len(self.assets) or not self.assets:
            out.append("paths are missing or repeated")
        if self.total_bytes > MOST_TOTAL:
            out.append("the files are too large together")
        for a in self.assets:
            parts = a.path.split("/")
            if not a.path or any(p in ("", ".", "..") for p in parts) or re.search(r"[\\\x00-\x1f\x7f]", a.path):
                out.append(f"{a.path!r} is no safe relative path")
            if not a.url.startswith("https://"):
                out.append(f"{a.path}: not fetched by https")
            if not 0 < a.bytes <= MOST_FILE:
                out.append(f"{a.path}: bad size")
            if not re.fullmatch(r"[0-9a-f]{64}", a.sha256):
                out.append(f"{a.path}: bad digest")
        return out


_REVISION = "d8c86521100d3556476a063fc2342036d45c106f"
_BASE = f"https://huggingface.co/Snowflake/snowflake-arctic-embed-xs/resolve/{_REVISION}"
# The pinned model's files with their sizes and digests.
PINNED = Manifest(
    f"snowflake-arctic-embed-xs-int8-{_REVISION[:12]}",
    _REVISION,
    (
        Asset("config.json", f"{_BASE}/config.json", 737, "d7d071046ab952af96b7abad788db7ab3fc997b465e1b9914ff39707092254ec"),
        Asset("tokenizer.json", f"{_BASE}/tokenizer.json", 711_649, "91f1def9b9391fdabe028cd3f3fcc4efd34e5d1f08c3bf2de513ebb5911a1854"),
        Asset("tokenizer_config.json", f"{_BASE}/tokenizer_config.json", 1_433, "9ca59277519f6e3692c8685e26b94d4afca2d5438deff66483db495e48735810"),
        Asset("onnx/model_int8.onnx", f"{_BASE}/onnx/model_int8.onnx", 22_972_992, "e6aa5e656466a73d7c3111e9a3378bd13e5b93af30eaac2b3f13fd56692589a1"),
    ),
)


class AssetStore:
    """Installed manifests under ``root``, one folder each."""

    def __init__(self, root: str):
        self.root = root
        self._locks: dict[str, threading.Lock] = {}

    def folder(self, m: Manifest) -> str:
        return os.path.join(self.root, m.cache_key)

    def status(self, m: Manifest, digests: bool = False) -> str:
        """'not-installed', 'ready' or 'invalid'; sizes are always checked, contents with ``digests``."""
        folder = self.folder(m)
        if not os.path.isdir(folder):
            return "not-installed"
        try:
            with open(os.path.join(folder, _MARKER)) as f:
                if json.load(f) != {"revision": m.revision}:
                    return "invalid"
            for a in m.assets:
                if os.path.getsize(os.path.join(folder, a.path)) != a.bytes:
                    return "invalid"
                if digests:
                    self.read(m, a.path)
        except (OSError, ValueError):
            return "invalid"
        return "ready"

    def install(self, m: Manifest, fetch: Callable[[Asset], bytes]) -> str:
        """Fetch everything into a staging folder, check it, and rename it into place; nothing stays after a failure."""
        if m.problems():
            raise ValueError("; ".join(m.problems()))
        with self._locks.setdefault(m.cache_key, threading.Lock()):  # calls at the same time share one install
            return self._install(m, fetch)

    def _install(self, m: Manifest, fetch: Callable[[Asset], bytes]) -> str:
        if self.status(m, True) == "ready":
            return self.folder(m)
        os.makedirs(self.root, exist_ok=True)
        self.sweep()
        staging = tempfile.mkdtemp(prefix=".staging-", dir=self.root)
        try:
            for a in m.assets:
                data = fetch(a)
                if len(data) != a.bytes or hashlib.sha256(data).hexdigest() != a.sha256:
                    raise ValueError(f"{a.path} is not the file of the manifest")
                os.makedirs(os.path.dirname(os.path.join(staging, a.path)), exist_ok=True)
                with open(os.path.join(staging, a.path), "wb") as f:
                    f.write(data)
            with open(os.path.join(staging, _MARKER), "w") as f:
                json.dump({"revision": m.revision}, f)
            old = staging + "-old"
            if os.path.isdir(self.folder(m)):  # set aside, so that it comes back if the new one cannot take its place
                os.rename(self.folder(m), old)
            try:
                os.rename(staging, self.folder(m))
            except OSError:
                if os.path.isdir(old):
                    os.rename(old, self.folder(m))
                raise
            shutil.rmtree(old, ignore_errors=True)
        finally:
            shutil.rmtree(staging, ignore_errors=True)
        return self.folder(m)

    def sweep(self, older_s: float = 3600.0) -> None:
        """Delete staging folders that dead installs have left."""
        for name in os.listdir(self.root) if os.path.isdir(self.root) else []:
            path = os.path.join(self.root, name)
            if name.startswith(".staging-") and time.time() - os.path.getmtime(path) > older_s:
                shutil.rmtree(path, ignore_errors=True)

    def size(self, m: Manifest) -> int:
        """Bytes of all files in an installed folder, at any depth."""
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(self.folder(m)) for f in files)

    def read(self, m: Manifest, path: str) -> bytes:
        """An installed file's bytes, if they are those of the manifest."""
        asset = next(a for a in m.assets if a.path == path)
        with open(os.path.join(self.folder(m), path), "rb") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != asset.sha256:
            raise ValueError(f"{path} has changed since it was installed")
        return data

    def remove_all(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)
