"""Embedding models that run where the rows are: made on first use, checked, timed and cancellable."""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable

import numpy as np

from lodeseek.operators.embeddings import first_token_vectors
from lodeseek.operators.wordpiece import WordPiece, padded

# The names of a model's inputs and output, the prefix of query texts, and the limits that a provider's id names.
INPUTS, OUTPUT = ("attention_mask", "input_ids", "token_type_ids"), "last_hidden_state"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
MOST_CHUNKS, INFERENCE_BATCH = 12, 8
LATENCIES = 512


def provider_id(revision: str, runtime: str, width: int, chunks: int = MOST_CHUNKS, prefix: int = 1, cache: int = 1) -> str:
    """Everything a vector depends on; another id makes cached vectors stale."""
    return ":".join(("on-device", revision, runtime, f"cls-{width}", "l2-normalized", f"query-prefix-v{prefix}", f"chunks-{chunks}", f"cache-v{cache}"))


def check_interface(inputs: list[str], outputs: list[str]) -> None:
    missing = [n for n in INPUTS if n not in inputs] + [OUTPUT] * (OUTPUT not in outputs)
    if missing:
        raise ValueError(f"the model lacks {', '.join(missing)}")


def check_size(data: bytes, expected: int) -> bytes:
    if len(data) != expected:
        raise ValueError(f"the runtime has {len(data)} bytes, not {expected}")
    return data


def mean_vector(chunks: list[np.ndarray], width: int) -> list[float]:
    """Mean of the chunks' unit vectors, at length 1."""
    if not chunks or any(len(c) != width for c in chunks):
        raise ValueError("a group of chunk vectors is empty or has another width")
    stacked = np.array(chunks, dtype=np.float64)
    lengths = np.sqrt((stacked * stacked).sum(axis=1))
    if not (np.isfinite(lengths) & (lengths > 0)).all():
        raise ValueError("a chunk vector is zero or not finite")
    total = (stacked / lengths[:, None]).sum(axis=0)
    length = float(np.sqrt((total * total).sum()))
    if not math.isfinite(length) or length == 0:
        raise ValueError("the chunks of a text cancel out")
    return (total / length).tolist()


class TokenModel:
    """A provider from a WordPiece vocabulary and ``infer(inputs) -> hidden states [batch, sequence, width]``.

    A query is one sequence behind the prefix, a document up to ``MOST_CHUNKS``
    windows; sequences run in batches and are put back to their texts.
    """

    def __init__(self, tokenizer: WordPiece, infer: Callable[[dict[str, np.ndarray]], np.ndarray], width: int, id: str):
        self.tokenizer, self.infer, self.width, self.id = tokenizer, infer, width, id

    def _sequences(self, text: str, purpose: str) -> list[list[int]]:
        t = self.tokenizer
        if purpose == "query":
            return [t.encode(QUERY_PREFIX + text)]
        ids, room = t.ids(text), t.max_length - 2
        cuts = [ids[i : i + room] for i in range(0, len(ids), room)][:MOST_CHUNKS] or [[]]
        return [[t.vocab["[CLS]"], *c, t.vocab["[SEP]"]] for c in cuts]

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        owned = [(owner, s) for owner, text in enumerate(texts) for s in self._sequences(text, purpose)]
        grouped: list[list[np.ndarray]] = [[] for _ in texts]
        for at in range(0, len(owned), INFERENCE_BATCH):
            part = owned[at : at + INFERENCE_BATCH]
            vectors = first_token_vectors(np.asarray(self.infer(padded([s for _, s in part], self.tokenizer.vocab["[PAD]"]))), self.width)
            if len(vectors) != len(part):
                raise ValueError("the model returned an incomplete batch")
            for (owner, _), v in zip(part, vectors):
                grouped[owner].append(v)
        return [mean_vector(g, self.width) for g in grouped]


class LazyProvider:
    """A provider made by ``factory`` on first use, in each Python worker for itself.

    Answers are checked; the last ``LATENCIES`` durations are kept. ``cancel``
    makes waiting and later calls fail until ``resume``; ``dispose`` drops the model.
    """

    def __init__(self, factory: Callable[[], object], id: str, width: int):
        self.factory, self.id, self.width = factory, id, width
        self._fresh()

    def _fresh(self) -> None:
        self._made, self._lock, self._cancelled = None, threading.Lock(), threading.Event()
        self.latencies: deque[float] = deque(maxlen=LATENCIES)
        self.requests = 0

    def __getstate__(self):
        return {"factory": self.factory, "id": self.id, "width": self.width}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fresh()

    @property
    def ready(self) -> bool:
        return self._made is not None

    def cancel(self) -> None:
        self._cancelled.set()

    def resume(self) -> None:
        self._cancelled.clear()

    def dispose(self) -> None:
        with self._lock:
            self._made = None

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        if not texts:
            return []
        with self._lock:
            if self._cancelled.is_set():
                raise RuntimeError("the request was cancelled")
            self._made = self._made or self.factory()
            self.requests += 1
            began = time.perf_counter()
            vectors = self._made.embed(texts, purpose)
            self.latencies.append(time.perf_counter() - began)
        if self._cancelled.is_set():
            raise RuntimeError("the request was cancelled")
        if len(vectors) != len(texts) or any(len(v) != self.width or not np.isfinite(v).all() or not np.any(v) for v in vectors):
            raise ValueError("the provider gave vectors that cannot be used")
        return vectors
