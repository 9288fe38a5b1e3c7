"""Embeddings: providers, batched updates, query scores, pooled chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import embedding_text
from lodeseek.functions.vectors import dot, unit
from lodeseek.operators.reconcile import live_embeddings, stale_embeddings


class EmbeddingProvider(Protocol):
    id: str

    def embed(self, texts: list[str], purpose: str) -> list[list[float]]: ...


class HashingProvider:
    """A deterministic provider without a model: signed counts of hashed words."""

    def __init__(self, width: int = 64):
        self.width, self.id = width, f"hashing:{width}"

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.width] += 1 if h >> 63 else -1
            row[0] += 1e-3
        return out.tolist()


class HttpProvider:
    """Embeds by POST through an injected ``send(url, body) -> (status, json)``, as there may be no network."""

    def __init__(self, endpoint: str, model: str, send: Callable[[str, dict], tuple[int, dict]]):
        self.url, self.model, self.send, self.id = self.normalize(endpoint), model, send, f"http:{model}"

    @staticmethod
    def normalize(endpoint: str) -> str:
        base = endpoint.strip().rstrip("/")
        return base if base.endswith("/api/embed") else base + "/api/embed"

    def embed(self, texts: list[str], purpose: str = "document") -> list[list[float]]:
        status, body = self.send(self.url, {"input": texts, "model": self.model, "truncate": True})
        vectors = body.get("embeddings")
        if status != 200 or not isinstance(vectors, list) or not all(isinstance(v, list) and all(isinstance(x, (int, float)) for x in v) for v in vectors):
            raise ValueError(f"no vectors in the answer of {self.url} (status {status})")
        return vectors


def embedded(texts: DataFrame, provider: EmbeddingProvider, batch: int = 8, purpose: str = "document", progress: Accumulator | None = None) -> DataFrame:
    """(path, vector): unit vectors of (path, text), ``batch`` texts a call, on the executors.

    ``progress`` is an accumulator to which each call adds its number of texts. The
    job is cancelled by its group, see ``lifecycle.superseding``.
    """
    size = max(1, batch)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                vectors = provider.embed(part["text"].tolist(), purpose)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                if progress is not None:
                    progress.add(len(part))
                yield pd.DataFrame({"path": part["path"], "vector": vectors})

    made = texts.select("path", "text").mapInPandas(run, "path string, vector array<double>").withColumn("vector", unit(F.col("vector")))
    return made.withColumn("vector", F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.raise_error(F.lit("a provider gave an unusable vector")).cast("array<double>")))


def updated_cache(docs: DataFrame, cached: DataFrame, provider: EmbeddingProvider, batch: int = 8, progress: Accumulator | None = None) -> DataFrame:
    """The cache after embedding what is stale and dropping what is gone; a fresh row without a size gets the document's."""
    stale = stale_embeddings(docs, cached, provider.id)
    text = stale.select("path", embedding_text(F.col("basename"), F.col("tags"), F.col("content")).alias("text"))
    made = embedded(text, provider, batch, progress=progress).join(docs.select("path", "mtime", "size"), "path").withColumn("provider_id", F.lit(provider.id))
    kept = live_embeddings(cached, docs).join(stale.select("path"), "path", "left_anti")
    kept = kept.join(docs.select("path", F.col("size").alias("_size")), "path").withColumn("size", F.coalesce("size", "_size")).drop("_size")
    columns = ["path", "provider_id", "mtime", "size", "vector"]
    return kept.select(columns).unionByName(made.select(columns))


def usable_cache(cached: DataFrame) -> DataFrame:
    """Cached rows at length 1; rows without a usable vector are dropped."""
    return cached.withColumn("vector", unit(F.col("vector"))).filter(F.col("vector").isNotNull())


def query_scores(cache: DataFrame, query: list[float], provider: str) -> DataFrame:
    """(path, score): max(0, dot) with the provider's vectors of the query's width."""
    same = (F.col("provider_id") == provider) & (F.size("vector") == len(query))
    v = F.array(*[F.lit(float(x)) for x in query])
    return cache.filter(same).select("path", F.greatest(F.lit(0.0), dot(F.col("vector"), v)).alias("score"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (path, vector) with a path's vectors added up within its batch; rows with null for the vector stay."""
    for b in batches:
        codes = pc.dictionary_encode(b["path"], null_encoding="encode")
        code = codes.indices.to_numpy()
        usable = pc.is_valid(b["vector"]).to_numpy(zero_copy_only=False)
        again = usable & (np.bincount(code[usable], minlength=len(codes.dictionary))[code] > 1) if len(code) else usable
        yield b.filter(pa.array(~again))
        if again.any():
            vectors = b["vector"].filter(pa.array(again))
            lengths = pc.list_value_length(vectors).to_numpy()
            most, begins = int(lengths.max()), np.cumsum(lengths) - lengths
            keys = np.repeat(code[again].astype(np.int64) * most - begins, lengths) + np.arange(lengths.sum())
            keys, at = np.unique(keys, return_inverse=True)
            sums = np.bincount(at, vectors.flatten().to_numpy())
            paths, widths = np.unique(keys // most, return_counts=True)
            added = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(widths)), pa.int32()), pa.array(sums))
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(paths)), added.cast(b.schema.field("vector").type)], schema=b.schema)


def pooled_chunks(chunks: DataFrame) -> DataFrame:
    """(path, vector): mean of each path's unit chunk vectors, at length 1; ``chunks`` has (path, vector).

    A path's vectors are added up within each batch before the shuffle, so a path with
    very many chunks sends one row a batch; whole vectors are shuffled, once, and summed
    per element where they arrive. A chunk without a usable vector, and a mean of length
    0, are errors. They are raised after the sums: an array of ``posexplode`` that may
    raise gets filters inferred on it, which are then tested together with the
    caller's and meet rows that those leave out.
    """
    must = lambda v, why: F.coalesce(v, F.raise_error(F.lit(why)).cast("array<double>"))
    added = chunks.select("path", unit(F.col("vector")).alias("vector")).mapInArrow(_summed, "path string, vector array<double>").repartition("path")
    parts = added.select("path", F.posexplode_outer("vector").alias("i", "v"))  # an unusable vector has null for i
    sums = parts.groupBy("path", "i").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_v"))  # null for i comes first
    usable = must(F.when(F.get("_v", F.lit(0))["i"].isNotNull(), F.transform("_v", lambda x: x["v"])), "a chunk has no usable vector")
    return whole.select("path", usable.alias("_v")).select("path", must(unit(F.col("_v")), "the chunks of a path cancel out").alias("vector"))


def first_token_vectors(hidden: np.ndarray, width: int) -> np.ndarray:
    """The first position of [batch, sequence, width] hidden states."""
    if hidden.ndim != 3 or hidden.shape[2] != width or not hidden.shape[1]:
        raise ValueError(f"hidden states have shape {hidden.shape}, not [batch, sequence, {width}]")
    return np.ascontiguousarray(hidden[:, 0, :])
