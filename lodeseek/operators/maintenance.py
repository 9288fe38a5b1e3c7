"""Passes that keep an index and its embeddings up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import embedding_text
from lodeseek.operators.embeddings import EmbeddingProvider, embedded, pooled_chunks, query_scores, usable_cache
from lodeseek.operators.index import capped_content, ignored, indexed, stored_form
from lodeseek.operators.reconcile import reconcile
from lodeseek.operators.wordpiece import WordPiece, token_ids, windows
from lodeseek.plans.query import Query, tokenize
from lodeseek.runtime import materialize
from lodeseek.sources.store import IndexStore, Settings


def eligible(notes: DataFrame, settings: Settings) -> DataFrame:
    """Notes outside the ignored folders, bodies above the cap emptied; where the size is null, the body is measured."""
    sized = notes.withColumn("size", F.coalesce("size", F.octet_length("content").cast("bigint")))
    return capped_content(sized.filter(~ignored(list(settings.ignored_folders))), settings.max_file_size_kb)


def refresh(store: IndexStore, notes: DataFrame, settings: Settings, seq: int) -> DataFrame:
    """Bring the stored index to the state of ``notes`` and publish it as a snapshot; returns the plan.

    Only new and changed notes are tokenized; unchanged ones are taken from the
    store. Without a fitting snapshot everything is built.
    """
    current = eligible(notes, settings)
    cached = store.load(settings.signature())
    if cached is None:
        plan = current.select("path", "mtime", "size", F.lit("new").alias("status"))
        state = stored_form(indexed(current))
    else:
        plan = reconcile(current, cached)
        changed = current.join(plan.filter("status IN ('new', 'changed')").select("path"), "path", "left_semi")
        kept = cached.join(plan.filter("status = 'unchanged'").select("path"), "path", "left_semi")
        state = kept.select("path", "basename", "extension", "tags", "ctime", "mtime", "size", "term_frequency", "token_count").unionByName(stored_form(indexed(changed)))
    plan = materialize(plan, "plan")  # taken before the snapshot it was made from is replaced
    store.compact(state, settings.signature(), seq)
    return plan


def needs_body(q: Query) -> Column:
    """Whether a document without its body has to load it to decide the query's phrases.

    A phrase in the metadata is decided; otherwise a body can hold it only if
    it has every inner token of the phrase (the outer ones may be parts of tokens).
    """
    test = F.lit(False)
    for phrase in dict.fromkeys(q.phrases + q.required_phrases + q.excluded_phrases):
        meta = F.col("norm_name").contains(phrase) | F.col("norm_path").contains(phrase) | F.exists("norm_tags", lambda t: F.contains(t, F.lit(phrase)))
        inner = F.lit(True)
        for term in tokenize(phrase)[1:-1]:
            inner = inner & F.coalesce(F.map_contains_key("tf", F.lit(term)), F.lit(False))
        test = test | (~meta & inner)
    return test


def with_bodies(docs: DataFrame, bodies: DataFrame, paths: DataFrame) -> DataFrame:
    """``docs`` with the normalized bodies of ``paths`` filled in from ``bodies`` (path, norm_content)."""
    wanted = bodies.join(paths.select("path"), "path", "left_semi").select("path", F.col("norm_content").alias("_body"))
    return docs.join(wanted, "path", "left").withColumn("norm_content", F.coalesce("_body", "norm_content")).drop("_body")


def chunked_embeddings(docs: DataFrame, model: WordPiece, provider: EmbeddingProvider, most_chunks: int | None = 12, batch: int = 8) -> DataFrame:
    """(path, vector): documents cut into windows of the model's length, each embedded, pooled per document.

    Windows are rows of their own, so one long document does not hold up a task.
    The first ``most_chunks`` windows are embedded, with None all of them.
    The provider gets the ids of a window as text, separated by blanks.
    """
    texts = docs.select("path", embedding_text(F.col("basename"), F.col("tags"), F.col("content")).alias("text"))
    cut = windows(F.col("ids"), model.max_length - 2, model.vocab["[CLS]"], model.vocab["[SEP]"], most_chunks)
    rows = token_ids(texts, model, "text").select("path", F.explode(cut).alias("w")).select("path", F.array_join(F.transform("w", lambda i: i.cast("string")), " ").alias("text"))
    return pooled_chunks(embedded(rows, provider, batch))


def semantic_or_reason(cache: DataFrame, text: str, provider: EmbeddingProvider) -> tuple[DataFrame | None, str]:
    """Scores of a query text, or None and why the search stays lexical."""
    usable = usable_cache(cache)
    if usable.isEmpty():
        return None, "the semantic index is empty"
    try:
        vector = provider.embed([text], "query")[0]
    except Exception as e:  # noqa: BLE001 - whatever the provider raises, the search goes on
        return None, f"the provider failed: {e}"
    scores = query_scores(usable, vector, provider.id)
    return (None, "no vector fits the provider") if scores.isEmpty() else (scores, "")
