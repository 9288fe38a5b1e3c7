"""The lexical index as DataFrames: documents, postings and statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import folder_of, tokens, with_normalized
from lodeseek.runtime import materialize, shuffle_partitions

NOTE = ["path", "basename", "extension", "tags", "ctime", "mtime", "size"]


def indexed(notes: DataFrame) -> DataFrame:
    """Derive every searchable column of ``notes``, one row per path.

    A null content is an empty body and null tags are none; null elements of tags are left out.
    Rows are spread by path once and then worked on where they lie.
    """
    base = notes.select(
        *[c for c in NOTE if c != "tags"],
        F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tags"),
        F.coalesce("content", F.lit("")).alias("content"),
    ).withColumn("_tags", F.array_join(F.transform("tags", lambda t: F.regexp_replace(t, "^#", "")), "\n"))
    names = {"norm_name": "basename", "norm_path": "path", "norm_ext": "extension", "_norm_tags": "_tags", "norm_content": "content"}
    docs = with_normalized(base.repartition(shuffle_partitions(notes.sparkSession), "path"), names)
    docs = docs.withColumns({
        "norm_ext": F.regexp_replace("norm_ext", r"^\.", ""),
        "folder": folder_of(F.col("path")),
        "norm_tags": F.when(F.size("tags") > 0, F.split("_norm_tags", "\n")).otherwise(F.array().cast("array<string>")),
        "_body": tokens("norm_content"),
    }).drop("_tags", "_norm_tags")
    meta = tokens(F.concat_ws(" ", "norm_name", "norm_path", F.array_join("norm_tags", " ")))
    docs = docs.withColumns({"token_count": F.size("_body").cast("bigint"), "tokens_all": F.array_union("_body", meta), "tokens_meta": F.array_distinct(meta)})
    return docs.withColumn("tf", counted(F.col("_body"))).drop("_body")


def counted(values: Column) -> Column:
    """map<string, bigint> of how often each value occurs in an array, in the order of values; without a shuffle."""
    bound = F.transform(F.array(F.sort_array(values)), lambda s: F.struct(s.alias("s"), F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == F.size(s)) | (i == 0) | (F.get(s, i) != F.get(s, i - 1))).alias("at")))
    runs = lambda x: F.zip_with(x["at"], F.slice(x["at"], F.lit(2), F.size(x["at"])), lambda a, b: F.struct(F.get(x["s"], a).alias("key"), (b - a).cast("bigint").alias("value")))
    entries = F.transform(bound, lambda x: F.filter(runs(x), lambda e: e["value"].isNotNull()))
    return F.when(F.size(values) > 0, F.map_from_entries(entries[0])).otherwise(F.create_map().cast("map<string,bigint>"))


def restored(stored: DataFrame) -> DataFrame:
    """Documents of a stored index: metadata and term counts without bodies."""
    base = indexed(stored.withColumn("content", F.lit("")))
    kept = stored.select("path", F.col("term_frequency").alias("tf"), "token_count")
    docs = base.drop("tf", "token_count").join(kept, "path")
    return docs.withColumn("tokens_all", F.array_union(F.map_keys("tf"), "tokens_all"))


def stored_form(docs: DataFrame) -> DataFrame:
    return docs.select(*NOTE, F.col("tf").alias("term_frequency"), "token_count")


def valid_stored(stored: DataFrame) -> DataFrame:
    """Rows that may be restored: no nulls, no negative times or counts, and terms with positive counts."""
    fine = F.lit(True)
    for c in [*NOTE, "term_frequency", "token_count"]:
        fine = fine & F.col(c).isNotNull()
    for c in ("ctime", "mtime", "size", "token_count"):
        fine = fine & (F.col(c) >= 0)
    fine = fine & F.forall("tags", lambda t: t.isNotNull())
    return stored.filter(fine & F.forall(F.map_entries("term_frequency"), lambda e: (e["key"] != "") & F.coalesce(e["value"] > 0, F.lit(False))))


def postings(docs: DataFrame) -> DataFrame:
    return docs.select("path", "token_count", F.explode("tf").alias("term", "tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.map_keys("tf")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))


def removed(docs: DataFrame, paths: DataFrame) -> DataFrame:
    return docs.join(paths.select("path"), "path", "left_anti")


def upserted(docs: DataFrame, notes: DataFrame) -> DataFrame:
    fresh = indexed(notes)
    return removed(docs, notes).unionByName(fresh)


def ignored(folders: list[str]):
    """Column: whether a path is one of the folders or lies below one."""
    path, test = F.col("path"), F.lit(False)
    for f in folders:
        test = test | (path == f) | path.startswith(f + "/")
    return test


def capped_content(notes: DataFrame, most_kb: int) -> DataFrame:
    """Bodies above the size cap become empty; their metadata stays."""
    return notes.withColumn("content", F.when(F.col("size") <= most_kb * 1024, F.col("content")).otherwise(F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(path, mtime, size): what tells whether a document has changed."""
    return docs.select("path", "mtime", "size")


def listing(docs: DataFrame) -> DataFrame:
    return docs.select(*NOTE, "folder", "token_count")


def has(docs: DataFrame, path: str) -> bool:
    return not docs.filter(F.col("path") == path).isEmpty()


def cleared(docs: DataFrame) -> DataFrame:
    """The index without any document."""
    return docs.filter(F.lit(False))


SLIM = [*NOTE, "folder", "norm_name", "norm_path", "norm_ext", "norm_tags", "token_count", "tokens_meta"]
BODY = ["path", "content", "norm_content"]


@dataclass
class Index:
    """What a search reads: slim documents, bodies, postings and statistics.

    ``of`` derives all of them from ``docs``, which the caller should have stored.
    ``stored`` writes them once, postings in the order of terms and bodies in that of
    paths, so that a query reads the parts of the files that hold its terms and
    its results. Neither order puts a term or a folder into one task.
    ``loader`` gives (path, content, norm_content) for (path), where the index has no bodies.
    """

    docs: DataFrame
    n_docs: int
    total_tokens: int
    slim: DataFrame
    bodies: DataFrame
    postings: DataFrame
    terms: DataFrame | None = None
    loader: Callable[[DataFrame], DataFrame] | None = None

    @classmethod
    def of(cls, docs: DataFrame, loader: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        r = corpus_stats(docs).first()
        return cls(docs, r.n_docs, r.total_tokens, docs.select(*SLIM), docs.select(*BODY), postings(docs), None, loader)

    @classmethod
    def stored(cls, docs: DataFrame, loader: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """Postings and frequencies as of the documents' term maps; the statistics are taken here once."""
        r = corpus_stats(docs).first()
        parts = shuffle_partitions(docs.sparkSession)
        slim = materialize(docs.select(*SLIM), "slim")
        bodies = materialize(docs.select(*BODY).repartitionByRange(parts, "path").sortWithinPartitions("path"), "bodies")
        rows = materialize(postings(docs).repartitionByRange(parts, "term", "path").sortWithinPartitions("term"), "postings")
        terms = materialize(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term"), "terms")
        return cls(docs, r.n_docs, r.total_tokens, slim, bodies, rows, terms, loader)

    @property
    def average(self) -> float:
        return self.total_tokens / self.n_docs if self.n_docs else 1.0

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequency of a query's few terms, looked up or from one scan of the term maps."""
        if not terms:
            return {}
        if self.terms is not None:
            known = {r.term: r.df for r in self.terms.filter(F.col("term").isin(terms)).collect()}
            return {t: known.get(t, 0) for t in terms}
        held = [F.count_if(F.coalesce(F.map_contains_key("tf", F.lit(t)), F.lit(False))).alias(f"t{i}") for i, t in enumerate(terms)]
        row = self.docs.agg(*held).first()
        return {t: row[f"t{i}"] for i, t in enumerate(terms)}
