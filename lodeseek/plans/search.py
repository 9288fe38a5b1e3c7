"""Search: constraints, scores, fusion, facets, filters, order and snippets."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import clamp, snippet, verbose_snippet
from lodeseek.operators.blocks import BEST, COUNTED, best_in_block, counted_terms, flat_postings
from lodeseek.operators.index import BODY, SLIM, Index
from lodeseek.operators.maintenance import needs_body, with_bodies
from lodeseek.operators.skew import BROADCAST_ROWS, sized
from lodeseek.plans.compile import B, BODY_WEIGHT, K1, Joined, Whole, hard_constraints, lexical_score, recency, result_filters
from lodeseek.plans.query import Query, parse_query
from lodeseek.runtime import materialize, shuffle_partitions

_RELEVANCE = lambda: [F.desc("score"), F.desc("mtime"), F.collate("path", "UNICODE").asc()]
ORDERS = {
    "relevance": lambda: [],
    "created-desc": lambda: [F.desc("ctime")],
    "created-asc": lambda: [F.asc("ctime")],
    "modified-desc": lambda: [F.desc("mtime")],
    "modified-asc": lambda: [F.asc("mtime")],
    "name-asc": lambda: [F.collate("basename", "UNICODE").asc()],
}
RESULT = ["path", "folder", "title", "score", "lexical_score", "semantic_score", "snippet", "verbose_snippet", "tags", "ctime", "mtime", "highlight_terms"]
#: Results up to this number have their bodies looked up by path instead of joined.
LISTED = 1_000
#: In batch search, documents and postings of a block at most, on average, and different queries that meet it in one task.
BLOCK_DOCS, BLOCK_POSTINGS, BATCH_BAGS = 65_536, 1_000_000, 50_000


@dataclass
class Response:
    query: Query
    results: DataFrame
    facets: DataFrame
    filtered: DataFrame

    def total(self) -> int:
        """Number of results after the filters and before the limit."""
        return self.filtered.count()


def candidates(index: Index, q: Query, now: int, semantic: DataFrame | None = None) -> DataFrame:
    """Documents that meet the constraints, with ``lexical_score`` and ``semantic_score``.

    A query of filters alone gives every one of them lexical 1. Otherwise a
    document needs a lexical score or a semantic one, be it 0. Term maps and
    bodies are not read: terms come from their part of the postings, and of the
    bodies, only where there are phrases, which of them hold one.
    """
    distinct = lambda *parts: list(dict.fromkeys(x for p in parts for x in p))
    terms = distinct(q.terms, q.required_terms, q.excluded_terms)
    phrases = distinct(q.phrases, q.required_phrases, q.excluded_phrases)
    across = any("\n" in p for p in phrases)  # such a phrase may begin in the metadata and end in the body
    by = Whole() if across else Joined(terms, phrases)
    docs = _hydrated(index, q) if across else index.slim
    if terms and not across:
        docs = docs.join(by.hits(index.postings), "path", "left")
    if phrases and not across:
        docs = docs.join(_held(index, q, by), "path", "left")
    docs = docs.filter(hard_constraints(q, by))
    dfs = index.frequencies(distinct(q.terms, q.required_terms))
    # Scored where the documents lie; the join then moves finished scores.
    docs = docs.withColumn("lexical_score", lexical_score(q, dfs, index.n_docs, index.average, by) if q.semantic_text else F.lit(1.0)).select(*SLIM, "lexical_score")
    if semantic is None:
        docs = docs.withColumn("semantic_score", F.lit(None).cast("double"))
    else:
        docs = docs.join(semantic.select("path", F.col("score").alias("semantic_score")), "path", "left")
    if not q.semantic_text:
        return docs
    return docs.filter((F.col("lexical_score") != 0) | F.col("semantic_score").isNotNull()).withColumn("lexical_score", F.col("lexical_score") * recency(now))


def _late(index: Index, q: Query) -> DataFrame | None:
    """Bodies that the index lacks and that the query's phrases need."""
    return index.loader(index.docs.filter(needs_body(q)).select("path")) if index.loader else None


def _held(index: Index, q: Query, by: Joined) -> DataFrame:
    own, late = by.held(index.bodies), _late(index, q)
    return own if late is None else own.join(late.select("path"), "path", "left_anti").unionByName(by.held(late))


def _hydrated(index: Index, q: Query) -> DataFrame:
    late = _late(index, q)
    return index.docs if late is None else with_bodies(index.docs, late, late)


def greatest_score(found: DataFrame) -> float:
    return max(0.0, found.agg(F.max("lexical_score")).first()[0] or 0.0)


def fused(found: DataFrame, weight: float = 0.72, top: float | None = None) -> DataFrame:
    """Add ``score``: the lexical score over the greatest of all candidates, mixed with the semantic one where there is one.

    ``top`` is the greatest lexical score where it is known already.
    """
    w = min(1.0, max(0.0, weight))
    if top is None:
        most = found.agg(F.greatest(F.coalesce(F.max("lexical_score"), F.lit(0.0)), F.lit(0.0)).alias("_top"))
        found = found.crossJoin(F.broadcast(most))
    else:
        found = found.withColumn("_top", F.lit(float(top)))
    lexical = F.when(F.col("_top") > 0, F.col("lexical_score") / F.col("_top")).otherwise(0.0)
    mixed = w * clamp(F.col("semantic_score"), 0.0, 1.0) + (1 - w) * lexical
    return found.withColumn("score", F.when(F.col("semantic_score").isNull(), lexical).otherwise(mixed)).drop("_top")


def facets(scored: DataFrame) -> DataFrame:
    """(kind, value, count) of folders and tags; a tag given twice in a note counts twice."""
    kinds = [F.array(F.struct(F.lit("folder").alias("kind"), F.col("folder").alias("value"))), F.transform("norm_tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value")))]
    return scored.select(F.explode(F.concat(*kinds)).alias("_f")).groupBy("_f.kind", "_f.value").agg(F.count(F.lit(1)).alias("count"))


def ordered_facets(counts: DataFrame) -> DataFrame:
    return counts.orderBy("kind", F.desc("count"), F.collate("value", "UNICODE"))


def search(index: Index, query: str | Query, *, now: int, semantic: DataFrame | None = None, weight: float = 0.72, sort: str = "relevance", limit: int = 10,
           folder: str | None = None, tag: str | None = None, modified_since: int | None = None, context: int = 100, zone: str = "UTC") -> Response:
    """Answer one query over ``index``.

    ``semantic`` has (path, score). Facets count the candidates before the
    result filters (folder, tag, modified_since), most frequent first. A query with errors or
    without criteria has no results. The candidates are stored once, without
    bodies; their greatest score, facets, total and best are read from there, and
    bodies for the ``limit`` results only, from the index or its loader.
    """
    q = parse_query(query, zone) if isinstance(query, str) else query
    shown_columns = ["path", "basename", "folder", "norm_tags", "tags", "ctime", "mtime", "lexical_score", "semantic_score"]
    if q.has_criteria and not q.errors:
        found = materialize(candidates(index, q, now, semantic).select(*shown_columns), "candidates")
        scored = fused(found, weight, greatest_score(found))
    else:
        scored = index.slim.filter(F.lit(False)).withColumns(dict.fromkeys(("lexical_score", "semantic_score", "score"), F.lit(None).cast("double"))).select(*shown_columns, "score")
    filtered = scored.filter(result_filters(folder, tag, modified_since))
    order = [*ORDERS[sort](), *_RELEVANCE()]
    best = filtered.orderBy(*order).limit(limit)
    paths = [r.path for r in best.select("path").collect()] if limit <= LISTED else None
    bodies = index.bodies if paths is None else index.bodies.filter(F.col("path").isin(paths))  # the files are in the order of paths
    if index.loader:
        late = index.loader(best.select("path"))
        bodies = bodies.join(late.select("path"), "path", "left_anti").unionByName(late.select(*BODY))
    shown = best.join(bodies, "path", "left").withColumns({
        "title": F.col("basename"),
        "snippet": snippet(F.col("content"), F.col("norm_content"), q.highlights),
        "verbose_snippet": verbose_snippet(F.col("content"), F.col("norm_content"), q.highlights, context),
        "highlight_terms": F.array(*[F.lit(h) for h in q.highlights]).cast("array<string>"),
    })
    return Response(q, shown.orderBy(*order).select(*RESULT), ordered_facets(facets(scored)), filtered)


def batch_search(postings: DataFrame, queries: DataFrame, term_df: DataFrame, stats: DataFrame, k: int = 10) -> DataFrame:
    """BM25 of many queries at once over the postings: (query_id, path, score, place), the best ``k`` each.

    ``queries`` has (query_id, terms array<string>); a term given twice counts
    twice. Only exact terms are matched. A row for each query, document and term they share
    would be the product of queries and documents where terms are common. So queries
    with the same terms are answered once, documents are dealt into blocks by a hash of the
    path, and a task scores one block for a batch of queries in memory; what is
    shuffled are the postings of the terms asked for, the queries once a block, and
    the k best of each query and block.
    """

    def scored(terms: DataFrame, part: Callable[[Column, Column], Column]) -> DataFrame:
        held = postings.join(sized(terms), "term", "left_semi")
        return held.select("path", F.array("term").alias("terms"), F.array(part(F.col("tf"), F.col("token_count"))).alias("parts"))

    return _answered(scored, queries, term_df, stats, k)


def batch_search_texts(texts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``batch_search`` without an index, over the tokens of each document: (path, terms array<string>), with repeats.

    Only counts of the terms asked for are stored and shuffled, a row for each document.
    """
    wanted = [r.term for r in queries.select(F.explode("terms").alias("term")).distinct().limit(BROADCAST_ROWS + 1).collect()]
    known = sorted(wanted) if len(wanted) <= BROADCAST_ROWS else None  # too many to send to each task: terms not asked for stay
    docs = materialize(texts.select("path", "terms").mapInArrow(lambda batches: counted_terms(batches, known), COUNTED), "counted")
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    term_df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def scored(_: DataFrame, part: Callable[[Column, Column], Column]) -> DataFrame:
        return docs.filter(F.size("terms") > 0).select("path", "terms", F.transform("tf", lambda tf: part(tf, F.col("token_count"))).alias("parts"))

    return _answered(scored, queries, term_df, materialize(stats, "stats"), k)


def _answered(scored: Callable[[DataFrame, Callable[[Column, Column], Column]], DataFrame], queries: DataFrame, term_df: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """``scored`` gives (path, terms, parts) from the terms asked for and the function of tf and token count that makes a part."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.join(term_df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.select("query_id", F.struct("term", (F.col("times") * idf * BODY_WEIGHT).alias("w"), "df").alias("_t"))
    bag_of = materialize(weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("_t")).alias("bag")), "asked")
    bags = materialize(bag_of.select("bag").distinct().withColumn("bag_id", F.monotonically_increasing_id()), "bags")  # stored, so the numbers stay
    terms = materialize(bags.select(F.explode("bag").alias("_t")).select("_t.term", "_t.df").distinct(), "terms")

    n_bags, held, (n_docs, n_tokens) = bags.count(), terms.agg(F.sum("df")).first()[0] or 0, stats.select("n_docs", "total_tokens").first()
    blocks = max(shuffle_partitions(spark), math.ceil(n_docs / BLOCK_DOCS), math.ceil(held / BLOCK_POSTINGS))
    batches = max(1, math.ceil(n_bags / BATCH_BAGS))
    tasks = blocks * batches
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    average = max(1.0, (n_tokens or 0) / n_docs) if n_docs else 1.0
    rows = scored(terms.select("term"), lambda tf, count: tf * (K1 + 1) / (tf + K1 * (1 - B + B * count / average)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("path"), F.lit(blocks))).withColumn("_batch", each(batches))
    rows = rows.select((F.col("_block") * batches + F.col("_batch")).cast("bigint").alias("unit"), "path", "terms", "parts")
    parts = bags.select("bag_id", F.col("bag.term").alias("terms"), F.col("bag.w").alias("weights"), F.pmod(F.xxhash64("bag_id"), F.lit(batches)).alias("_batch"))
    parts = parts.withColumn("_block", each(blocks)).select((F.col("_block") * batches + F.col("_batch")).cast("bigint").alias("unit"), "bag_id", "terms", "weights")

    def best(own: pa.Table, wanted: pa.Table) -> pa.Table:
        return best_in_block(flat_postings(own), wanted, k)

    met = rows.repartition(tasks, "unit").groupBy("unit").cogroup(parts.repartition(tasks, "unit").groupBy("unit")).applyInArrow(best, BEST)
    place = F.row_number().over(Window.partitionBy("bag_id").orderBy(F.desc(F.round("score", 9)), "path"))
    placed = met.withColumn("place", place).filter(F.col("place") <= k)
    return placed.join(bags, "bag_id").join(bag_of, "bag").select("query_id", "path", "score", "place")
