import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import index as ix
from lodeseek.operators.evaluate import digest
from lodeseek.plans.compile import hard_constraints
from lodeseek.plans.query import parse_query
from lodeseek.plans.search import search
from lodeseek.runtime import materialize
from lodeseek.sources.generators import cycled_vault, scale_notes

NOW = 1_789_300_800_000
# The queries behind the published digests.
QUERIES = (
    ("meaning-text", "coordination ownership handoff", {}),
    ("required-phrase", '+"decision record"', {}),
    ("excluded-term", "release -draft", {}),
    ("required-and-excluded-phrase", '+consensus -"split brain"', {}),
    ("tag-and-created-date", "tag:research createdafter:2025-01-01", {}),
    ("path-and-modified-date", 'path:"Projects/Search" modifiedbefore:2025-01-01', {}),
    ("file-and-required-phrase", 'file:incident +"failure review"', {}),
    ("filter-only-name-sort", "tag:reference", {"sort": "name-asc"}),
)
# Published digests of the scale corpus and of the ordered results by number of notes.
DIGESTS = {
    100: ("705c9ff480da5ad54a0386a353ab5e915c369ecc8ed58dd1ce6cd7622df02af8", "877a97fe821ec983148f852d2979850913a86bce04c3c8d908ccf9e2faa3250a"),
    1000: ("903c6ec7da75306a99ecb0fdee76f04baea364472a6ca723c4b9089ea1228407", "f708a58a343dd1c0d7472385b12d87fa36f8c1e0a394358fd492f60f179e9112"),
    10000: ("a8da8337eb6670893748dee9a5e47b6f20f0f2a1bfdd0e0e7294dc45fdde3492", "ba63aa14f4bd831ae77cb6e9f6634ce6958b03fba522484c0f73369ce3f83e8c"),
}


@pytest.mark.parametrize("count", sorted(DIGESTS))
def test_scale_digests(spark, count):
    notes = materialize(scale_notes(spark, count), "scale")
    corpus = [[r.path, r.basename, r.extension, r.content, r.tags, r.ctime, r.mtime] for r in notes.orderBy("seq").collect()]
    assert digest(corpus) == DIGESTS[count][0]
    index = ix.Index.of(materialize(ix.indexed(notes), "docs"))
    found = []
    for name, query, options in QUERIES:
        response = search(index, query, now=NOW, **options)
        found.append({"id": name, "results": [r.path for r in response.results.select("path").collect()], "totalBeforeLimit": response.total()})
    assert digest(found) == DIGESTS[count][1]


NOTES = [
    ("a/Garden plan.md", "Garden plan", "md", "Soil and water. The ﬁg tree.", ["#Home", "home"], 1000, 2000, 10),
    ("b/Ｗater.md", "Ｗater", ".MD", "Garden soil needs care; garden again.", None, 1000, 3000, 10),
    ("c.md", "c", "md", None, ["x y", "z"], 1000, 4000, 10),
]
SCHEMA = "path string, basename string, extension string, content string, tags array<string>, ctime bigint, mtime bigint, size bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return ix.indexed(spark.createDataFrame(NOTES, SCHEMA)).cache()


def paths(df):
    return [r.path for r in df.collect()]


def test_index_columns(docs):
    d = {r.path: r for r in docs.collect()}
    assert d["a/Garden plan.md"].norm_tags == ["home", "home"] and "fig" in d["a/Garden plan.md"].tf
    assert d["b/Ｗater.md"].norm_name == "water" and d["b/Ｗater.md"].norm_ext == "md" and d["b/Ｗater.md"].tf["garden"] == 2
    assert d["c.md"].token_count == 0 and d["c.md"].tf == {} and d["c.md"].folder == "/"


def test_title_beats_body_and_prefix_terms(docs):
    index = ix.Index.of(docs)
    assert paths(search(index, "garden", now=5000).results) == ["a/Garden plan.md", "b/Ｗater.md"]
    assert paths(search(index, "gar -again", now=5000).results) == ["a/Garden plan.md"]
    assert paths(search(index, '"x y z"', now=5000).results) == []
    crossing = parse_query('+"x y z"')  # a phrase over two tags meets the constraint, but has no score of its own
    assert paths(docs.filter(hard_constraints(crossing))) == ["c.md"] and paths(search(index, crossing, now=5000).results) == []


def test_errors_and_no_criteria_give_nothing(docs):
    index = ix.Index.of(docs)
    for query in ("", '"', "bad:filter"):
        response = search(index, query, now=5000)
        assert response.total() == 0 and response.results.count() == 0 and response.facets.count() == 0


def test_semantic_fusion_and_facets(spark, docs):
    index = ix.Index.of(docs)
    scores = spark.createDataFrame([("c.md", 0.9), ("b/Ｗater.md", 0.0)], "path string, score double")
    response = search(index, "garden", now=5000, semantic=scores, weight=0.8, tag="#z".removeprefix("#"))
    assert paths(response.results) == ["c.md"]
    assert {(r.kind, r.value): r["count"] for r in response.facets.collect()}[("tag", "home")] == 2
    everything = {r.path: r for r in search(index, "garden", now=5000, semantic=scores, weight=0.8).results.collect()}
    assert everything["a/Garden plan.md"].score == 1.0 and everything["c.md"].score == pytest.approx(0.72)


def test_upsert_remove_and_restore(spark, docs):
    changed = spark.createDataFrame([("c.md", "c", "md", "new words", [], 1, 2, 3)], SCHEMA)
    after = ix.upserted(docs, changed)
    assert ix.corpus_stats(after).first().total_tokens == ix.corpus_stats(docs).first().total_tokens + 2
    assert {r.term: r.df for r in ix.document_frequency(ix.removed(docs, docs.filter("folder = 'b'"))).collect()}.get("garden") is None
    back = ix.restored(ix.stored_form(docs))
    assert {r.path: (r.tf, r.token_count) for r in back.collect()} == {r.path: (r.tf, r.token_count) for r in docs.collect()}


def test_fuzzy_and_snippets(spark):
    row = spark.createDataFrame([("garden plan", "---\na: b\n---\none  two\nneedle three" + "x" * 300)], "v string, c string")
    score = lambda q: row.select(T.fuzzy_score(F.col("v"), q).alias("s")).first().s
    assert score("gdn") == pytest.approx(3 / 11 * 0.45 + 1 / 3 * 0.43 + 0.12)
    assert score("garden") == pytest.approx(6 / 11 * 0.45 + 0.43 + 0.12) and score("zz") == 0 and score("") == 0 and score("garden plan at length") == 0
    cut = row.select(T.snippet(F.col("c"), T.fold("c"), ["needle"]).alias("s"), T.verbose_snippet(F.col("c"), T.fold("c"), [], 20).alias("v")).first()
    assert cut.s.startswith("one two needle three") and cut.s.endswith("x…")
    assert cut.v.startswith("one two needle") and len(cut.v) < 260


def test_normalization_of_expanding_characters(spark):
    df = spark.createDataFrame([("Ⅷ ﬁ ½ é Ａ",), ("plain",), (None,), ("",)], "t string")
    assert {r.t: r.n for r in T.with_normalized(df, {"n": "t"}).collect()} == {t: None if t is None else T.normalize_text(t) for t in ("Ⅷ ﬁ ½ é Ａ", "plain", None, "")}


def test_highlight():
    assert T.highlight("Rain barrel, rainy", ["rain", "rain barrel"]) == [("Rain barrel", True), (", ", False), ("rain", True), ("y", False)]
    assert T.highlight("abc", []) == [("abc", False)]


def test_cycled_vault(spark):
    corpus = spark.createDataFrame(NOTES, SCHEMA).fillna("", ["content"])
    made = cycled_vault(spark, corpus, 7)
    assert made.count() == 7 and made.select("path").distinct().count() == 7


def test_batch_search_cuts_hot_terms(spark, docs, monkeypatch):
    from lodeseek.operators import skew
    from lodeseek.plans.search import batch_search

    asked = spark.createDataFrame([(1, ["garden", "soil"]), (2, ["soil", "soil", "nothing"]), (3, [])], "query_id bigint, terms array<string>")
    run = lambda: sorted((r.query_id, r.path, round(r.score, 9), r.place) for r in batch_search(ix.postings(docs), asked, ix.document_frequency(docs), ix.corpus_stats(docs)).collect())
    plain = run()
    monkeypatch.setattr(skew, "LOAD", 1)
    assert run() == plain and {r[0] for r in plain} == {1, 2}


def _most_rows(node):
    """The most rows that an operator of an executed plan gave out."""
    kind = node.getClass().getSimpleName()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(_most_rows, below)])


def test_batch_search_makes_no_product(spark):
    from lodeseek.plans.search import batch_search

    n = 300
    postings = spark.createDataFrame([(f"n{i:03}", 5, t, 1 + i % 3) for i in range(n) for t in ("the", f"w{i}")], "path string, token_count bigint, term string, tf bigint")
    asked = spark.createDataFrame([(i, ["the", f"w{i}"]) for i in range(n)], "query_id bigint, terms array<string>")
    found = batch_search(postings, asked, postings.groupBy("term").count().withColumnRenamed("count", "df"), spark.createDataFrame([(n, 5 * n)], "n_docs bigint, total_tokens bigint"), 2)
    assert {r.path: r.query_id for r in found.collect() if r.place == 1} == {f"n{i:03}": i for i in range(n)}
    assert _most_rows(found._jdf.queryExecution().executedPlan()) < n * n / 4


def test_batch_search_against_brute_force(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from lodeseek.plans import search as engine

    pick = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    notes = {f"{'é' if i % 9 == 0 else 'z'}/{i % 7}/{i}": [words[int(40 * pick.random() ** 2.5)] for _ in range(pick.choice([3, 3, 8]))] for i in range(400)}
    asks = {i: [pick.choice(words[: 2 if i % 5 == 0 else 40]) for _ in range(i % 5)] for i in range(60)} | {90: ["w0"], 91: ["w0"], 92: ["w1", "w0", "w0"], None: ["w39", "gone"]}
    df = Counter(t for v in notes.values() for t in set(v))
    average = sum(map(len, notes.values())) / len(notes)

    def score(words, asked):
        own = Counter(words)
        return sum(math.log(1 + (400 - df[t] + 0.5) / (df[t] + 0.5)) * 3 * own[t] * 2.35 / (own[t] + 1.35 * (0.3 + 0.7 * len(words) / average)) for t in asked if own[t])

    want = []
    for q, asked in asks.items():
        ranked = sorted((-round(score(v, asked), 9), p.encode(), p) for p, v in notes.items() if set(v) & set(asked))[:10]
        want += [(q, p, -s, i + 1) for i, (s, _, p) in enumerate(ranked)]
    rows = [(p, len(v), t, c) for p, v in notes.items() for t, c in Counter(v).items()]
    postings = spark.createDataFrame(rows, "path string, token_count bigint, term string, tf bigint").repartition(5)
    queries = spark.createDataFrame(list(asks.items()), "query_id bigint, terms array<string>")
    terms, stats = spark.createDataFrame(list(df.items()), "term string, df bigint"), spark.createDataFrame([(400, sum(map(len, notes.values())))], "n_docs bigint, total_tokens bigint")
    by = lambda r: (str(r[0]), r[3])
    for docs, batch in ((65_536, 50_000), (30, 9)):
        monkeypatch.setattr(engine, "BLOCK_DOCS", docs)
        monkeypatch.setattr(engine, "BATCH_BAGS", batch)
        got = [(r.query_id, r.path, round(r.score, 9), r.place) for r in engine.batch_search(postings, queries, terms, stats).collect()]
        assert sorted(got, key=by) == sorted(want, key=by)


def test_batch_search_of_texts_equals_that_of_postings(spark, docs, monkeypatch):
    from lodeseek.functions.text import tokens
    from lodeseek.plans import search as engine

    texts = docs.select("path", tokens(F.col("norm_content")).alias("terms"))
    asked = spark.createDataFrame([(1, ["garden", "soil"]), (2, ["soil", "soil", "nothing"]), (3, []), (4, ["nothing"])], "query_id bigint, terms array<string>")
    rows = lambda df: sorted((r.query_id, r.path, round(r.score, 9), r.place) for r in df.collect())
    want = rows(engine.batch_search(ix.postings(docs), asked, ix.document_frequency(docs), ix.corpus_stats(docs)))
    assert want and rows(engine.batch_search_texts(texts, asked)) == want
    assert rows(engine.batch_search_texts(texts, asked.filter("query_id > 2"))) == []
    monkeypatch.setattr(engine, "BROADCAST_ROWS", 1)
    assert rows(engine.batch_search_texts(texts, asked)) == want


def test_best_in_block_keeps_ties_by_path():
    import pyarrow as pa

    from lodeseek.operators.blocks import best_in_block

    paths = [f"p{i:04}" for i in range(3000)]
    part = [1.0 + (i % 3 == 0) * 4e-10 - (i % 3 == 1) * 1e-12 for i in range(3000)]  # equal at 9 decimals
    postings = pa.table({"path": paths[::-1] + ["p0007"], "term": ["a"] * 3001, "part": part[::-1] + [0.5]})
    bags = pa.table({"bag_id": [4, 5], "terms": [["a"], ["none"]], "weights": [[1.0], [1.0]]})
    assert best_in_block(postings, bags, 4)["path"].to_pylist() == ["p0007", "p0000", "p0001", "p0002"]
    assert best_in_block(postings.slice(0, 0), bags, 4).num_rows == 0


def test_sized_broadcasts(spark):
    from lodeseek.operators.skew import sized

    rows = spark.range(5)
    plan = lambda n: spark.range(10).join(sized(rows, n), "id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(4)


def test_late_bodies_of_phrases_and_results(spark, docs):
    thin = ix.restored(ix.stored_form(docs))
    asked = []

    def load(paths):
        asked.append(sorted(r.path for r in paths.collect()))
        return docs.join(paths, "path", "left_semi").select(*ix.BODY)

    full, late = ix.Index.of(docs), ix.Index.of(thin, load)
    for query in ('+"soil and"', 'garden -"needs care"', "garden"):
        a, b = (search(i, query, now=5000).results.select("path", "score", "snippet", "highlight_terms").collect() for i in (full, late))
        assert a == b and len(a) > 0
    assert asked[0] == ["a/Garden plan.md", "b/Ｗater.md", "c.md"] and search(full, "garden", now=5000).facets.first().kind == "folder"
