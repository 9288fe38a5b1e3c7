import datetime
import json
import os
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions.vectors import unit
from lodeseek.operators.embeddings import HashingProvider, HttpProvider, embedded, first_token_vectors, pooled_chunks, query_scores, updated_cache, usable_cache
from lodeseek.operators.evaluate import average_metrics, floor_rank, rank_metrics, summary
from lodeseek.operators.incremental import VersionedTarget, replay_runs
from lodeseek.operators.ranks import competition_rank, spread_number
from lodeseek.operators.reconcile import reconcile, replay, stale_embeddings
from lodeseek.operators.wordpiece import WordPiece, basic_tokens, padded, token_ids, windows
from lodeseek.runtime import fresh_dir, scratch
from lodeseek.sources.store import IndexStore, Settings, should_compact
from lodeseek.sources.vault import read_corpus, read_vault
from lodeseek.storage import Folder, Taken
from lodeseek.streaming.changes import EVENT, follow, read_changes


def test_competition_rank(spark):
    values = [3.0, 3.0, 1.0, -2.0, 0.0, 1e300, float("inf"), float("-inf"), 1e-320, None, float("nan"), -0.0]
    rows = [(g, v) for g in ("a", None) for v in values]
    got = competition_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "r").collect()
    real = [v for v in values if v is not None and v == v]
    assert len(got) == len(rows)
    for r in got:
        assert r.r == (None if r.v is None or r.v != r.v else 1 + sum(x > r.v for x in real))
    assert competition_rank(spark.createDataFrame([], "g string, v double"), ["g"], "v", "r").count() == 0


def test_competition_rank_of_many(spark):
    df = spark.range(30000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 1000 / 7.0).alias("v"))
    got = competition_rank(df, ["g"], "v", "r").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r.v)
    for g, v in by.items():
        s = -np.sort(-np.array(v))
        assert all(r.r == np.searchsorted(-s, -r.v) + 1 for r in got if r.g == g)


def test_competition_rank_cuts_crowded_buckets(spark, monkeypatch):
    from lodeseek.operators import ranks

    monkeypatch.setattr(ranks, "CELL_VALUES", 50)
    monkeypatch.setattr(ranks, "CELLS", 16)
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.pmod(F.hash("id"), F.lit(3000)) / 7.0 * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1e-3) + 1e6).alias("v"))
    by = {}
    got = competition_rank(df, ["g"], "v", "r").collect()
    for r in got:
        by.setdefault(r.g, []).append(r.v)
    for g, v in by.items():
        s = -np.sort(-np.array(v))
        assert all(r.r == np.searchsorted(-s, -r.v) + 1 for r in got if r.g == g)


def test_spread_number(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").alias("g"))
    got = spread_number(df, ["g"], ["id"], "n", 16).collect()
    for g in ("hot", None):
        assert sorted(r.n for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


T0 = datetime.datetime(2026, 1, 1)
at = lambda h: T0 + datetime.timedelta(hours=h)
SCANS = "scan_id bigint, path string, mtime bigint, size bigint, seen_at timestamp_ntz, device string"
RUNS = "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def test_replay_runs(spark):
    scans = [
        (1, "a", 1, 1, at(0), "x"), (1, "a", 1, 1, at(0), "x"), (5, "a", 2, 1, at(2), "x"), (4, "a", 9, 9, at(2), "x"), (6, "a", None, 3, at(3), "x"),
        (7, "b", 1, 1, at(1), "x"), (8, "b", 2, 2, at(4), "x"), (9, "b", 1, 1, at(5), "x"), (10, "c", 5, 5, at(6), "x"), (11, None, 1, 1, at(0), "x"), (12, "d", 1, None, at(1), "x"), (13, "late", 1, 1, at(99), "x"),
    ]
    runs = [(3, at(7), at(8), "ok"), (1, at(1), at(2), "ok"), (2, at(4), at(5), "failed"), (9, at(4), None, "ok"), (8, None, at(9), "ok"), (4, at(7), at(9), "ok")]
    s, r = spark.createDataFrame(scans, SCANS), spark.createDataFrame(runs, RUNS)
    assert sorted(tuple(x) for x in replay_runs(s, r).collect()) == [(1, "a"), (1, "b"), (3, "a"), (3, "c")]
    assert replay_runs(s.limit(0), r).count() == 0 and replay_runs(s, r.limit(0)).count() == 0


def target(spark, root):
    schema = spark.createDataFrame([], "path string, mtime bigint, size bigint").schema
    return VersionedTarget(spark, root, schema, ["path"], ["mtime", "size"], compact_every=2)


def test_incremental_runs_survive_failures(spark):
    root = fresh_dir(spark, "t")
    source = lambda *rows: spark.createDataFrame(list(rows), "path string, mtime bigint, size bigint")
    assert target(spark, root).run(source(("a", 1, 1), ("b", 1, 1), (None, 1, 1), ("n", None, 1)), 1) == 1

    def breaks(df):
        return df.withColumn("size", F.when(F.col("path") == "c", F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("size")))

    with pytest.raises(Exception, match="lost"):
        target(spark, root).run(source(("a", 2, 1), ("b", 1, 1), ("c", 1, 1)), 2, breaks)
    assert target(spark, root).versions() == [1]
    again = target(spark, root)
    assert again.run(source(("a", 2, 1), ("b", 1, 1), ("c", 1, 1)), 3) == 2
    assert again.run(source(("a", 3, 1)), 3) is None  # published already
    assert again.run(source(("a", 2, 1), ("b", 1, 1), ("c", 1, 1)), 4) == 3
    assert sorted((x.run_id, x.path) for x in again.changes().collect()) == [(1, "a"), (1, "b"), (3, "a"), (3, "c")]
    assert sorted((x.path, x.mtime) for x in again.current().collect()) == [("a", 2), ("b", 1), ("c", 1)]
    assert again.folder.numbers("base") == [2]


def test_two_runs_cannot_publish_one_version(spark):
    root = fresh_dir(spark, "t")
    first, rows = target(spark, root), spark.createDataFrame([("a", 1, 1)], "path string, mtime bigint, size bigint")

    def meanwhile(df):
        target(spark, root).run(rows, 7)
        return df

    with pytest.raises(RuntimeError, match="published"):
        first.run(rows, 8, meanwhile)
    assert [x.run_id for x in first.changes().collect()] == [7]


def test_publication_is_exclusive(spark, monkeypatch):
    """A writer that comes between another's look and its rename, and many at the same time."""
    folder, other = Folder(spark, root := fresh_dir(spark, "t")), Folder(spark, root)
    late = []

    def looked(name):
        if not late:
            late.append(name)
            staged(other, "second")
            with pytest.raises(Taken):
                other.publish("second", "change=1")
        return False

    def staged(f, name):
        f.fs.mkdirs(f._path(f.at(name)))
        f.touch(f"{name}/{name}")

    staged(folder, "first")
    monkeypatch.setattr(folder, "exists", looked)
    folder.publish("first", "change=1")
    assert folder.numbers("change") == [1] and folder.names("change=1") == ["first"] and "_claim-change=1" not in folder.names()
    won = []

    def race(i):
        own = Folder(spark, root)
        staged(own, f"s{i}")
        try:
            own.publish(f"s{i}", "change=2")
            won.append(i)
        except Taken:
            pass

    threads = [threading.Thread(target=race, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and folder.names("change=2") == [f"s{won[0]}"]


def test_a_dead_claim_ends_and_dead_staging_goes(spark, monkeypatch):
    from lodeseek import storage

    folder = Folder(spark, fresh_dir(spark, "t"))
    folder.touch("_claim-change=1")
    folder.fs.mkdirs(folder._path(folder.at("_staging-x")))
    with pytest.raises(Taken):
        folder.publish("_staging-x", "change=1")
    assert folder.sweep() == []
    monkeypatch.setattr(storage, "LEASE_S", -1)
    folder.publish("_staging-x", "change=1")
    folder.fs.mkdirs(folder._path(folder.at("_staging-y")))
    assert folder.numbers("change") == [1] and folder.sweep(-1) == ["_staging-y"]


def test_reconcile_and_replay(spark):
    f = "path string, mtime bigint, size bigint"
    plan = reconcile(spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("n", None, 1)], f), spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("z", 1, 1)], f))
    assert {r.path: r.status for r in plan.collect()} == {"a": "unchanged", "b": "changed", "n": "new", "z": "removed"}
    log = spark.createDataFrame([("a", 3, "remove", 0), ("a", 5, "upsert", 7), ("b", 1, "upsert", 1), ("b", 2, "remove", None), ("c", 1, "what", 1), (None, 9, "upsert", 1)], "k string, seq int, op string, v int")
    snap = spark.createDataFrame([("a", 1), ("b", 1), ("d", 4)], "k string, v int")
    assert {r.k: r.v for r in replay(snap, log, "k", ["v"]).collect()} == {"a": 7, "d": 4}


def test_embeddings(spark):
    docs = spark.createDataFrame([("a", "A", ["t"], "x", 1, 1), ("b", "B", [], "y", 2, 2), ("c", "C", [], "z", 3, 3)], "path string, basename string, tags array<string>, content string, mtime bigint, size bigint")
    p = HashingProvider(8)
    cached = spark.createDataFrame([("a", p.id, 1, None, [1.0, 0.0]), ("b", "other", 2, 2, [0.0, 1.0]), ("gone", p.id, 1, 1, [1.0, 1.0])], "path string, provider_id string, mtime bigint, size bigint, vector array<double>")
    assert sorted(r.path for r in stale_embeddings(docs, cached, p.id).collect()) == ["b", "c"]
    new = {r.path: r for r in updated_cache(docs, cached, p, 2).collect()}
    assert set(new) == {"a", "b", "c"} and new["a"].size == 1 and new["c"].provider_id == p.id
    assert np.linalg.norm(new["b"].vector) == pytest.approx(1)
    bad = spark.createDataFrame([("z", p.id, 1, 1, [0.0]), ("n", p.id, 1, 1, None), ("i", p.id, 1, 1, [float("inf")]), ("w", p.id, 1, 1, [3.0, 4.0])], cached.schema)
    assert [(r.path, r.score) for r in query_scores(usable_cache(bad), [1.0, 0.0], p.id).collect()] == [("w", pytest.approx(0.6))]

    class Short:
        id = "short"

        def embed(self, texts, purpose):
            return [[1.0]]

    with pytest.raises(Exception, match="1 vectors for"):
        embedded(spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string").coalesce(1), Short()).collect()
    pooled = pooled_chunks(spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 5.0]), ("b", [0.0, 1.0])], "path string, vector array<double>"))
    assert {r.path: [round(x, 6) for x in r.vector] for r in pooled.collect()} == {"a": [0.707107, 0.707107], "b": [0.0, 1.0]}
    assert first_token_vectors(np.arange(24.0).reshape(2, 3, 4), 4).tolist() == [[0, 1, 2, 3], [12, 13, 14, 15]]
    with pytest.raises(ValueError):
        first_token_vectors(np.zeros((2, 3, 5)), 4)


    with pytest.raises(Exception, match="no usable vector"):
        pooled_chunks(spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 0.0])], "path string, vector array<double>")).collect()
    calls = spark.sparkContext.accumulator(0)
    assert updated_cache(docs, cached, p, 2, progress=calls).count() == 3 and calls.value >= 2


def test_pooled_chunks_of_filtered_rows(spark):
    """The error of an unusable chunk must not be raised for rows that a filter leaves out."""
    rows = [("a", [2.0, 0.0]), ("a", [0.0, 5.0]), ("a", [0.0, 0.0]), ("a", None), ("b", []), ("b", [0.0, 1.0]), ("b", [float("nan"), 1.0])]
    path = fresh_dir(spark, "chunks")
    spark.createDataFrame(rows, "path string, vector array<double>").write.parquet(path)
    chunks = spark.read.parquet(path)
    pooled = pooled_chunks(chunks.filter(unit(F.col("vector")).isNotNull()))
    assert {r.path: [round(x, 6) for x in r.vector] for r in pooled.collect()} == {"a": [0.707107, 0.707107], "b": [0.0, 1.0]}
    for unusable in ([0.0, 0.0], None, [], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="no usable vector"):
            pooled_chunks(spark.createDataFrame([("a", [1.0, 2.0]), ("a", unusable)], "path string, vector array<double>")).collect()
    with pytest.raises(Exception, match="cancel out"):
        pooled_chunks(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [-1.0, -2.0])], "path string, vector array<double>")).collect()


def test_pooled_chunks_of_many_and_few_chunks(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 2 else f"p{i % 40}", rng.normal(size=3 if i % 7 else 5).tolist()) for i in range(400)] + [(None, [3.0, 4.0]), (None, [3.0, 4.0])]
    want = {}
    for path, v in rows:
        total = want.setdefault(path, np.zeros(5))
        total[: len(v)] += np.array(v) / np.linalg.norm(v)
    pooled = pooled_chunks(spark.createDataFrame(rows, "path string, vector array<double>").repartition(6))
    got = {r.path: r.vector for r in pooled.collect()}
    assert got.keys() == want.keys() and got[None] == [0.6, 0.8]
    assert all(np.allclose(np.pad(v, (0, 5 - len(v))), want[p] / np.linalg.norm(want[p])) for p, v in got.items())
    plan = pooled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(path") == 1


def test_models(spark):
    from lodeseek.operators.models import LazyProvider, TokenModel, check_interface, check_size, mean_vector, provider_id

    assert provider_id("r" * 40, "rt@1", 384) == f"on-device:{'r' * 40}:rt@1:cls-384:l2-normalized:query-prefix-v1:chunks-12:cache-v1"
    with pytest.raises(ValueError, match="token_type_ids, last_hidden_state"):
        check_interface(["input_ids", "attention_mask"], ["x"])
    with pytest.raises(ValueError, match="2 bytes"):
        check_size(b"ab", 3)
    seen = []

    def infer(inputs):
        seen.append(inputs["input_ids"].shape)
        ids = inputs["input_ids"]
        return np.stack([np.full((ids.shape[1], 4), float(row.sum())) + np.arange(4) for row in ids])

    tokenizer = WordPiece(VOCAB, max_length=4)
    made = []
    provider = LazyProvider(lambda: (made.append(1), TokenModel(tokenizer, infer, 4, "t"))[1], "t", 4)
    assert not provider.ready and provider.embed([]) == []
    vectors = provider.embed(["cafe " * 40, "", "un"])
    assert provider.ready and len(made) == 1 and len(provider.latencies) == 1 and sum(s[0] for s in seen) == 12 + 1 + 1 and max(s[0] for s in seen) == 8
    assert all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in vectors) and len(provider.embed(["x"], "query")) == 1 and provider.requests == 2
    provider.cancel()
    with pytest.raises(RuntimeError, match="cancelled"):
        provider.embed(["x"])
    provider.resume()
    provider.dispose()
    assert not provider.ready and len(provider.embed(["un"])) == 1 and len(made) == 2
    for bad in ([], [np.zeros(4)], [np.ones(4), -np.ones(4)], [np.ones(3)], [np.full(4, np.nan)]):
        with pytest.raises(ValueError):
            mean_vector(bad, 4)


def test_lifecycle(spark, tmp_path):
    from lodeseek.operators.lifecycle import ScoreCache, Status, StatusFeed, removed_everywhere, superseding

    heard, feed = [], StatusFeed()
    end = feed.subscribe(heard.append)
    feed.set(phase="lexical", total=3)
    feed.set(phase="lexical")
    end()
    feed.set(phase="ready")
    assert heard == [Status(), Status("lexical", total=3)] and feed.status.phase == "ready"
    with pytest.raises(ValueError):
        feed.set(phase="done")
    cache, made = ScoreCache(2), []
    ask = lambda text: cache.get("p", text, lambda: (made.append(text), spark.range(1))[1])
    [ask(t) for t in ("a", "b", "a", "c", "a")]
    assert made == ["a", "b", "c", "a"] and len(cache) == 2
    with superseding(spark, "index") as first:
        assert first()
        with superseding(spark, "index") as second:
            assert second() and not first()
    store = IndexStore(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([("a",), ("b",)], "path string")
    left = removed_everywhere(spark.createDataFrame([("a",), ("z",)], "path string"), docs, docs, store, 5, cache)
    assert [[r.path for r in d.collect()] for d in left] == [["b"], ["b"]] and len(cache) == 0
    assert [(r.seq, r.op, r.path) for r in store.log().collect()] == [(5, "remove", "a")]


def test_the_package_can_be_shipped(spark, tmp_path):
    """A driver elsewhere, whose executors have no path to the package, sends it to them."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
from lodeseek.runtime import ship
from lodeseek.functions.vectors import unit
from lodeseek.operators.embeddings import HashingProvider, embedded
ship(s)
print('rows', embedded(s.createDataFrame([('a', 'x')], 'path string, text string'), HashingProvider(4)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_scratch_deletes(spark):
    from lodeseek.runtime import materialize

    with scratch(spark):
        inner = materialize(spark.range(3), "x")
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert inner.count() == 3
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_http_provider():
    sent = []
    p = HttpProvider(" http://h:1// ", "m", lambda url, body: (sent.append((url, body)), (200, {"embeddings": [[1, 2]]}))[1])
    assert p.embed(["x"]) == [[1, 2]] and sent == [("http://h:1/api/embed", {"input": ["x"], "model": "m", "truncate": True})]
    with pytest.raises(ValueError):
        HttpProvider("http://h/api/embed", "m", lambda *_: (500, {})).embed(["x"])


def test_summary_rules(spark):
    data = [("a", float(x)) for x in (5, 1, 1, 3, 9, 7)] + [("b", 2.0), (None, 4.0), (None, 6.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    floor = {r.k: (r.n, r.median, r.p95) for r in summary(df, ["k"], "v", "floor").collect()}
    assert floor == {"a": (6, 5.0, 9.0), "b": (1, 2.0, 2.0), None: (2, 6.0, 6.0), "c": (0, None, None)}
    assert {r.k: r.median for r in summary(df, ["k"], "v").collect()}["a"] == 3.0


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, path string, place int")
    qrels = spark.createDataFrame([(1, "b"), (1, "b"), (1, "q"), (3, "z")], "query_id int, path string")
    m = {r.query_id: r for r in rank_metrics(ranking, qrels).collect()}
    assert (m[1].precision, m[1].recall, m[1].reciprocal_rank, m[1].relevant) == (0.1, 0.5, 0.5, 2)
    assert m[2].recall == 0 and m[3].reciprocal_rank == 0
    assert average_metrics(rank_metrics(ranking, qrels)).first().hits == 1
    assert average_metrics(rank_metrics(ranking.limit(0), qrels.limit(0))).first().precision == 0
    assert spark.range(1).select(floor_rank(F.sort_array(F.array(*map(F.lit, [4, 1, 3, 2]))), 0.95).alias("x")).first().x == 4


VOCAB = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "!", "cafe", "日"])}


def test_wordpiece(spark):
    m = WordPiece.load({"model": {"type": "WordPiece", "vocab": VOCAB}, "truncation": {"max_length": 5}})
    assert basic_tokens("Un​affable!  CAFÉ日") == ["unaffable", "!", "cafe", "日"]
    assert m.ids("unaffable! Café zzz") == [4, 5, 6, 7, 8, 1] and m.ids("u" * 200) == [1] and m.encode("unaffable! cafe") == [2, 4, 5, 6, 3]
    with pytest.raises(ValueError):
        WordPiece.load({"model": {"type": "BPE", "vocab": {}}})
    df = token_ids(spark.createDataFrame([("unaffable cafe",), (None,)], "t string"), m, "t")
    got = [r.w for r in df.select(windows(F.col("ids"), 3, 2, 3, 12).alias("w")).collect()]
    assert got == [[[2, 4, 5, 6, 3], [2, 8, 3]], [[2, 3]]]
    assert padded([[1, 2], [3]], 0)["attention_mask"].tolist() == [[1, 1], [1, 0]]


def test_settings_and_policy():
    assert Settings(ignored_folders=(" /b/ ", "a", "")).signature() == Settings(ignored_folders=("a", "b")).signature() == '{"ignoredFolders":["a","b"],"maxFileSizeKb":1024}'
    assert should_compact(500, 0) and should_compact(1, 30) and not should_compact(0, 99) and should_compact(0, 0, changed=500)


def test_store_and_stream(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/store")
    sign = Settings().signature()
    assert store.load(sign) is None
    empty = spark.createDataFrame([], "path string, basename string, extension string, tags array<string>, ctime bigint, mtime bigint, size bigint, term_frequency map<string,bigint>, token_count bigint")
    store.compact(empty, sign, -1)
    folder = tmp_path / "changes"
    folder.mkdir()
    note = lambda p, text: {"path": p, "basename": p, "extension": "md", "content": text, "tags": [], "ctime": 1, "mtime": 2, "size": 3}
    events = [(1, "create", "a", None, note("a", "one two")), (2, "create", "b", None, note("b", "b b")), (3, "modify", "a", None, note("a", "three")), (4, "rename", None, "b", note("c", "b b")), (5, "create", "d", None, note("d", "x")), (6, "delete", "d", None, None)]
    (folder / "1.json").write_text("".join(json.dumps(dict(zip(("seq", "event", "path", "old_path", "note"), e))) + "\n" for e in events[:3]))
    follow(store, read_changes(spark, str(folder)), f"{tmp_path}/cp", once=True).awaitTermination(120)
    (folder / "2.json").write_text("".join(json.dumps(dict(zip(("seq", "event", "path", "old_path", "note"), e))) + "\n" for e in events[3:]))
    follow(store, read_changes(spark, str(folder)), f"{tmp_path}/cp", once=True).awaitTermination(120)
    (tmp_path / "store/log/part-damaged.txt").write_text('{"seq": 99, "op": "upsert"\nnot json\n{"seq": 98, "op": "upsert", "path": "q", "document": {"path": "q"}}\n')
    state = {r.path: r.term_frequency for r in store.load(sign).collect()}
    assert state == {"a": {"three": 1}, "c": {"b": 2}}
    assert store.load("other settings") is None
    store.compact(store.load(sign), sign, 13)
    assert {r.path for r in store.load(sign).collect()} == {"a", "c"} and store.operations() == 0
    assert len(store._upto()) == 2  # the snapshot before still needs them
    store.compact(store.load(sign), sign, 14)
    assert store._upto() == {} and {r.path for r in store.load(sign).collect()} == {"a", "c"}
    (folder / "3.json").write_text(json.dumps(dict(zip(("seq", "event", "path", "old_path", "note"), (8, "create", "e", None, note("e", "e"))))) + "\n")
    follow(store, read_changes(spark, str(folder)), f"{tmp_path}/cp", once=True, signature=sign).awaitTermination(120)
    assert store.operations() == 1 and store.maintain(sign) is None and store.maintain(sign, idle_s=30) == 4 and store.operations() == 0
    assert {r.path for r in store.load(sign).collect()} == {"a", "c", "e"}
    assert EVENT


def test_changes_during_a_rebuild_are_kept(spark, tmp_path):
    from lodeseek.streaming.changes import log_batch, newest, operations, still_there

    note = lambda p, text: (p, p, "md", text, [], 1, 2, 3)
    events = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    store, sign = IndexStore(spark, f"file://{tmp_path}/s"), Settings().signature()
    empty = spark.createDataFrame([], "path string, basename string, extension string, tags array<string>, ctime bigint, mtime bigint, size bigint, term_frequency map<string,bigint>, token_count bigint")
    assert store.last() == -1
    store.compact(empty, sign, -1)
    log_batch(store, events((1, "create", "a", None, note("a", "one"))))
    before, built = store.last(), store.load(sign).persist()
    assert before == 3 and built.count() == 1
    log_batch(store, events((2, "modify", "a", None, note("a", "two")), (3, "create", "b", None, note("b", "x"))))
    store.compact(built, sign, before)
    assert {r.path: r.term_frequency for r in store.load(sign).collect()} == {"a": {"two": 1}, "b": {"x": 1}}
    ops = newest(operations(events((1, "create", "a", None, note("a", "one")), (2, "create", "gone", None, note("gone", "x")))))
    assert {r.path: (r.op, r.note is None) for r in still_there(ops, spark.createDataFrame([("a",)], "path string")).collect()} == {"a": ("upsert", False), "gone": ("remove", True)}


def test_vault_of_an_odd_name(spark, tmp_path):
    root = tmp_path / "a(b)+[c]"
    root.mkdir()
    (root / "x.md").write_text("---\ntitle: t\ntags:\n  - one\n  - 'two words'\nother: 1\n---\n#three")
    (root / "y.md").write_text("---\nno end #four")
    got = {x.path: x.tags for x in read_vault(spark, str(root)).collect()}
    assert got == {"x.md": ["one", "two words", "three"], "y.md": ["four"]}


def test_vault(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir/Note é.md").write_text("---\ntags: [x, y]\n---\nBody #inline and C# #12 no\n")
    (tmp_path / "skip.txt").write_text("x")
    r = read_vault(spark, str(tmp_path)).collect()
    assert [(x.path, x.basename, x.tags) for x in r] == [("sub dir/Note é.md", "Note é", ["x", "y", "inline"])]
    (tmp_path / "catalog.json").write_text(json.dumps([{"file": "sub dir/Note é.md", "path": "P/Q.md", "ctime": "2026-01-01", "mtime": "2026-01-02", "tags": ["t"]}]))
    c = read_corpus(spark, str(tmp_path / "catalog.json"), str(tmp_path)).first()
    assert (c.path, c.basename, c.ctime) == ("P/Q.md", "Q", 1767225600000)
