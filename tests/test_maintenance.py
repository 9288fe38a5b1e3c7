import hashlib
import os
import threading

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.display import display_mode, modified_days, modified_since, next_mode, result_columns, verbose_context
from lodeseek.functions.text import byte_size, relative_date, safe_path
from lodeseek.operators import index as ix
from lodeseek.operators.embeddings import HashingProvider
from lodeseek.operators.maintenance import chunked_embeddings, needs_body, refresh, semantic_or_reason, with_bodies
from lodeseek.operators.wordpiece import WordPiece
from lodeseek.plans.compile import hard_constraints
from lodeseek.plans.query import parse_query
from lodeseek.sources.assets import Asset, AssetStore, Manifest
from lodeseek.sources.store import IndexStore, Settings

NOTE = "path string, basename string, extension string, content string, tags array<string>, ctime bigint, mtime bigint, size bigint"


def notes(spark, *rows):
    return spark.createDataFrame([(p, p.split("/")[-1][:-3], "md", c, [], 1, m, 5) for p, c, m in rows], NOTE)


def test_display():
    assert [next_mode(m) for m in ("title", "default", "verbose", "?")] == ["default", "verbose", "title", "verbose"]
    assert display_mode(None) == "default" and result_columns("title") == ["title", "path", "score", "tags"]
    assert [verbose_context(v) for v in (None, float("nan"), 5, 100.5, 5000)] == [100, 100, 20, 101, 1000]
    now = 10**12
    assert modified_days(modified_since(7, now), now) == 7 and modified_days(now - 5, now) is None and modified_days(None, now) is None
    with pytest.raises(ValueError):
        modified_since(2, now)


def test_scalars(spark):
    now = 1_767_000_000_000
    df = spark.createDataFrame([("a/b.md", now), ("../x", now - 90_000_000), ("/abs", now - 5 * 86_400_000), ("a//b", 0), ("", now + 5)], "p string, t bigint")
    got = df.select(safe_path(F.col("p")).alias("s"), relative_date(F.col("t"), now).alias("d")).collect()
    assert [r.s for r in got] == [True, False, False, False, False]
    assert [r.d for r in got] == ["today", "yesterday", "5 days ago", "1970-01-01", "today"]
    sizes = spark.createDataFrame([(1_500_000,), (12_345,)], "n bigint").select(byte_size(F.col("n")).alias("b")).collect()
    assert [r.b for r in sizes] == ["1.5 MB", "12 KB"]


def test_refresh_measures_a_body_without_a_size(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/n")
    rows = [("a.md", "one two", None), ("b.md", "x " * 600, None), ("c.md", "one", 5000)]
    df = spark.createDataFrame([(p, p[:-3], "md", c, [], 1, 1, s) for p, c, s in rows], NOTE)
    refresh(store, df, Settings(max_file_size_kb=1), 0)
    got = {r.path: r.token_count for r in store.load(Settings(max_file_size_kb=1).signature()).collect()}
    assert got["a.md"] == 2 and got["b.md"] == got["c.md"] == 0
    assert {r.status for r in refresh(store, df, Settings(max_file_size_kb=1), 1).collect()} == {"unchanged"}


def test_refresh(spark, tmp_path):
    store, settings = IndexStore(spark, f"file://{tmp_path}/s"), Settings(ignored_folders=("skip",))
    status = lambda df: {r.path: r.status for r in df.collect()}
    assert status(refresh(store, notes(spark, ("a.md", "one", 1), ("b.md", "two", 1), ("skip/c.md", "x", 1)), settings, 0)) == {"a.md": "new", "b.md": "new"}
    assert status(refresh(store, notes(spark, ("a.md", "one", 1), ("b.md", "new words", 2), ("d.md", "four", 1)), settings, 1)) == {"a.md": "unchanged", "b.md": "changed", "d.md": "new"}
    assert {r.path: r.term_frequency for r in store.load(settings.signature()).collect()} == {"a.md": {"one": 1}, "b.md": {"new": 1, "words": 1}, "d.md": {"four": 1}}


def test_late_bodies(spark):
    docs = ix.indexed(notes(spark, ("a.md", "the red barn door", 1), ("b.md", "red door", 1), ("x/red barn do.md", "nothing", 1))).cache()
    thin = ix.restored(ix.stored_form(docs))
    q = parse_query('+"ed barn do"')
    wanted = thin.filter(needs_body(q)).select("path")
    assert [r.path for r in wanted.collect()] == ["a.md"]
    full = with_bodies(thin, docs, wanted)
    assert sorted(r.path for r in full.filter(hard_constraints(q)).collect()) == sorted(r.path for r in docs.filter(hard_constraints(q)).collect()) == ["a.md", "x/red barn do.md"]


def test_chunked_embeddings_and_reasons(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", ":", "title", "tags", "n"])}
    model, provider = WordPiece(vocab, max_length=6), HashingProvider(16)
    docs = spark.createDataFrame([("n", "n", [], "a b " * 20), ("e", "n", [], "")], "path string, basename string, tags array<string>, content string")
    got = {r.path: r.vector for r in chunked_embeddings(docs, model, provider, 3).collect()}
    assert set(got) == {"n", "e"} and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())
    cache = spark.createDataFrame([("n", provider.id, 1, 1, got["n"])], "path string, provider_id string, mtime bigint, size bigint, vector array<double>")
    assert semantic_or_reason(cache, "a", provider)[0].count() == 1
    assert semantic_or_reason(cache.limit(0), "a", provider)[1] == "the semantic index is empty"
    assert semantic_or_reason(cache, "a", HashingProvider(8))[1] == "no vector fits the provider"

    class Down:
        id = "down"

        def embed(self, texts, purpose):
            raise OSError("offline")

    assert semantic_or_reason(cache, "a", Down())[1] == "the provider failed: offline"


def test_assets(tmp_path):
    data = {"m/a.bin": b"abc", "b.json": b"{}"}
    make = lambda **k: Manifest("model-1", "a" * 40, tuple(Asset(p, f"https://x/{p}", len(d), hashlib.sha256(d).hexdigest()) for p, d in data.items()), **k)
    m, store = make(), AssetStore(str(tmp_path / "models"))
    assert m.problems() == [] and m.total_bytes == 5 and store.status(m) == "not-installed"
    with pytest.raises(ValueError):
        store.install(m, lambda a: b"wrong")
    assert os.listdir(store.root) == [] and store.status(m) == "not-installed"
    store.install(m, lambda a: data[a.path])
    assert store.status(m, True) == "ready" and store.read(m, "m/a.bin") == b"abc"
    with open(os.path.join(store.folder(m), "m/a.bin"), "wb") as f:
        f.write(b"abd")
    assert store.status(m) == "ready" and store.status(m, True) == "invalid"
    store.install(m, lambda a: data[a.path])
    assert store.status(m, True) == "ready"
    bad = Manifest("No Name", "1", (Asset("../x", "http://x", 0, "z"), Asset("../x", "http://x", 10**9, "z")))
    assert len(bad.problems()) == 12
    with pytest.raises(ValueError):
        store.install(bad, lambda a: b"")
    assert store.size(m) > m.total_bytes  # with the marker
    fetched = []
    many = AssetStore(str(tmp_path / "many"))
    threads = [threading.Thread(target=lambda: many.install(m, lambda a: (fetched.append(a.path), data[a.path])[1])) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(fetched) == sorted(data) and many.status(m, True) == "ready"
    os.makedirs(os.path.join(store.root, ".staging-dead"))
    store.sweep(-1)
    assert ".staging-dead" not in os.listdir(store.root)
    store.remove_all()
    assert store.status(m) == "not-installed"


def test_pinned_manifest():
    from lodeseek.sources.assets import PINNED

    assert PINNED.problems() == [] and PINNED.total_bytes == 23_686_811 and len(PINNED.assets) == 4
