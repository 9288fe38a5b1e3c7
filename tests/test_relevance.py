"""The published relevance table, where its corpus is at hand: RELEVANCE_CORPUS names its folder."""

import json
import os

import pytest

from lodeseek.operators import index as ix
from lodeseek.operators.evaluate import average_metrics, fixture_scores, rank_metrics
from lodeseek.plans.query import calendar_millis
from lodeseek.plans.search import search
from lodeseek.runtime import materialize
from lodeseek.sources.vault import read_corpus

ROOT = os.environ.get("RELEVANCE_CORPUS", "")
# Published precision, recall and reciprocal rank at 10, lexical and with fixture scores, by case and on average.
TABLE = {
    "async-coordination": ((0.2, 0.667, 1.0), (0.3, 1.0, 1.0)), "distributed-resilience": ((0.3, 1.0, 0.5), (0.3, 1.0, 1.0)), "concept-retrieval": ((0.2, 1.0, 0.25), (0.2, 1.0, 1.0)),
    "recovery-playbook": ((0.2, 1.0, 0.5), (0.2, 1.0, 1.0)), "self-serve-handoff": ((0.3, 1.0, 1.0), (0.3, 1.0, 1.0)),
}
MACRO = ((0.24, 0.933, 0.65), (0.26, 1.0, 1.0))


@pytest.mark.skipif(not ROOT, reason="the corpus is not part of this repository")
def test_relevance_table(spark):
    notes = read_corpus(spark, os.path.join(ROOT, "corpus/catalog.json"), os.path.join(ROOT, "corpus"))
    index = ix.Index.stored(materialize(ix.indexed(notes), "docs"))
    now = calendar_millis("2026-09-01")
    with open(os.path.join(ROOT, "cases.json")) as f:
        cases = json.load(f)
    assert index.n_docs == 21 and len(cases) == 8
    rankings, relevant = {False: [], True: []}, []
    for i, case in enumerate(cases):
        if case["kind"] == "constraint":
            found = search(index, case["query"], now=now).results.select("path").collect()
            assert sorted(r.path for r in found) == sorted(case["relevant"])
            continue
        relevant += [(case["id"], p) for p in case["relevant"]]
        listed = spark.createDataFrame(list(case["semanticScores"].items()), "path string, score double")
        for hybrid in (False, True):
            options = {"semantic": fixture_scores(index.docs, listed), "weight": 0.8} if hybrid else {}
            found = search(index, case["query"], now=now, **options).results.select("path").collect()
            rankings[hybrid] += [(case["id"], r.path, place) for place, r in enumerate(found, 1)]
    judged = spark.createDataFrame(relevant, "query_id string, path string")
    for hybrid in (False, True):
        metrics = rank_metrics(spark.createDataFrame(rankings[hybrid], "query_id string, path string, place int"), judged)
        got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in metrics.collect()}
        assert {k: tuple(round(x, 3) for x in v) for k, v in got.items()} == {k: v[hybrid] for k, v in TABLE.items()}
        mean = average_metrics(metrics).first()
        assert tuple(round(x, 3) for x in (mean.precision, mean.recall, mean.reciprocal_rank)) == MACRO[hybrid]
