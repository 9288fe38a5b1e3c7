"""The best documents of many weighted bags of terms within one block of documents; runs on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

COUNTED = "path string, token_count bigint, terms array<string>, tf array<bigint>"
BEST = "bag_id bigint, path string, score double"
_SCHEMA = pa.schema([("bag_id", pa.int64()), ("path", pa.string()), ("score", pa.float64())])
#: A term is held as one value per document where it is in at least one of so many; rarer ones as a list.
DENSE = 8
#: Groups of documents whose maxima bound the k-th best score from below.
GROUPS = 512
#: Scores are ranked at 9 decimals; two that are further apart than this never tie.
APART = 2e-9


def counted_terms(batches: Iterator[pa.RecordBatch], known: list[str] | None) -> Iterator[pa.RecordBatch]:
    """(path, token_count, terms, tf) from (path, terms): how often each document has each of the ``known`` terms, or each of all."""
    schema = pa.schema([("path", pa.string()), ("token_count", pa.int64()), ("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int64()))])
    for b in batches:
        tokens, lengths = b["terms"].flatten(), pc.list_value_length(b["terms"]).to_numpy().astype(np.int64)
        values = pc.unique(tokens) if known is None else pa.array(known, tokens.type)
        code = pc.fill_null(pc.index_in(tokens, value_set=values), -1).to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)[code >= 0]
        keys, tf = np.unique(row * max(1, len(values)) + code[code >= 0], return_counts=True)
        row, code = np.divmod(keys, max(1, len(values)))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(lengths)))), pa.int32())
        terms = values.take(pa.array(code)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([b["path"].cast(pa.string()), pa.array(lengths), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], schema=schema)


def flat_postings(rows: pa.Table) -> pa.Table:
    """(path, term, part) from (path, terms, parts)."""
    if not rows.num_rows:
        return rows.select(["path"]).append_column("term", rows["path"]).append_column("part", pa.array([], pa.float64()))
    terms, parts = rows["terms"].combine_chunks(), rows["parts"].combine_chunks()
    at = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())
    return pa.table({"path": rows["path"].combine_chunks().dictionary_encode().take(pa.array(at)), "term": terms.flatten(), "part": parts.flatten()})


def _rounded(scores: np.ndarray) -> np.ndarray:
    """At 9 decimals, half up, as Spark's round does."""
    values, at = np.unique(scores, return_inverse=True)
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values])[at]


def _cut(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by rounded score, then by the documents' order."""
    if len(docs) <= k:
        return docs, scores
    near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - APART
    docs, scores = docs[near], scores[near]
    if len(docs) > k:
        first = np.lexsort((docs, -_rounded(scores)))[:k]
        docs, scores = docs[first], scores[first]
    return docs, scores


def best_in_block(postings: pa.Table, bags: pa.Table, k: int) -> pa.Table:
    """(bag_id, path, score): for each bag its ``k`` best documents of the block that hold one of its terms.

    ``postings`` has (path, term, part), ``bags`` (bag_id, terms, weights). A score is the
    sum of weight times part, added in the order of the bag's terms, so equal documents
    have equal scores in every block. Every document is scored; none is left out by a bound.
    """
    if not postings.num_rows or not bags.num_rows:
        return _SCHEMA.empty_table()
    paths = postings["path"].combine_chunks()
    paths = paths if pa.types.is_dictionary(paths.type) else paths.dictionary_encode()
    names = [p.encode() for p in paths.dictionary.to_pylist()]
    order = np.array(sorted(range(len(names)), key=names.__getitem__))
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    terms = postings["term"].combine_chunks().dictionary_encode()
    n = len(names)
    # Lists by term and document; what a document has twice for a term is added up.
    keys, at = np.unique(terms.indices.to_numpy().astype(np.int64) * n + place[paths.indices.to_numpy()], return_inverse=True)
    part = np.bincount(at, postings["part"].to_numpy())
    term, doc = np.divmod(keys, n)
    bounds = np.searchsorted(term, np.arange(len(terms.dictionary) + 1))
    lists = [(doc[a:b], part[a:b]) for a, b in zip(bounds, bounds[1:])]

    groups = max(GROUPS, 2 * k)
    size = -(-n // groups) * groups
    total, one = np.empty(size), np.empty(size)
    dense: dict[int, np.ndarray] = {c: np.bincount(d, p, size) for c, (d, p) in enumerate(lists) if len(d) * DENSE >= n}

    asked, weights = bags["terms"].combine_chunks(), bags["weights"].combine_chunks()
    codes = pc.fill_null(pc.index_in(asked.flatten(), value_set=terms.dictionary), -1).to_numpy().tolist()
    factors = weights.flatten().to_numpy().tolist()
    ends = np.cumsum(pc.list_value_length(asked).to_numpy()).tolist()
    ids, begin = bags["bag_id"].to_numpy(), 0
    out_bag, out_doc, out_score = [], [], []
    for bag, end in zip(ids, ends):
        held = [(c, w) for c, w in zip(codes[begin:end], factors[begin:end]) if c >= 0]
        begin = end
        if not held:
            continue
        if sum(len(lists[c][0]) for c, _ in held) * DENSE < n:
            docs, at = np.unique(np.concatenate([lists[c][0] for c, _ in held]), return_inverse=True)
            scores = np.bincount(at, np.concatenate([lists[c][1] * w for c, w in held]))
        else:
            total.fill(0.0)
            for c, w in held:
                if c in dense:
                    np.multiply(dense[c], w, out=one)
                    np.add(total, one, out=total)
                else:
                    total[lists[c][0]] += lists[c][1] * w
            # Each of k groups has a document at least as good as the k-th of their maxima.
            least = np.partition(total.reshape(-1, groups).max(axis=0), groups - k)[groups - k]
            docs = np.flatnonzero(total >= least - APART) if least > APART else np.flatnonzero(total)
            scores = total[docs]
        docs, scores = _cut(docs, scores, k)
        out_bag.append(np.full(len(docs), bag))
        out_doc.append(docs)
        out_score.append(scores)
    if not out_bag:
        return _SCHEMA.empty_table()
    found = paths.dictionary.take(pa.array(order[np.concatenate(out_doc)])).cast(pa.string())
    return pa.table([pa.array(np.concatenate(out_bag), pa.int64()), found, pa.array(np.concatenate(out_score))], schema=_SCHEMA)
