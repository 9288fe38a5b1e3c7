"""How distinctive a term is per record: a two-Poisson mixture per term.

A term's occurrence counts over all records are taken for a mixture of two
Poisson distributions: in ordinary records the term just happens, in elite
records the text is about it. The mixture is fitted to the term's frequency
histogram by expectation-maximisation; the posterior probability of the elite
component scores each count.

The posterior alone says nothing of how rare elite records are. The mixture does:
``elite_weight`` is the chance that an ordinary record lacks the term, times the
surprise of being elite. A term found everywhere has a low one, because its
ordinary records hold it too or its elite records are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.records import current_records, valid_terms
from lodeseek.runtime import materialize, shuffle_partitions

#: Steps at most, and the change of a parameter in a step below which a term's fit has ended.
ROUNDS, TOLERANCE = 4_000, 1e-7


def _step(seg, x, n, zeros, everyone, mass, share, low, high):
    """One step of expectation and maximisation for all terms."""
    p, p0 = _elite(share[seg], low[seg], high[seg], x), _elite(share, low, high, 0.0)
    weight = np.bincount(seg, n * p, len(zeros)) + zeros * p0
    found = np.bincount(seg, n * p * x, len(zeros))
    share = np.clip(weight / everyone, 1e-9, 1 - 1e-9)
    high = np.maximum(found / np.maximum(weight, 1e-12), 1e-6)
    low = np.maximum((mass - found) / np.maximum(everyone - weight, 1e-12), 1e-9)
    return share, low, np.maximum(high, low * (1 + 1e-9))


def _elite(share, low, high, count):
    a = np.log(share) + count * np.log(high) - high
    b = np.log1p(-share) + count * np.log(low) - low
    return 1.0 / (1.0 + np.exp(np.clip(b - a, -700, 700)))


def _loglikelihood(seg, x, n, zeros, share, low, high):
    def of(s, lo, hi, count):
        a, b = np.log(s) + count * np.log(hi) - hi, np.log1p(-s) + count * np.log(lo) - lo
        return np.logaddexp(a, b)

    return np.bincount(seg, n * of(share[seg], low[seg], high[seg], x), len(zeros)) + zeros * of(share, low, high, 0.0)


def fit_two_poisson(seg: np.ndarray, x: np.ndarray, n: np.ndarray, zeros: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Fit all terms of a batch together.

    Row i says that the term ``seg[i]`` occurs ``x[i]`` times in ``n[i]``
    records; ``zeros`` counts each term's records without it. Returns the elite
    share and both means by term, each row's posterior of the elite part, and by
    term whether the fit has ended and whether two components fit better than one
    (by more than their two further parameters cost in the Bayesian information criterion).

    Steps go in pairs that are extrapolated where that does not lower the
    likelihood, as plain steps are slow where the components overlap. A term
    leaves the batch when its parameters stand still.
    """
    terms = len(zeros)
    df = np.bincount(seg, n, terms)
    mass = np.bincount(seg, n * x, terms)
    everyone = df + zeros
    mean = mass / everyone
    low = mean * 0.5
    high = np.maximum(mass / np.maximum(df, 1), mean * 1.5) + 0.5
    share = np.clip(0.5 * df / everyone, 1e-9, 0.5)
    ended = np.zeros(terms, dtype=bool)
    live, rows = np.arange(terms), (seg, x, n)
    now = np.log(np.array([share / (1 - share), low, high]))  # free of bounds

    def back(t):
        odds = np.exp(np.clip(t[0], -20, 20))
        lo = np.exp(np.clip(t[1], -20, 30))
        return odds / (1 + odds), lo, np.maximum(np.exp(np.clip(t[2], -20, 30)), lo * (1 + 1e-9))

    own = (zeros, everyone, mass)
    for _ in range(rounds):
        if not len(live):
            break
        s, xx, nn = rows
        step = lambda t: (lambda r: np.log(np.array([r[0] / (1 - r[0]), r[1], r[2]])))(_step(s, xx, nn, *own, *back(t)))  # noqa: B023, E731
        one = step(now)
        two = step(one)
        first, second = one - now, two - 2 * one + now
        length = -np.sqrt((first * first).sum(axis=0) / np.maximum((second * second).sum(axis=0), 1e-300))
        length = np.minimum(np.maximum(length, -1e3), -1.0)
        far = now - 2 * length * first + length * length * second
        better = _loglikelihood(s, xx, nn, own[0], *back(far)) >= _loglikelihood(s, xx, nn, own[0], *back(two))
        new = np.where(better & np.isfinite(far).all(axis=0), far, two)
        still = np.abs(two - one).max(axis=0) < TOLERANCE
        share[live], low[live], high[live] = back(np.where(still, two, new))
        ended[live[still]] = True
        now = new
        if still.any():
            keep = ~still
            place = np.cumsum(keep) - 1
            mine = keep[s]
            rows = (place[s[mine]], xx[mine], nn[mine])
            live, now, own = live[keep], now[:, keep], tuple(v[keep] for v in own)
    two = _loglikelihood(seg, x, n, zeros, share, low, high)
    one = mass * np.log(np.maximum(mean, 1e-300)) - everyone * mean
    return share, low, high, _elite(share[seg], low[seg], high[seg], x), ended, 2 * (two - one) > 2 * np.log(everyone)


def _posteriors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        # Most terms share their histogram with others; each is fitted once.
        known: dict[tuple, int] = {}
        which = [known.setdefault((e, tuple(x), tuple(n)), len(known)) for e, x, n in zip(b["everyone"], b["xs"], b["ns"])]
        lengths = np.array([len(k[1]) for k in known])
        seg = np.repeat(np.arange(len(known)), lengths)
        x = np.concatenate([np.array(k[1], dtype=np.float64) for k in known])
        n = np.concatenate([np.array(k[2], dtype=np.float64) for k in known])
        df = np.bincount(seg, n, len(known))
        everyone = np.array([k[0] for k in known], dtype=np.float64)
        share, low, high, p, ended, two = fit_two_poisson(seg, x, n, np.maximum(everyone - df, 0))
        ends = np.cumsum(lengths)
        rows = np.concatenate([np.arange(ends[k] - lengths[k], ends[k]) for k in which])
        term = np.repeat(b["term"].to_numpy(), lengths[which])
        of = seg[rows]
        yield pd.DataFrame({
            "_term": term, "_x": x[rows].astype(np.int64), "df": df[of].astype(np.int64), "records": everyone[of].astype(np.int64), "elite_share": share[of], "ordinary_mean": low[of], "elite_mean": high[of],
            "elite_probability": p[rows], "elite_weight": np.exp(-low[of]) * -np.log(share[of]), "converged": ended[of], "two_components": two[of],
        })


_FIT = "_term string, _x bigint, df bigint, records bigint, elite_share double, ordinary_mean double, elite_mean double, elite_probability double, elite_weight double, converged boolean, two_components boolean"


def distinctive_terms(docs: DataFrame) -> DataFrame:
    """Score every term of every record of a lexical index.

    Returns (path, term, tf, token_count, df, records, elite_share,
    ordinary_mean, elite_mean, elite_probability, elite_weight, converged,
    two_components, score). Counts enter the histogram scaled to the mean record
    length by ``token_count`` (by the record's own sum of frequencies where that is
    null or below 1), at least 1. ``score`` is ``elite_probability`` times
    ``elite_weight``, both of the mixture alone. ``two_components`` is false where
    the histogram does not tell two components apart; the mixture then is one of several that fit it alike.

    Records and valid entries are those of ``current_records`` and
    ``valid_terms``; a record without valid entries has no rows but counts in N.
    """
    spark = docs.sparkSession
    own = F.aggregate(F.map_entries("term_frequency"), F.lit(0).cast("bigint"), lambda n, e: F.when((e["value"] >= 1) & (e["key"] != ""), n + e["value"]).otherwise(n))
    records = current_records(docs).select("path", "term_frequency", "token_count", own.alias("_own"))
    terms = materialize(valid_terms(records, ["_own"]), "terms")  # read for the mean, the histograms and the result
    size = docs.filter(F.col("path").isNotNull()).select("path").distinct().agg(F.count(F.lit(1)).alias("everyone"))
    length = F.when(F.col("token_count") >= 1, F.col("token_count")).otherwise(F.col("_own"))
    paths = F.round(F.sum(F.col("tf") / F.col("_own")))  # the shares of a record's terms add up to 1
    mean = terms.agg((F.sum("tf") / paths).alias("_mean"))
    terms = terms.crossJoin(F.broadcast(mean)).withColumn("x", F.greatest(F.lit(1), F.round(F.col("tf") * F.col("_mean") / length)).cast("bigint"))
    histogram = terms.groupBy("term", "x").agg(F.count(F.lit(1)).alias("n"))
    by_term = histogram.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("_h"))
    by_term = by_term.crossJoin(F.broadcast(size)).select("term", "everyone", F.col("_h.x").alias("xs"), F.col("_h.n").alias("ns"))
    # Equal histograms meet, as each is fitted once. The aggregation's own partitions would be coalesced by their few
    # bytes; a quarter of their number, as the steps for a batch's last terms cost the same for few terms as for many.
    fitted = by_term.repartition(max(1, shuffle_partitions(spark) // 4), F.xxhash64("xs", "ns")).mapInPandas(_posteriors, _FIT)
    scored = terms.join(fitted, (F.col("term") == F.col("_term")) & (F.col("x") == F.col("_x")))
    return scored.withColumn("score", F.col("elite_probability") * F.col("elite_weight")).select(
        "path", "term", "tf", "token_count", "df", "records", "elite_share", "ordinary_mean", "elite_mean", "elite_probability", "elite_weight", "converged", "two_components", "score"
    )


def typical_terms(scored: DataFrame, least: int = 2, most: int = 10, one_in: int = 20) -> DataFrame:
    """Rows whose term is held by ``least`` to ``most`` records and makes up 1/``one_in`` of the record."""
    return scored.filter(F.col("df").between(least, most) & (F.col("token_count") > 0) & (F.col("tf") * one_in >= F.col("token_count")))
