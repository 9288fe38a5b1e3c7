"""Most similar vectors by an adaptive dimension scan inside the lists of an inverted file that can hold them.

Vectors are brought to unit length and turned by one random rotation per width,
so that any block of columns is a fair sample of a distance. Centroids are
fitted on a bounded sample; every vector is put into its nearest list. A list's
radius is the greatest angle between its centroid and a member, so a vector has
neighbours within an angle only in the lists whose centroid lies within that angle
and the radius, and all of those are searched. Inside a list, candidates are compared
over one block of columns after another: with d of D columns seen, the partial
squared distance scaled by D / d is tested against the bound widened by
1 + EPSILON / sqrt(d), and a candidate that fails the test is abandoned. What
survives all columns has its exact distance, so a reported similarity is exact
and only a pair abandoned wrongly is missed.

All pairs within an angle (``links``) are found without that test, so none is missed.
Lists that lie near each other make up blocks of rows, and two blocks that have
lists within reach are one unit of work. A unit's rows are rounded to 16 bits, and
of half the columns together with the length of the rest follows a bound on the
cosine (Cauchy-Schwarz), which one matrix product gives for all pairs of a tile. The
pairs left are decided by their rows in full precision, read once for each unit that
has them. A unit holds one block and streams the other past it.

There are up to ``TOP_LISTS`` lists per provider and width. A list that holds many
more than ``LIST_ROWS`` vectors is cut into lists of its own, with centroids fitted on
a sample of its members, so the number of lists grows with the rows and a query
meets the same number of candidates at any size. Lists are cut into blocks of
rows, and every pair of a query block and a data block is one group, so a list that
holds most vectors is spread over many tasks. Exact copies are searched for once
and put back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators.skew import hot_keys, salted_join, sized
from lodeseek.runtime import materialize

#: Vectors per (provider, width), and per list that is cut, the centroids are fitted on, at most about.
SAMPLE, CUT_SAMPLE = 8192, 4096
#: Rows a list should hold, and beyond which it is cut; lists of a provider and width before they are cut.
LIST_ROWS, CUT_ROWS, TOP_LISTS = 400, 1600, 1024
BLOCK_ROWS = 2048
COLUMNS = 16
EPSILON = 2.1
#: Rows of a block that a unit holds, at most about, and below which blocks are not made for the sake of more tasks.
UNIT_ROWS, LEAST_UNIT_ROWS = 160_000, 16_384
#: By how much a cosine can differ for rows rounded to 16 bits (2^-11 for each), and an angle, with what single precision adds.
ROUNDED, ROUNDED_ANGLE = 0.0011, 0.01
#: Rows that the lists inside a unit are fitted on, at most about, into how many rings a list is cut there, and rows streamed past a block at once.
UNIT_SAMPLE, RINGS, STREAM_ROWS = 16_384, 12, 10_000
#: Rows for which angles to all lists are held at once.
CHUNK = 1024
#: What a row is in a unit: of the block that is held, of the one that is streamed, or of a block that meets itself.
HELD, STREAMED, WHOLE = 0, 1, 2
#: Into how many parts a unit's pairs are cut for their exact cosines.
SLICES = 16


@lru_cache(maxsize=16)
def rotation(width: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))
    return q


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_centroids(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors, started from a spread of the points; the same points give the same centroids."""
    lists = max(1, min(lists, len(points)))
    centroids = points[np.random.default_rng(lists).permutation(len(points))[:lists]].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centroids)
    return centroids


def _passes(partial, seen: int, width: int, bound, epsilon: float | None):
    """Whether a candidate stays; without ``epsilon`` it goes only when its partial distance is beyond the bound already."""
    if epsilon is None or seen >= width:
        return partial <= bound
    return partial * (width / seen) <= bound * (1 + epsilon / np.sqrt(seen)) ** 2


def _finish(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, partial: np.ndarray, seen: int, bound: np.ndarray, epsilon: float | None):
    """Go on with the surviving pairs, block by block of columns, until all columns are seen."""
    width = q.shape[1]
    while seen < width and len(qi):
        to = min(seen + COLUMNS, width)
        diff = q[qi, seen:to] - x[xi, seen:to]
        partial = partial + np.einsum("ij,ij->i", diff, diff)
        seen = to
        keep = _passes(partial, seen, width, bound[qi], epsilon)
        qi, xi, partial = qi[keep], xi[keep], partial[keep]
    return qi, xi, partial


def _first(q: np.ndarray, x: np.ndarray, bound: np.ndarray, epsilon: float | None):
    seen = min(COLUMNS, q.shape[1])
    a, b = q[:, :seen], x[:, :seen]
    partial = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)
    qi, xi = np.nonzero(_passes(partial - 1e-12, seen, q.shape[1], bound[:, None], epsilon))
    return qi, xi, partial[qi, xi], seen


def scan_range(q: np.ndarray, x: np.ndarray, least: float, epsilon: float | None = EPSILON):
    """Pairs (row of q, row of x, cosine) with a cosine of at least ``least``."""
    bound = np.full(len(q), 2 - 2 * least + 1e-9)
    qi, xi, *rest = _first(q, x, bound, epsilon)
    qi, xi, _ = _finish(q, x, qi, xi, *rest, bound, epsilon)
    cosine = np.einsum("ij,ij->i", q[qi], x[xi])
    keep = cosine >= least
    return qi[keep], xi[keep], cosine[keep]


def scan_nearest(q: np.ndarray, x: np.ndarray, k: int, epsilon: float | None = EPSILON, chunk: int = 256):
    """The k nearest rows of x for each row of q; the bound of a query is its k-th distance so far."""
    bound = np.full(len(q), np.inf)
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk]
        qi, xi, *rest = _first(q, part, bound, epsilon)
        qi, xi, far = _finish(q, part, qi, xi, *rest, bound, epsilon)
        qi, xi, far = np.concatenate([best[0], qi]), np.concatenate([best[1], xi + at]), np.concatenate([best[2], far])
        order = np.lexsort((xi, far, qi))
        qi, xi, far = qi[order], xi[order], far[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = [a[place < k] for a in (qi, xi, far)]
        full = place == k - 1
        bound[qi[full]] = far[full] + 1e-12
    return best[0], best[1], np.einsum("ij,ij->i", q[best[0]], x[best[1]])


def _rows(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)


def _angles(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centroids.T, -1, 1))


def _unrounded(blobs) -> np.ndarray:
    """Rows of unit length in single precision from rows in 16 bits."""
    rows = np.frombuffer(b"".join(blobs), dtype=np.float16).reshape(len(blobs), -1).astype(np.float32)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _prefix(rows: np.ndarray) -> np.ndarray:
    """Half of the columns and the length of the rest; the product of two prefixes is at least that of the rows."""
    width = rows.shape[1]
    if width < 2 * COLUMNS:
        return rows
    seen = rows[:, : width // 2 - 1]
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", seen, seen), 0))
    return np.concatenate([seen, rest[:, None]], axis=1)


def _close(q: np.ndarray, x: np.ndarray, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of q, row of x) with a product of at least ``bound``, tile by tile."""
    high, wide = 512, 1024
    products = np.empty(min(len(q), high) * min(len(x), wide), np.float32)
    for i in range(0, len(q), high):
        for j in range(0, len(x), wide):
            a, b = q[i : i + high], x[j : j + wide]
            tile = np.dot(a, b.T, out=products[: len(a) * len(b)].reshape(len(a), len(b)))
            at = np.flatnonzero(tile >= bound)
            for k in range(0, len(at), 1 << 16):
                qi, xi = np.divmod(at[k : k + (1 << 16)], len(b))
                yield qi + i, xi + j


class Block:
    """Rows in lists of their own, so that rows streamed past them meet only members that can be near enough.

    The angles of two rows with a centroid differ by their own angle at most, so of a list
    whose members are in the order of falling angles a row meets the first few ``RINGS``.
    """

    def __init__(self, reps: np.ndarray, rows: np.ndarray, least: float):
        self.bound, self.reach = least - ROUNDED, float(np.arccos(np.clip(least, -1, 1))) + ROUNDED_ANGLE
        lists = max(1, min(len(rows) // LIST_ROWS, UNIT_SAMPLE // 16))
        self.centroids = fit_centroids(rows[:: -(-len(rows) // UNIT_SAMPLE)], lists)
        near = [rows[at : at + CHUNK] @ self.centroids.T for at in range(0, len(rows), CHUNK)]
        near, best = np.concatenate([x.argmax(axis=1) for x in near]), np.concatenate([x.max(axis=1) for x in near])
        order = np.lexsort((best, near))
        self.reps, self.rows, self.prefix = reps[order], rows[order], _prefix(rows[order])
        self.angles = np.arccos(np.clip(best[order], -1, 1))
        self.starts = np.searchsorted(near[order], np.arange(len(self.centroids) + 1))

    def near(self, rows: np.ndarray, prefix: np.ndarray, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row here, in a list from ``first`` on, and row of ``rows``) that may be similar enough."""
        needed = np.arccos(np.clip(self.centroids[first:] @ rows.T, -1, 1)) - np.float32(self.reach)
        for at, angles in enumerate(needed, first):
            begin, end = self.starts[at], self.starts[at + 1]
            if begin == end:
                continue
            edges = begin + np.arange(RINGS + 1) * (end - begin) // RINGS
            rings = np.zeros(len(rows), np.uint8)
            for least in self.angles[edges[:-1]]:
                rings += angles <= least
            order, ends = np.argsort(rings, kind="stable"), np.bincount(rings, minlength=RINGS + 1).cumsum()
            meeting = prefix[order[ends[0] :]]
            for ring in range(1, RINGS + 1):
                for a, b in _close(self.prefix[begin : edges[ring]], meeting[ends[ring - 1] - ends[0] : ends[ring] - ends[0]], self.bound):
                    a, b = a + begin, order[b + ends[ring - 1]]
                    keep = np.einsum("ij,ij->i", self.rows[a], rows[b]) >= self.bound
                    if keep.any():
                        yield a[keep], b[keep]

    def pairs(self, reps: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(id here, id of ``rows``) that may be similar enough."""
        prefix = _prefix(rows)
        for at in range(0, len(rows), STREAM_ROWS):
            for a, b in self.near(rows[at : at + STREAM_ROWS], prefix[at : at + STREAM_ROWS]):
                yield self.reps[a], reps[b + at]

    def own_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ids of this block that may be similar enough, each once."""
        for at in range(0, len(self.rows), STREAM_ROWS):
            first = int(np.searchsorted(self.starts, at, "right")) - 1
            for a, b in self.near(self.rows[at : at + STREAM_ROWS], self.prefix[at : at + STREAM_ROWS], first):
                later = a > b + at
                yield self.reps[a[later]], self.reps[b[later] + at]


def _chain(centroids: np.ndarray) -> list[int]:
    """The lists in an order in which the next is the nearest that is left."""
    near, at, out = centroids @ centroids.T, 0, []
    for _ in range(len(near)):
        out.append(at)
        near[:, at] = -np.inf
        at = int(near[at].argmax())
    return out


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, provider_id, width, vector, h1, h2) of the usable rows, one per ``vec_id``.

    Null, empty, zero and not finite vectors, null elements, null ids and null
    providers are not usable. Of rows with one id the greatest usable (provider, vector) counts.
    """
    most, least, inf = F.array_max("vector"), F.array_min("vector"), F.lit(float("inf"))  # NaN is the greatest
    finite = (most < inf) & (least > -inf) & F.forall("vector", lambda v: v.isNotNull())
    ok = F.col("vec_id").isNotNull() & F.col("provider_id").isNotNull() & (F.size("vector") > 0) & finite & ((most != 0) | (least != 0))
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select("vec_id", "provider_id", F.col("vector").cast("array<double>").alias("vector"))
    twice = sized(materialize(rows.groupBy("vec_id").count().filter(F.col("count") > 1).select("vec_id"), "twice"))  # only their vectors are shuffled
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.max(F.struct("provider_id", "vector")).alias("_v")).select("vec_id", "_v.provider_id", "_v.vector")
    one = rows.join(twice, "vec_id", "left_anti").unionByName(one)
    return one.select("vec_id", "provider_id", F.size("vector").alias("width"), "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(17), "vector").alias("h2"))


_PLACED = "provider_id string, width int, list int, sub int, rep long, angle double, lists array<int>, v binary"
_GROUP = ["provider_id", "width"]


class VectorIndex:
    """Lists over the distinct vectors of each (provider, width); see the module's text.

    Vectors count as copies when two 64-bit hashes of their elements agree. Of a
    provider and width with at most ``LIST_ROWS`` vectors there is one list and
    nothing on the driver; a larger one has its top centroids there.
    ``probes`` lists are searched for the bound of ``nearest``. ``epsilon`` is how far
    the test for abandoning a candidate is widened; None abandons only what
    cannot be near enough, so nothing is missed.
    """

    def __init__(self, vectors: DataFrame, probes: int = 12, epsilon: float | None = EPSILON):
        spark = vectors.sparkSession
        self.epsilon = epsilon
        usable, same = usable_vectors(vectors), [*_GROUP, "h1", "h2"]
        members = materialize(usable.select(*same, "vec_id"), "vectors")
        reps = members.groupBy(*same).agg(F.min("vec_id").alias("rep"))
        self.classes = materialize(members.join(reps, same).select("rep", "vec_id"), "classes")
        counts = {(r.provider_id, r.width): r["count"] for r in reps.groupBy(*_GROUP).count().filter(F.col("count") > LIST_ROWS).collect()}
        copies = sized(self.classes.filter("rep <> vec_id").select("vec_id"))
        distinct = usable.join(copies, "vec_id", "left_anti").withColumnRenamed("vec_id", "rep")
        shares = spark.createDataFrame([(p, w, min(1 << 20, int(SAMPLE / n * (1 << 20)) + 1)) for (p, w), n in counts.items()], "provider_id string, width int, share long")
        sample: dict[tuple, list] = {}
        for r in distinct.join(F.broadcast(shares), _GROUP).filter("pmod(h1, 1048576) < share").select(*_GROUP, "h1", "vector").collect():
            sample.setdefault((r.provider_id, r.width), []).append((r.h1, r.vector))
        centroids = {}
        for (p, w), n in counts.items():
            own = [v for _, v in sorted(sample.get((p, w), []))] or [[1.0] + [0.0] * (w - 1)]
            lists = min(TOP_LISTS, -(-n // LIST_ROWS), max(1, len(own) // 8))
            centroids[p, w] = fit_centroids(unit(np.array(own)) @ rotation(w), lists)
        shared = spark.sparkContext.broadcast(centroids)

        def nearest_lists(turned: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            near = turned @ known.T
            first, best = near.argmax(axis=1), near.max(axis=1)
            if near.shape[1] <= probes:
                return first, best, np.tile(np.arange(near.shape[1]), (len(near), 1))
            near[np.arange(len(near)), first] = np.inf
            return first, best, np.argpartition(-near, probes - 1, axis=1)[:, :probes]

        def assign(batches):
            for b in batches:
                for (p, w), own in b.groupby(_GROUP, sort=False):
                    turned = unit(np.array(own["vector"].tolist(), dtype=np.float64)) @ rotation(int(w))
                    known = shared.value.get((p, int(w)))
                    if known is None:
                        first, best, lists = np.zeros(len(own), np.int64), np.ones(len(own)), np.zeros((len(own), 1), np.int64)
                    else:
                        first, best, lists = map(np.concatenate, zip(*(nearest_lists(turned[at : at + CHUNK], known) for at in range(0, len(own), CHUNK))))
                    yield pd.DataFrame({"provider_id": p, "width": int(w), "list": first, "sub": 0, "rep": own["rep"].to_numpy(), "angle": np.arccos(np.clip(best, -1, 1)), "lists": list(lists), "v": [row.tobytes() for row in turned]})

        self.top = materialize(distinct.select(*_GROUP, "rep", "vector").mapInPandas(assign, _PLACED), "placed")
        radii = {k: np.full(len(c), -np.inf) for k, c in centroids.items()}  # a list without members holds nothing
        self.sizes = {k: np.zeros(len(c), np.int64) for k, c in centroids.items()}
        self.crowded = []
        for r in self.top.groupBy(*_GROUP, "list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # at most TOP_LISTS for each of ``counts``
            if (r.provider_id, r.width) in radii:
                radii[r.provider_id, r.width][r.list] = r.radius
                self.sizes[r.provider_id, r.width][r.list] = r.n
                if r.n > CUT_ROWS:
                    self.crowded.append((r.provider_id, r.width, r.list, -(-r.n // BLOCK_ROWS), min(-(-r.n // LIST_ROWS), CUT_SAMPLE // 8), min(1 << 20, int(CUT_SAMPLE / r.n * (1 << 20)) + 1)))
        self.bounds = spark.sparkContext.broadcast((centroids, radii, {c[:3] for c in self.crowded}))

    @cached_property
    def _lists(self) -> tuple[DataFrame, DataFrame | None]:
        return self._cut(self.top, self.crowded) if self.crowded else (self.top, None)

    @property
    def placed(self) -> DataFrame:
        return self._lists[0]

    @property
    def subs(self) -> DataFrame | None:
        return self._lists[1]

    def _cut(self, top: DataFrame, cut: list[tuple]) -> tuple[DataFrame, DataFrame]:
        """The rows with the lists within their list, and (provider_id, width, list, sub, radius, c) of those."""
        key = [*_GROUP, "list"]
        chosen = lambda: F.broadcast(top.sparkSession.createDataFrame(cut, "provider_id string, width int, list int, blocks long, lists_in int, share long"))

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("rep")
            made = fit_centroids(_rows(rows["v"].tolist()), int(rows["lists_in"].iloc[0]))
            p, w, at = (rows[c].iloc[0] for c in key)
            return pd.DataFrame({"provider_id": p, "width": w, "list": at, "sub": range(len(made)), "c": [x.tobytes() for x in made]})

        def place(_: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({c: [] for c in names})
            angles = _angles(_rows(rows["v"].tolist()), _rows(own.sort_values("sub")["c"].tolist()))
            return rows.assign(sub=angles.argmin(axis=1).astype(np.int32), angle=angles.min(axis=1))[names]

        names = [x.split()[0] for x in _PLACED.split(", ")]
        crowded = top.join(chosen(), key)
        made = materialize(crowded.filter("pmod(xxhash64(rep, 5), 1048576) < share").groupBy(*key).applyInPandas(fit, "provider_id string, width int, list int, sub int, c binary"), "cut-lists")
        rows = crowded.withColumn("blk", F.expr("pmod(xxhash64(rep), blocks)"))
        copies = made.join(chosen(), key).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        inner = rows.groupBy(*key, "blk").cogroup(copies.groupBy(*key, "blk")).applyInPandas(place, _PLACED)
        placed = materialize(top.join(chosen(), key, "left_anti").select(*names).unionByName(inner), "placed")
        radius = placed.join(chosen(), key, "left_semi").groupBy(*key, "sub").agg(F.max("angle").alias("radius"))
        return placed, materialize(made.join(radius, [*key, "sub"]), "cut-lists")

    def _reaching(self, queries: DataFrame, forward: bool) -> DataFrame:
        """A row for each of ``queries`` and list that can hold a vector within ``reach`` (an angle) of it.

        ``forward`` leaves out the lists before the own one, whose members find the
        pair; otherwise those ``_probed`` are left out, as they are searched already.
        """
        shared, names = self.bounds, [*_GROUP, "list", "sub", "rep", "v", "reach", "own", "own_sub"]

        def reach(batches):
            for b in batches:
                for (p, w), own in ((k, x.iloc[at : at + CHUNK // 8]) for k, x in b.groupby(_GROUP, sort=False) for at in range(0, len(x), CHUNK // 8)):
                    known, radii, cut = shared.value
                    group = (p, int(w))
                    near = np.ones((len(own), 1), dtype=bool)
                    if group in known:
                        near = _angles(_rows(own["v"].tolist()), known[group]) <= radii[group] + own["reach"].to_numpy()[:, None] + 1e-6
                    whole = np.array([(*group, x) not in cut for x in range(near.shape[1])])
                    if forward:
                        near &= np.arange(near.shape[1]) >= own["list"].to_numpy()[:, None]
                    else:
                        probed = np.zeros_like(near)
                        np.put_along_axis(probed, np.stack(own["lists"].to_list()), True, axis=1)
                        near &= ~(probed & whole[None, :])
                    at, found = np.nonzero(near)
                    rows = own.iloc[at]
                    yield pd.DataFrame({"provider_id": p, "width": int(w), "list": found, "sub": np.where(whole[found], 0, -1), "rep": rows["rep"].to_numpy(), "v": rows["v"].to_numpy(), "reach": rows["reach"].to_numpy(), "own": rows["list"].to_numpy(), "own_sub": rows["sub"].to_numpy()})

        def within(_: tuple, rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(lists):
                return pd.DataFrame({c: [] for c in names})
            lists = lists.sort_values("sub")
            near = _angles(_rows(rows["v"].tolist()), _rows(lists["c"].tolist())) <= lists["radius"].to_numpy() + rows["reach"].to_numpy()[:, None] + 1e-6
            mine = rows["own"].to_numpy() == rows["list"].to_numpy()
            sub, own = lists["sub"].to_numpy()[None, :], rows["own_sub"].to_numpy()[:, None]
            near &= ~mine[:, None] | ((sub >= own) if forward else (sub != own))
            at, found = np.nonzero(near)
            return rows.iloc[at].assign(sub=lists["sub"].to_numpy()[found])[names]

        schema = "provider_id string, width int, list int, sub int, rep long, v binary, reach double, own int, own_sub int"
        rows = queries.select(*_GROUP, "list", "sub", "rep", "lists", "reach", "v").mapInPandas(reach, schema)
        if self.subs is None:
            return rows
        rows, key = materialize(rows, "reached"), [*_GROUP, "list"]
        crowded = rows.filter("sub < 0")
        counted = [tuple(r) for r in crowded.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("chunks")).collect()]  # at most TOP_LISTS a group
        chunks = lambda: F.broadcast(rows.sparkSession.createDataFrame(counted, "provider_id string, width int, list int, chunks long"))
        asked = crowded.join(chunks(), key).withColumn("blk", F.expr("pmod(xxhash64(rep, 2), chunks)"))
        copies = self.subs.join(chunks(), key).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        inner = asked.groupBy(*key, "blk").cogroup(copies.groupBy(*key, "blk")).applyInPandas(within, schema)
        return rows.filter("sub >= 0").unionByName(inner)

    def _probed(self, queries: DataFrame) -> DataFrame:
        """A row for each query and list that is searched first: its own, and the nearest that are not cut."""
        shared = self.bounds

        def probe(batches):
            for b in batches:
                for (p, w), own in b.groupby(_GROUP, sort=False):
                    cut = shared.value[2]
                    pairs = [(i, x) for i, (at, lists) in enumerate(zip(own["list"], own["lists"])) for x in lists if x == at or (p, int(w), int(x)) not in cut]
                    at, found = np.array([i for i, _ in pairs]), np.array([x for _, x in pairs])
                    rows = own.iloc[at]
                    yield pd.DataFrame({"provider_id": p, "width": int(w), "list": found, "sub": np.where(found == rows["list"].to_numpy(), rows["sub"].to_numpy(), 0), "rep": rows["rep"].to_numpy(), "v": rows["v"].to_numpy()})

        return queries.select(*_GROUP, "list", "sub", "rep", "lists", "v").mapInPandas(probe, "provider_id string, width int, list int, sub int, rep long, v binary")

    def _scan(self, asked: DataFrame, scan, schema: str) -> DataFrame:
        """Run ``scan(query ids, queries, data ids, data)`` on every block pair of every list that is asked for."""
        key = [*_GROUP, "list", "sub"]
        data, asked = self.placed.select(*key, "rep", "v"), asked.select(*key, "rep", "v")
        blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(name))
        plan = materialize(blocks(data, "nd").join(blocks(asked, "nq"), key), "list-blocks")  # a row per list: all rows / LIST_ROWS
        data = data.join(plan, key).select(*key, F.expr("pmod(xxhash64(rep), nd)").alias("db"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)).alias("qb"), F.lit(False).alias("asks"), "rep", "v")
        asked = asked.join(plan, key).select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nd") - 1)).alias("db"), F.expr("pmod(xxhash64(rep, 1), nq)").alias("qb"), F.lit(True).alias("asks"), "rep", "v")

        def group(rows: pd.DataFrame) -> pd.DataFrame:
            sides = []
            for asks in (True, False):
                own = rows[rows["asks"] == asks].sort_values("rep")
                sides += [own["rep"].to_numpy(), _rows(own["v"].tolist()) if len(own) else None]
            names = [x.split()[0] for x in schema.split(", ")]
            if sides[1] is None or sides[3] is None:
                return pd.DataFrame({n: [] for n in names})
            return pd.DataFrame(dict(zip(names, scan(*sides))))

        return data.unionByName(asked).groupBy(*key, "db", "qb").applyInPandas(group, schema)

    def _units(self, reach: float) -> tuple[DataFrame, int]:
        """(provider_id, width, list, to) and the number of units: for each part of a list the units it goes to, and as what.

        Units are numbered from the largest on. There are at most TOP_LISTS lists and a part
        for each quarter of a block, for each provider and width.
        """
        spark = self.top.sparkSession
        centroids, radii, _ = self.bounds.value
        cores, costs, goes = spark.sparkContext.defaultParallelism, [], {}
        for group, known in centroids.items():
            n, radius = self.sizes[group], radii[group]
            meets = _angles(known, known) <= radius[:, None] + radius + reach + 1e-6
            blocks = max(-(-int(n.sum()) // UNIT_ROWS), min(cores, int(n.sum()) // LEAST_UNIT_ROWS), 1)
            full = n.sum() / blocks
            pieces = [(x, part, parts) for x in _chain(known) if n[x] for parts in [int(-(-4 * n[x] // full))] for part in range(parts)]
            rows = np.array([n[x] / parts for x, _, parts in pieces])
            place = np.minimum((np.cumsum(rows) - rows / 2) // full, blocks - 1)
            held = [np.flatnonzero(place == i) for i in range(blocks)]
            of = np.array([x for x, _, _ in pieces])
            for i in range(blocks):
                for j in range(i, blocks):
                    near = meets[np.ix_(of[held[i]], of[held[j]])]
                    a, b = held[i][near.any(axis=1)], held[j][near.any(axis=0)]
                    if i == j:
                        sides = [(WHOLE, held[i])]
                        costs.append(rows[held[i]].sum() ** 2 / 2)
                    elif len(a):
                        sides = [(HELD, a), (STREAMED, b)]
                        costs.append(rows[a].sum() * rows[b].sum())
                    else:
                        continue
                    for side, some in sides:
                        for at in some:
                            x, part, parts = pieces[at]
                            goes.setdefault((*group, x), [[] for _ in range(parts)])[part].append((len(costs) - 1, side))
        number = np.empty(len(costs), np.int64)
        number[np.argsort(-np.array(costs), kind="stable")] = np.arange(len(costs))
        plan = [(p, w, int(x), [[(int(number[u]), side) for u, side in part] for part in to]) for (p, w, x), to in goes.items()]
        return spark.createDataFrame(plan, "provider_id string, width int, list int, to array<array<struct<unit:int,side:int>>>"), len(costs)

    def _candidates(self, least: float) -> DataFrame:
        """(unit, rep_a, rep_b): the pairs of groups with more than ``LIST_ROWS`` vectors that may have at least ``least``, each once."""
        plan, units = self._units(float(np.arccos(np.clip(least, -1, 1))))

        def round_rows(batches):
            for b in batches:
                for _, own in b.groupby("width", sort=False):
                    yield own.assign(v=[x.tobytes() for x in _rows(own["v"].tolist()).astype(np.float16)])

        def found(unit: int, pairs) -> Iterator[pd.DataFrame]:
            held, n = [], 0
            for a, b in pairs:
                held.append((a, b))
                n += len(a)
                if n > 100_000:
                    yield frame(unit, held)
                    held, n = [], 0
            if n:
                yield frame(unit, held)

        def frame(unit: int, held: list) -> pd.DataFrame:
            a, b = map(np.concatenate, zip(*held))
            return pd.DataFrame({"unit": np.int32(unit), "rep_a": np.minimum(a, b), "rep_b": np.maximum(a, b)})

        def block(parts: list) -> Block:
            reps, rows = map(np.concatenate, zip(*parts))
            parts.clear()
            return Block(reps, rows, least)

        def scan(batches):
            unit, side, parts, held = -1, HELD, [], None
            for b in batches:
                units, sides, reps = (b[c].to_numpy() for c in ("unit", "side", "rep"))
                cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(sides) != 0)) + 1
                for begin, end in zip([0, *cuts], [*cuts, len(b)]):
                    if begin == end:
                        continue
                    if units[begin] != unit:
                        if side == WHOLE and parts:
                            yield from found(unit, block(parts).own_pairs())
                        unit, parts, held = units[begin], [], None
                    side = sides[begin]
                    rows = _unrounded(b["v"].iloc[begin:end].tolist())
                    if side != STREAMED:
                        parts.append((reps[begin:end], rows))
                        continue
                    held = held or block(parts)
                    yield from found(unit, held.pairs(reps[begin:end], rows))
            if side == WHOLE and parts:
                yield from found(unit, block(parts).own_pairs())

        rows = self.top.select(*_GROUP, "list", "rep", "v").mapInPandas(round_rows, "provider_id string, width int, list int, rep long, v binary")
        part = F.get("to", F.pmod(F.xxhash64("rep", F.lit(3)), F.size("to")).cast("int"))
        copies = rows.join(F.broadcast(plan), [*_GROUP, "list"]).select(F.explode(part).alias("_to"), "rep", "v").select("_to.unit", "_to.side", "rep", "v")
        streams = copies.repartitionById(units, "unit").sortWithinPartitions("unit", "side")
        return materialize(streams.mapInPandas(scan, "unit int, rep_a long, rep_b long"), "candidates")

    def links(self, least: float = 0.9) -> DataFrame:
        """(rep_a, rep_b, cosine): pairs of classes of copies with at least ``least``; the smallest id of a class stands for it."""
        spark, schema, key = self.top.sparkSession, "rep_a long, rep_b long, cosine double", ["unit", "slice"]

        def small(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("rep")
            reps, v = rows["rep"].to_numpy(), _rows(rows["v"].tolist())
            a, b, cosine = scan_range(v, v, least, None)
            keep = a < b
            return pd.DataFrame({"rep_a": reps[a[keep]], "rep_b": reps[b[keep]], "cosine": cosine[keep]})

        def exact(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(pairs):
                return pd.DataFrame({"rep_a": [], "rep_b": [], "cosine": []})
            rows = rows.sort_values("rep")
            reps, v = rows["rep"].to_numpy(), _rows(rows["v"].tolist())
            a, b = (np.searchsorted(reps, pairs[c].to_numpy()) for c in ("rep_a", "rep_b"))
            step = 16 * CHUNK
            cosine = np.concatenate([np.einsum("ij,ij->i", v[a[at : at + step]], v[b[at : at + step]]) for at in range(0, len(a), step)])
            return pairs.assign(cosine=cosine)[["rep_a", "rep_b", "cosine"]][cosine >= least]

        groups = spark.createDataFrame(list(self.sizes), "provider_id string, width int")
        few = self.top.select(*_GROUP, "rep", "v").join(sized(groups), _GROUP, "left_anti").groupBy(*_GROUP).applyInPandas(small, schema)
        if not self.sizes:
            return few
        pairs = self._candidates(least).withColumn("slice", F.pmod(F.xxhash64("rep_a"), F.lit(SLICES)))
        needed = materialize(pairs.select(*key, F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct(), "needed")
        rows = self.top.select("rep", "v").join(sized(needed.select("rep").distinct()), "rep", "left_semi").join(needed, "rep")
        return few.unionByName(pairs.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(exact, schema))

    def similar_pairs(self, least: float = 0.9) -> DataFrame:
        """(vec_id_a, vec_id_b, cosine) of all pairs with at least ``least``, the smaller id first.

        All lists that can hold such a vector are searched; exact copies have cosine 1.
        ``links`` and ``classes`` say the same without a row for each pair of copies.
        """
        classes = self.classes
        found = self.links(least)
        hot = hot_keys(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")), ["rep"], "_n")
        for x in "ab":
            members = classes.select(F.col("rep").alias(f"rep_{x}"), F.col("vec_id").alias(f"i{x}"))
            found = salted_join(members, found, [f"rep_{x}"], hot.withColumnRenamed("rep", f"rep_{x}"), [f"i{x}"])
        a, b = (classes.select("rep", F.col("vec_id").alias(f"i{x}")) for x in "ab")
        within = salted_join(a, b, ["rep"], hot, ["ia"]).filter("ia < ib").select("ia", "ib", F.lit(1.0).alias("cosine"))
        both = found.select("ia", "ib", "cosine").unionByName(within)
        return both.select(F.least("ia", "ib").alias("vec_id_a"), F.greatest("ia", "ib").alias("vec_id_b"), "cosine")

    def nearest(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(vec_id, neighbour, cosine, place): the k most similar other vectors for each ``vec_id`` of ``queries``.

        The first lists searched give the bound, the angle of the last place; then all
        other lists are searched that can hold a nearer vector. Ties go to the smaller
        id. Ids that are unknown or not usable have no rows.
        """
        epsilon = self.epsilon
        classes = self.classes
        asked = classes.join(queries.select("vec_id").distinct(), "vec_id")
        reps = self.placed.join(asked.select("rep").distinct(), "rep", "left_semi")

        def scan(qn, q, xn, x):
            a, b, cosine = scan_nearest(q, x, k + 1, epsilon)
            return qn[a], xn[b], cosine

        kind = "rep long, other long, cosine double"
        first = materialize(self._scan(self._probed(reps), scan, kind), "first")
        last = first.groupBy("rep").agg(F.sort_array(F.collect_list("cosine"), False).alias("_c")).select("rep", F.get("_c", F.lit(k)).alias("_c"))
        reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("_c", F.lit(-1.0)))))
        rest = materialize(self._reaching(reps.join(last, "rep", "left").withColumn("reach", reach), False), "rest")
        near = first.unionByName(self._scan(rest, scan, kind))
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "other"))).filter(F.col("_n") <= k + 1).drop("_n")
        few = classes.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).filter(F.col("_n") <= k + 1).select(F.col("rep").alias("other"), F.col("vec_id").alias("neighbour"))
        rows = asked.join(near, "rep").join(few, "other").filter(F.col("vec_id") != F.col("neighbour"))
        place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour"))
        return rows.select("vec_id", "neighbour", "cosine", place.alias("place")).filter(F.col("place") <= k)
