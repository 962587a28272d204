"""Approximate nearest neighbours by vantage-point trees, one per shard.

A node holds a vantage point and the median distance of its points to it; points up to the median lie inside, the others
outside.  A search keeps each query's k best so far; with t the k-th best distance, the far side of a node is entered
only if the query's distance to the median shell is at most factor * t.  By the triangle inequality factor 1 loses
nothing; smaller factors prune more.  Queries of a block descend together, so distances are array operations.

Shards follow the same rule one level up: each vector belongs to the nearest of a few outer vantage points (a bounded
sample), and a shard is a shell of distances to that point, from ``lo`` to ``hi``, of bounded size.  Each shard's tree is
built once and stored.  A query first searches the shards of its own shell, which gives it a k-th best distance t, then
only the shards whose shell lies within factor * t of its distance to their point.

Distances are Euclidean in double precision, on the vectors as given (where squares would overflow or vanish, of
differences scaled by the largest); ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
a null id; only vectors of the query's own dimension are candidates; a query's own id is never its neighbour; with
fewer candidates than k all are returned; equal vectors of different ids are separate candidates; repeated rows (same id,
same vector) are one query and one candidate; rows of one id with different vectors are separate queries and candidates;
an empty table gives no rows.  Other columns are not read.

At scale: vectors are shuffled once, into shards; trees are read once per round (twice in all) and once more per
``query_rows`` queries of a shard; only k rows per query and shard are merged.  Outer points, cuts between shells and
shells are at most 256, 2^18 and 2^18 numbers per kind, whatever the data; a shell that is larger than a shard (one
vector may be very common) is parted by id.  Where vectors are spread evenly in many dimensions no rule of distances
prunes, and each query meets each shard.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.storage import discard, stored
from quern.llm.textcore import trimmed

LEAF = 256
SHARD_ROWS, QUERY_ROWS = 4096, 2048
#: Outer vantage points at most, cuts of distances per point at most, and the rows that the points are taken from.
POINTS, SHELLS, POINT_SAMPLE = 256, 1024, 1024
_NOBODY = np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree over rows of float64 vectors, given in ascending order of their ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 1, leaf: int = LEAF):
        self.x, self.ids, self.leaf = vectors, ids, leaf
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.root = self._build(np.arange(len(ids)))

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray, root) -> Tree:
        """A tree that was built before."""
        out = cls.__new__(cls)
        out.x, out.ids, out.root = vectors, ids, root
        return out

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pick = int(self.rng.integers(len(rows)))
        point, rest = rows[pick], np.delete(rows, pick)
        d = distances(self.x[point][None], self.x[rest])[0]
        middle = float(np.median(d))
        inside = d <= middle
        if inside.all():  # at least half of the points lie equally far: no shell parts them
            inside = d < middle
            middle = float(d[inside].max()) if inside.any() else middle
            if not inside.any():
                return rows
        return int(point), middle, self._build(rest[inside]), self._build(rest[~inside])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest; unfilled places hold infinity and -1.

        ``bound``: a k-th best distance that each query has from elsewhere; what is farther need not be found.
        """
        self.q, self.own, self.k, self.factor = queries, own, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.best_id = np.full((len(queries), k), _NOBODY)
        bound = np.full(len(queries), np.inf) if bound is None else bound
        stack = [(self.root, np.arange(len(queries)), None)]
        while stack:
            node, who, gap = stack.pop()
            if gap is not None:
                who = who[~(gap > self.factor * np.minimum(self.best[who, -1], bound[who]) * (1 + 1e-12))]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                if len(node):
                    self._offer(who, node, distances(self.q[who], self.x[node]))
                continue
            point, middle, inner, outer = node
            d = distances(self.q[who], self.x[point][None])
            self._offer(who, np.array([point]), d)
            d = d[:, 0]
            near_in = d <= middle
            a, b = who[near_in], who[~near_in]
            stack += [(outer, a, middle - d[near_in]), (inner, b, d[~near_in] - middle), (inner, a, None), (outer, b, None)]
        return self.best, np.where(self.best_id == _NOBODY, -1, self.best_id)

    def _offer(self, who: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        ids = np.broadcast_to(self.ids[rows], d.shape)
        mine = ids == self.own[who][:, None]
        d, ids = np.where(mine, np.inf, d), np.where(mine, _NOBODY, ids)
        some = (d <= self.best[who, -1:]).any(1)
        who, d, ids = who[some], d[some], ids[some]
        if d.shape[1] > self.k:  # a node's rows ascend by id, so a stable sort leaves ties to the smaller id
            order = np.argsort(d, axis=1, kind="stable")[:, : self.k]
            d, ids = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
        all_d = np.concatenate([self.best[who], d], axis=1)
        all_id = np.concatenate([self.best_id[who], ids], axis=1)
        order = np.lexsort((all_id, all_d), axis=1)[:, : self.k]
        self.best[who] = np.take_along_axis(all_d, order, 1)
        self.best_id[who] = np.take_along_axis(all_id, order, 1)


def distances(a: np.ndarray, b: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, from plain differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, block // max(1, b.size))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for i in range(0, len(a), step):
            diff = a[i : i + step, None, :] - b[None]
            out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
            rough = np.nonzero(~((out[i : i + step] < 1e150) & (out[i : i + step] > 1e-140)))
            if len(rough[0]):  # squares that overflow or vanish; equal vectors come here too
                odd = diff[rough]
                most = np.abs(odd).max(axis=1)
                unit = np.where((most > 0) & np.isfinite(most), most, 1.0)[:, None]
                out[i : i + step][rough] = np.where(np.isfinite(most), most * np.sqrt(((odd / unit) ** 2).sum(axis=1)), np.inf)
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one dimension, stored as bytes, as rows of doubles."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)


def _points(rows: DataFrame, count: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Outer vantage points by dimension: some of the ``POINT_SAMPLE`` rows of smallest hash, one per four shards."""
    some = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(POINT_SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in some[: max(1, min(POINTS, count // (4 * shard_rows)))]:
        by_dim.setdefault(len(r.v), []).append(r.v)
    return {dim: np.array(v, np.float64) for dim, v in by_dim.items()}


def _placed(rows: DataFrame, points: dict[int, np.ndarray], kind: str) -> DataFrame:
    """dim, point (-1 where the dimension has none), dist, id, v as bytes."""

    def work(batches):
        names = ["dim", "point", "dist", "id", "v"]
        for batch in batches:
            dims = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                point, dist = np.full(len(x), -1), np.zeros(len(x))
                if dim in points:
                    d = distances(x, points[dim])
                    point = d.argmin(axis=1)
                    dist = d[np.arange(len(x)), point]
                cells = [r.tobytes() for r in x.astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(point.astype(np.int32)), pa.array(dist), part.column(0), pa.array(cells, pa.binary())], names=names)

    return rows.select("id", "v").mapInArrow(trimmed(work), "dim int, point int, dist double, id long, v binary")


def _shelled(placed: DataFrame, shard_rows: int) -> DataFrame:
    """``placed`` with the number of its shell: the quantiles of distances to a point cut its rows in shards."""
    steps = [k / SHELLS for k in range(1, SHELLS)]
    found = placed.where("point >= 0").groupBy("dim", "point").agg(F.count("*").alias("n"), F.percentile_approx("dist", steps).alias("q")).collect()
    cuts = {}
    for r in found:
        shells = min(SHELLS, math.ceil(r.n / shard_rows))
        cuts[r.dim, r.point] = np.unique([r.q[k * SHELLS // shells - 1] for k in range(1, shells)])

    def work(batches):
        for batch in batches:
            dim, point, dist = (batch.column(k).to_numpy() for k in range(3))
            shell = np.zeros(len(dim), np.int32)
            for key in {*zip(dim.tolist(), point.tolist(), strict=True)} & cuts.keys():
                at = (dim == key[0]) & (point == key[1])
                shell[at] = np.searchsorted(cuts[key], dist[at], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shell)], names=[*batch.schema.names, "shell"])

    return placed.mapInArrow(trimmed(work), "dim int, point int, dist double, id long, v binary, shell int")


SHELL = ["dim", "point", "shell"]
SHARD = [*SHELL, "part"]


def _trees(placed: DataFrame, kind: str) -> DataFrame:
    """Each shard's tree, built once: the shard and the tree's bytes."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        cells = np.array(rows.column("v").to_pylist(), object)
        order = sorted(range(len(ids)), key=lambda k: (ids[k], cells[k]))
        order = [k for n, k in enumerate(order) if not n or (ids[k], cells[k]) != (ids[order[n - 1]], cells[order[n - 1]])]
        x = np.frombuffer(b"".join(cells[order]), kind).reshape(len(order), -1)
        tree = Tree(x.astype(np.float64), ids[order])
        made = pickle.dumps((x, tree.ids, tree.root), protocol=5)
        return pa.table([[k.as_py()] for k in key] + [[made]], schema=pa.schema([(c, pa.int32()) for c in SHARD] + [("tree", pa.binary())]))

    return placed.groupBy(*SHARD).applyInArrow(build, ", ".join(f"{c} int" for c in SHARD) + ", tree binary")


def _search(trees: DataFrame, asked: DataFrame, k: int, factor: float, kind: str, query_rows: int) -> DataFrame:
    """query_id, number, vec_id, score of ``asked`` (a shard, query_id, number, bound, v) in their shards.

    A tree travels once per ``query_rows`` queries of its shard, ahead of these queries, which stream past it.
    """
    counts = stored(asked.groupBy(*SHARD).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("salts")), "asked")
    heads = trees.join(counts, SHARD).select(*SHARD, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("double").alias("bound"), F.col("tree").alias("v"))
    mine = asked.join(counts, SHARD).select(*SHARD, F.pmod(F.xxhash64("query_id", "number"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "query_id", "number", "bound", "v")
    rows = heads.unionAll(mine).repartition(*SHARD, "salt").sortWithinPartitions(*SHARD, "salt", "kind")

    def work(batches):
        names = ["query_id", "number", "vec_id", "score"]
        tree = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(len(SHARD) + 1)])
            kinds = batch.column(len(SHARD) + 1).to_numpy()
            turns = np.flatnonzero((np.diff(keys) != 0).any(axis=0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(kinds)], strict=True):
                cells = batch.column(batch.num_columns - 1)
                if a < b and kinds[a] == 0:
                    x, ids, root = pickle.loads(cells[a].as_py())
                    tree = Tree.of(x.astype(np.float64), ids, root)
                    continue
                for i in range(a, b, QUERY_ROWS):
                    part = batch.slice(i, min(b - i, QUERY_ROWS))
                    own, number, bound = (part.column(c).to_numpy() for c in (-4, -3, -2))
                    best, best_id = tree.search(_matrix(part.column(-1), kind), own, k, factor, bound)
                    hit = best_id >= 0 if own.min() >= 0 else best_id != -1
                    spread = lambda c: np.broadcast_to(c[:, None], best.shape)[hit]  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (spread(own), spread(number), best_id[hit], best[hit])], names=names)

    return rows.mapInArrow(trimmed(work), "query_id long, number long, vec_id long, score double")


def _reached(asked: DataFrame, shells: list, points: dict[int, np.ndarray], factor: float, kind: str) -> DataFrame:
    """The shells, other than its own, that a query must search: those within factor * bound of it."""
    table = {dim: np.array([(r.point, r.shell, r.lo, r.hi) for r in shells if r.dim == dim]) for dim in {r.dim for r in shells}}

    def work(batches):
        for batch in batches:
            dims, home = batch.column(0).to_numpy(), np.stack([batch.column(c).to_numpy() for c in (1, 2)])
            bound = batch.column(5).to_numpy()
            for dim in set(dims.tolist()) & points.keys():
                at = np.flatnonzero(dims == dim)
                point, shell, lo, hi = table[dim].T
                step = max(1, (1 << 20) // len(lo))
                for i in range(0, len(at), step):
                    who = at[i : i + step]
                    part = batch.take(pa.array(who))
                    d = distances(_matrix(part.column(6), kind), points[dim])[:, point.astype(int)]
                    gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                    near = ~(gap > factor * bound[who][:, None] * (1 + 1e-12)) & ~((point == home[0, who][:, None]) & (shell == home[1, who][:, None]))
                    q, s = np.nonzero(near)
                    part = part.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(point[s].astype(np.int32)), pa.array(shell[s].astype(np.int32)), *part.columns[3:]], names=part.schema.names)

    names = [*SHELL, "query_id", "number", "bound", "v"]
    return asked.select(*names).mapInArrow(trimmed(work), "dim int, point int, shell int, query_id long, number long, bound double, v binary")


def nearest(vectors: DataFrame, k: int = 10, factor: float = 0.6, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows; by default ids divisible by 100 are queries."""
    is_query = is_query if is_query is not None else F.col("id") % 100 == 0
    given = vectors.schema[vector_col].dataType
    kind = "<f4" if isinstance(getattr(given, "elementType", None), T.FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    points = _points(rows, rows.count(), shard_rows)
    first = stored(_placed(rows, points, kind), "placed")
    placed = stored(_shelled(first, shard_rows), "shelled")
    discard(first)
    sizes = placed.groupBy(*SHELL).agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts"))
    sizes = stored(sizes, "shells")
    parts = F.broadcast(sizes.select(*SHELL, "parts"))
    trees = stored(_trees(placed.join(parts, SHELL).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int")), kind), "trees")
    asked = placed.where(is_query).select(*SHELL, F.col("id").alias("query_id"), F.xxhash64("v").alias("number"), F.lit(math.inf).alias("bound"), "v")
    asked = stored(asked.dropDuplicates(["query_id", "number"]), "queries")
    everywhere = lambda a: a.join(parts, SHELL).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    best = Window.partitionBy("query_id", "number").orderBy("score", "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = stored(ranked(_search(trees, everywhere(asked), k, factor, kind, query_rows)).drop("rank"), "home")
    reach = home.groupBy("query_id", "number").agg(F.when(F.count("*") >= k, F.max("score")).alias("t"))
    again = asked.join(reach, ["query_id", "number"], "left").withColumn("bound", F.coalesce("t", "bound")).drop("t")
    shells = sizes.where("point >= 0").collect()
    found = home.unionAll(_search(trees, everywhere(_reached(again, shells, points, factor, kind)), k, factor, kind, query_rows)) if len(shells) > 1 else home
    return ranked(found).select("query_id", "rank", "vec_id", "score")
