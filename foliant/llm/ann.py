"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

Inner product is no metric, so each shard adds one coordinate that brings all its vectors to one
length (and 0 to each query); Euclidean order then equals inner-product order and the triangle
inequality holds. A subtree is skipped where ``factor`` times the least distance that the triangle
inequality allows exceeds the distance of the k-th best found so far. Factor 1 skips only what
cannot matter, so the search is exact; larger factors skip more and may lose neighbours.

Vectors go to shards by a hash of their row's number, so neither a vector nor an id that many rows share
fills one shard. A task holds one shard's tree, which is built once, and the queries stream past it in
batches; so vectors are shuffled once, and queries once for each shard. Shards are searched in rounds
of growing size: after a round each query keeps its ``k`` best and hands their last score on, so later
shards prune by it from the start and report only what may still come in.

Vectors that are null, zero, of another length than the most common one, or that hold null or
non-finite numbers take no part, neither as queries nor as candidates. Rows with a null id take no
part. Rows with equal ids count as separate candidates, other than the query's own id, and rows of
queries with equal ids are queries of their own. Equal scores are ranked by the smaller id. An empty
table gives an empty result. Columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm._shared import durable, forget, require, table, written

K = 20
QUERY_STEP = 20
#: 1: exact. See the README for the recall of other factors.
FACTOR = 1.0
SHARD_ROWS = 4096
#: Queries that a shard's tree takes at a time.
QUERY_ROWS = 2048
#: Each round of shards is larger than the one before by this factor.
GROWTH = 8
LEAF = 512


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


class VantageTree:
    """A vantage-point tree over the rows of ``points``; leaves are index arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        vantage = rows[0]
        far = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(axis=1))
        radius = np.median(far)
        inner = far <= radius
        if inner.all():  # equal distances: more levels would not split them
            return rows
        near, rest = rows[inner], rows[~inner]
        return vantage, far[inner].max(), far[~inner].min(), self._build(near, leaf), self._build(rest, leaf)

    def search(self, queries: np.ndarray, visit, bound, factor: float) -> None:
        """Call ``visit(queries' rows, points' rows)`` for each leaf that may hold a better point.

        ``bound(rows)`` gives the distance of the k-th best of those queries so far, with a little
        slack so that rounding never skips what is exactly as near.
        """
        self._search(self.root, queries, np.arange(len(queries)), visit, bound, factor)

    def _search(self, node, queries, active, visit, bound, factor):
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            visit(active, node)
            return
        vantage, inner_max, outer_min, near, rest = node
        to_vantage = np.sqrt(((queries[active] - self.points[vantage]) ** 2).sum(axis=1))
        inside = to_vantage <= (inner_max + outer_min) / 2
        for first in (True, False):
            for child, is_near in ((near, True), (rest, False)):
                mine = inside == (is_near if first else not is_near)
                rows, d = active[mine], to_vantage[mine]
                least = d - inner_max if is_near else outer_min - d
                self._search(child, queries, rows[factor * least <= bound(rows)], visit, bound, factor)


class Shard:
    """The vectors of one shard in a tree over the lifted space."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, factor: float = FACTOR):
        order = np.argsort(ids, kind="stable")  # among equal scores the smaller id is met first and kept
        self.ids, self.vectors, self.factor = ids[order], vectors[order], factor
        square = (self.vectors**2).sum(axis=1)
        self.lift = square.max()
        self.slack = 1e-10 * max(self.lift, 1e-300)
        self.tree = VantageTree(np.hstack([self.vectors, np.sqrt(np.maximum(self.lift - square, 0))[:, None]]), LEAF)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int = K, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score in double precision) of the ``k`` best for each query that reach ``least``.

        ``own`` are the queries' ids, which are no candidates of theirs.
        """
        top = min(k, len(self.ids))
        least = np.full(len(queries), -np.inf) if least is None else least
        reach = (queries**2).sum(axis=1) + self.lift
        scores = np.full((len(queries), top), -np.inf)
        found = np.full((len(queries), top), -1, dtype=np.int64)

        def floor(rows):
            """The score that a point must reach to come in."""
            return np.maximum(scores[rows].min(axis=1), least[rows])

        def bound(rows):
            return np.sqrt(np.maximum(reach[rows] - 2 * floor(rows), 0) + self.slack)

        def visit(rows, points):
            new = queries[rows] @ self.vectors[points].T
            new[self.ids[points][None, :] == own[rows][:, None]] = -np.inf
            better = (new >= floor(rows)[:, None] - self.slack).any(axis=1)
            rows, new = rows[better], new[better]
            if not len(rows):
                return
            everything = np.hstack([scores[rows], new])
            places = np.hstack([found[rows], np.broadcast_to(points, new.shape)])
            cut = np.argpartition(-everything, top - 1, axis=1)[:, :top]
            kth = np.take_along_axis(everything, cut, 1).min(axis=1)
            # argpartition breaks ties anyhow, and a matrix product may give copies of one vector scores
            # that differ in the last bit: rows that are near a tie at the cut are put in exact order.
            tied = np.flatnonzero(np.isfinite(kth) & ((everything >= (kth - self.slack)[:, None]).sum(axis=1) > top))
            for i in tied:
                near = np.flatnonzero(everything[i] >= kth[i] - self.slack)
                exact = (queries[rows[i]] * self.vectors[places[i, near]]).sum(axis=1)
                cut[i] = near[np.lexsort((places[i, near], -exact))[:top]]
            scores[rows] = np.take_along_axis(everything, cut, 1)
            found[rows] = np.take_along_axis(places, cut, 1)

        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        self.tree.search(lifted, visit, bound, self.factor)
        q, j = np.nonzero(np.isfinite(scores) & (scores >= (least - self.slack)[:, None]))
        places = found[q, j]
        return q, self.ids[places], (queries[q] * self.vectors[places]).sum(axis=1)


FOUND = "q long, query_id long, vec_id long, score double"


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int, factor: float):
    """Rows arrive by shard, its vectors (without q) first and then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, shard, asked = None, [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if asked and points and shard is None:
                shard = Shard(*(np.concatenate(x) for x in zip(*points)), factor)
            if asked and shard is not None:
                q, ids, v, least = (np.concatenate(x) for x in zip(*asked))
                row, found, score = shard.search(ids, v, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(ids[row]), pa.array(found), pa.array(score)], ["q", "query_id", "vec_id", "score"])
            asked.clear()

        for batch in batches:
            of = batch.column("shard").to_numpy()
            is_query = batch.column("q").is_valid().to_numpy(zero_copy_only=False)
            ids, v = batch.column("id").to_numpy(), _vectors(batch.column("v"))
            q = batch.column("q").fill_null(-1).to_numpy()
            least = batch.column("least").fill_null(-np.inf).to_numpy()
            starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (is_query[1:] != is_query[:-1])]) if len(of) else []
            for s, e in zip(starts, [*starts[1:], len(of)]):
                if of[s] != at:
                    yield from answer()
                    at, points, shard = of[s], [], None
                if not is_query[s]:
                    points.append((ids[s:e], v[s:e]))
                    continue
                for i in range(s, e, QUERY_ROWS):
                    j = min(i + QUERY_ROWS, e)
                    asked.append((q[i:j], ids[i:j], v[i:j], least[i:j]))
                    if sum(len(x[0]) for x in asked) >= QUERY_ROWS:
                        yield from answer()
        yield from answer()

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` nearest to each of ``queries``."""

    def clean(df, number):
        rows = (
            require(df, id_col, vector_col)
            .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & usable(F.col("v")))
        )
        return durable(rows.withColumn(number, F.monotonically_increasing_id()))

    base, asked = clean(vectors, "n"), clean(queries, "q")
    common = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    shards = max(1, -(-base.count() // SHARD_ROWS))
    placed = base.select(F.pmod(F.xxhash64("n"), F.lit(shards)).cast("int").alias("shard"), "id", "v", F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("least"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    found, path, first, size = None, None, 0, 1
    while first < shards:
        last = min(shards, first + size)
        waiting = asked if found is None else asked.join(
            found.groupBy(F.col("q").alias("f_q")).agg(F.count_if(F.col("score").isNotNull()).alias("have"), F.min("score").alias("worst")), F.col("q") == F.col("f_q"), "left"
        )
        least = F.lit(None).cast("double") if found is None else F.when(F.col("have") >= k, F.col("worst"))
        streams = waiting.select(F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("shard"), "id", "v", "q", least.alias("least"))
        both = placed.where((F.col("shard") >= first) & (F.col("shard") < last)).unionByName(streams)
        new = both.repartition(last - first, "shard").sortWithinPartitions("shard", F.col("q").asc_nulls_first()).mapInArrow(_search(k, factor), FOUND)
        every = new if found is None else found.drop("rank").unionByName(new)
        old = path
        found, path = written(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if old:
            forget(base.sparkSession, old)
        first, size = last, size * GROWTH
    return found.select("query_id", "rank", "vec_id", "score")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
