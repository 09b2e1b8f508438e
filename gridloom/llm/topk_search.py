"""Operator 3, exact top-k search: ball-tree branch and bound in each shard, with a shared current kth score.

Candidates are cut into shards of bounded size, each with a ball tree of its own, built once and written. Blocks of queries,
as many as fit a bounded broadcast, go to the shards in two turns: to a sixteenth of the shards with a kth score that is
already reached among some of the queries' own vectors (they are candidates too), then to all others with the kth score
that the first turn reached. In a shard, nodes are opened in order of their upper bound q.c + |q|r on the inner product;
the search of a query ends when the best bound left is below its kth score, which the shared one and the shard's finds
both raise. Equal vectors are one point of the tree that keeps the rows it may need: the first k besides those of any one
id, 2 k at most, so a common vector doesn't slow the ties down.

Rows. Vectors that are null, or hold nulls or non-finite components, and rows without an id take no part. Components
that one vector lacks count as 0. Rows that share an id are one query (the smallest vector), and none of them is a
candidate of that query. Scores beyond 64 bits become the nearest number of 64 bits. Other columns are ignored. An empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_ROWS, release, staged, table

LEAF = 48
#: Rows of a shard, queries that are sent to all shards at once, and queries whose vectors give the first kth scores.
SHARD, BLOCK, PROBES = 1 << 16, 1 << 15, 2048
#: One in so many shards takes the first turn.
FIRST = 16
#: Above this, sums of products may not be exact in a double, and Python's integers are used.
EXACT = 1 << 22


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and q, the components as whole numbers floor(scale * x), of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def matrix(rows: list[list[int]], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, rows)])
    if rows and all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def needed(ids: np.ndarray, k: int) -> list[int]:
    """Of ids in ascending order, with repeats, the first that hold the first k besides any one id."""
    if len(ids) <= k:
        return ids.tolist()
    out: list[int] = []
    most = 0
    for v, n in zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True):
        n = min(n, k)
        out += [v] * n
        most = max(most, n)
        if len(out) - most >= k:
            break
    return out


class BallTree:
    """Balls around the distinct vectors of a shard; rows of equal vectors by ascending id, those that a search for k needs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids))
        self.ids = [needed(ids[a:b], k) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        self.x = vectors[first]
        self.exact = bool((np.abs(self.x) <= EXACT).all())
        self.order = np.arange(len(first))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left, right
        centres, radii = [], []
        f = self.x.astype(np.float64)
        todo = [(0, len(first), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                n = self.nodes[parent]
                self.nodes[parent] = (n[0], n[1], me, n[3]) if side == 0 else (n[0], n[1], n[2], me)
            own = f[self.order[a:b]]
            c = own.mean(0)
            centres.append(c)
            radii.append(np.sqrt(((own - c) ** 2).sum(1).max()))
            self.nodes.append((a, b, -1, -1))
            if b - a > LEAF:
                axis = int(np.argmax(own.max(0) - own.min(0)))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.sorted = self.x[self.order].astype(np.float64) if self.exact else self.x[self.order].astype(object)

    def widen(self, width: int) -> None:
        """Adds components of 0 up to `width`."""
        more = width - self.x.shape[1]
        if more:
            self.x, self.centres, self.sorted = (np.pad(a, ((0, 0), (0, more))) for a in (self.x, self.centres, self.sorted))

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id), without the id `own`; scores below `least` may be left out."""
        q = query.astype(np.float64)
        exact = self.exact and bool((np.abs(query) <= EXACT).all())
        norm = float(np.sqrt(q @ q))
        bounds = self.centres @ q + norm * self.radii
        bounds += 1e-9 * (1 + np.abs(bounds) + norm * (self.radii + np.sqrt((self.centres**2).sum(1))))
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, i = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else least
            if kth is not None and least is not None:
                kth = max(kth, least)
            if kth is not None and -bound < kth:
                break
            a, b, left, right = self.nodes[i]
            if left >= 0:
                for j in (left, right):
                    if kth is None or bounds[j] >= kth:
                        heapq.heappush(heap, (-bounds[j], j))
                continue
            scores = self.sorted[a:b] @ q if exact else self.sorted[a:b].astype(object) @ query.astype(object)
            for j in range(b - a) if kth is None else np.flatnonzero(scores >= kth).tolist():
                score = int(scores[j])
                for v in self.ids[self.order[a + j]]:
                    if v != own:
                        if len(best) < k:
                            heapq.heappush(best, (score, -v))
                        elif (score, -v) > best[0]:
                            heapq.heapreplace(best, (score, -v))
        return best


def shared_bounds(ids: np.ndarray, queries: np.ndarray, k: int) -> list[int | None]:
    """Of each query, the kth best score among some other queries, which the kth best of all can't fall below."""
    probes = np.arange(0, len(ids), max(1, len(ids) // PROBES))[:PROBES]
    if len(probes) <= k or not (np.abs(queries) <= EXACT).all():
        return [None] * len(ids)
    f = queries.astype(np.float64)
    out: list[int | None] = []
    for at in range(0, len(ids), 512):
        scores = f[at : at + 512] @ f[probes].T
        scores[ids[at : at + 512, None] == ids[probes]] = -np.inf
        out += [int(x) for x in -np.partition(-scores, k - 1, axis=1)[:, k - 1]]
    return out


def build_trees(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """number, tree: the written ball trees of all shards, each of `shard` rows or fewer of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, names, rows = TaskContext.get().partitionId() << 20, [], []

        def tree() -> pa.RecordBatch:
            width = max(r.shape[1] for r in rows)
            own = BallTree(np.array(names, np.int64), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]), k)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(own, 5)], pa.binary())], ["number", "tree"])

        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                some = batch.slice(at, shard)
                if names and len(names) + some.num_rows > shard:
                    yield tree()
                    number, names, rows = number + 1, [], []
                names += some.column(0).to_pylist()
                rows.append(matrix(some.column(1).to_pylist()))
        if names:
            yield tree()

    return staged(vectors.mapInArrow(run, "number long, tree binary"), "ball-trees")


def search_block(trees: DataFrame, ids: np.ndarray, queries: np.ndarray, least: list[int | None], k: int) -> DataFrame:
    """query_id, vec_id, score of each shard's best for a block of queries."""
    sent = trees.sparkSession.sparkContext.broadcast((ids, queries, least))
    limit = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                tree = pickle.loads(data)
                ids, queries, least = sent.value
                width = max(queries.shape[1], tree.x.shape[1])
                tree.widen(width)
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                out: list[tuple[int, int, int]] = []
                for own, q, bound in zip(ids.tolist(), queries, least, strict=True):
                    out += [(own, -v, max(-limit, min(limit, s))) for s, v in tree.search(q, own, k, bound)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 3)], ["query_id", "vec_id", "score"])

    return trees.select("tree").mapInArrow(run, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows. is_query: a condition on vec_id."""
    return release(lambda: _top_k(vectors, is_query, k, scale, block, shard), "top-k")


def _top_k(vectors: DataFrame, is_query, k: int, scale: int, block: int, shard: int) -> DataFrame:
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    q = quantised(vectors, scale)
    asked = staged(q.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    blocks = -(-asked.count() // block)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not blocks:
        return out
    trees = build_trees(q, k, shard)
    one_turn = trees.count() < 2 * FIRST
    for part in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).orderBy("vec_id").collect()  # a block of queries
        if not own:
            continue
        ids, queries = np.array([r.vec_id for r in own], np.int64), matrix([r.q for r in own])
        least = shared_bounds(ids, queries, k)
        turns = [F.lit(True)] if one_turn else [F.pmod(F.xxhash64("number"), F.lit(FIRST)) == 0, F.pmod(F.xxhash64("number"), F.lit(FIRST)) != 0]
        found = None
        for turn in turns:
            got = search_block(trees.where(turn), ids, queries, least, k)
            found = staged(best_of(got if found is None else found.drop("rank").unionAll(got), k), "found")
            if turn is not turns[-1]:  # the kth scores that the first shards reached, a row for each query of the block
                reached = {r.query_id: r.score for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
                least = [max((x for x in (b, reached.get(i)) if x is not None), default=None) for i, b in zip(ids.tolist(), least, strict=True)]
        out = out.unionAll(found)
    return out


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
