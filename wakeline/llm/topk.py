"""Exact top-k inner product search by no-random-access aggregation over sorted lists.

Candidates are dealt once into groups of some GROUP rows by a hash, every query goes to every group, and a task holds a
group in blocks of BLOCK rows and lets the queries stream by, ASKED at a time. In a block every component has a list of its entries in order
of value. A query reads all lists from their good ends at once, to equal depths (LOOKS), and takes nothing but
what it reads in this order. As all queries read to the same depths, what they have read is two tables (read from the one end and from the
other), and the bounds of ASKED queries on a block's candidates are one product of matrices. What has been read of a candidate is summed; what has not is at most the last value
read of that list and at least the value at its far end, so every candidate has a lower and an upper bound, and one
that no list has shown yet has the sum of all last values as its upper bound. The bar is the k-th lower bound, or
the k-th best score of the group's earlier blocks. Reading stops when no candidate outside the k best, seen or not, can
reach the bar, when RESOLVE or fewer still can, or when the lists end; then the final scores of these are resolved.
Only the k best of a group leave it, and are ranked over all groups.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without a
vec_id; vectors of another length than the query's are not its candidates. A query's own row is told
by its vec_id. Repeated rows are candidates each for itself, repeated queries are asked once (the smallest vector). Where
values are so large that a double does not hold the scores, and in blocks of RESOLVE rows or fewer, all
candidates are resolved at once. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from wakeline.llm.common import table

K = 5
BLOCK = 8192
GROUP = 1 << 16
ASKED = 512  # queries that read a block's lists together
LOOKS = (0.75, 0.875)  # shares of the lists after which queries that read together look at the bounds
CHUNKS = 32  # parts in which a list is read by one query, with a look at the bounds after each
RESOLVE = 64  # candidates left at which reading on costs more than resolving


def quantised(vectors: DataFrame, *more: Column) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component as a long, and `more` columns; rows that can take part only."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & sound)
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * 256.0)).alias("v"), *more)


class Block:
    """The sorted lists of a block of candidates of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.real = self.rows.astype(float)
        self.values = np.sort(self.real, axis=0)  # of each component's list, rising
        self.peak = float(np.abs(self.real).max(initial=0)) + 1

    def bounds(self, depth: int, upper: bool) -> np.ndarray:
        """Each candidate's components as lists read to `depth` show them to a query, from the far end down (for positive components) and from the near end up: what is not read yet counts as the last value read, or (lower bound) as the far end."""
        top, bottom = self.values[len(self.values) - depth], self.values[depth - 1]
        if upper:
            seen = np.maximum(self.real, top), np.minimum(self.real, bottom)
        else:
            seen = np.where(self.real >= top, self.real, self.values[0]), np.where(self.real <= bottom, self.real, self.values[-1])
        return np.hstack(seen).astype(np.float32)

    def search(self, query: np.ndarray, own: int, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """vec_ids and scores of the k best, ties to smaller ids, and how many list entries were read; scores under `bar` may be left out."""
        looks = [(i + 1) / CHUNKS for i in range(CHUNKS - 1)]
        _, ids, scores, read = self.search_all(query[None], np.array([own]), k, np.array([bar]), looks)
        return ids, scores, int(read[0])

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray, looks=LOOKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query by falling score: number of the query, vec_id, score; and how many list entries each query read."""
        n, dim = self.rows.shape
        low, high = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        at, scores = [], []
        exact = (np.abs(queries).max(axis=1, initial=0) + 1.0) * self.peak * dim < 2**52
        read = np.zeros(len(queries), np.int64)
        left = np.flatnonzero(exact & (queries != 0).any(axis=1)) if n > RESOLVE else np.empty(0, np.int64)
        whole = np.setdiff1d(np.arange(len(queries)), left)
        used, bar = (queries != 0).sum(axis=1), bars.astype(float)
        signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(np.float32)
        # more than the rounding of the sums in single precision; scores are whole numbers
        slack = 2.0**-22 * (dim + 2) * np.abs(queries).astype(float) @ np.abs(self.real).max(axis=0, initial=0) + 0.5
        unset = np.isneginf(bar)
        for look in looks:
            depth = max(1, int(np.ceil(n * look)))
            if not len(left) or depth >= n:
                break
            first = left[unset[left] & (n - (high - low)[left] >= k)]
            if len(first):
                least = signed[first] @ self.bounds(depth, False).T
                for i, q in enumerate(first.tolist()):
                    least[i, low[q] : high[q]] = -np.inf
                bar[first] = np.maximum(bar[first], np.partition(least, n - k, axis=1)[:, n - k] - slack[first])
            needed = np.nextafter((bar - slack)[left].astype(np.float32), np.float32(-np.inf))
            alive = signed[left] @ self.bounds(depth, True).T >= needed[:, None]
            for i in np.flatnonzero(high[left] > low[left]).tolist():
                alive[i, low[left[i]] : high[left[i]]] = False
            read[left] = depth * used[left]
            done = alive.sum(axis=1) <= RESOLVE
            q, c = np.nonzero(alive[done])
            q = left[done][q]
            at.append((q, c))
            scores.append(np.einsum("ij,ij->i", self.rows[c], queries[q]))
            left = left[~done]
        read[left] = n * used[left]
        for some in (left[i : i + 128] for i in range(0, len(left), 128)):  # lists that end before few are left
            self._resolve(some, queries[some].astype(float) @ self.real.T, low, high, k, at, scores)
        for q in whole.tolist():
            self._resolve(np.array([q]), (self.rows @ queries[q])[None], low, high, k, at, scores)
        q, c = (np.concatenate([x[i] for x in at]) if at else np.empty(0, np.int64) for i in (0, 1))
        return *best(q, self.ids[c], np.concatenate(scores).astype(np.int64) if scores else np.empty(0, np.int64), k), read

    def _resolve(self, q: np.ndarray, every: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, at: list, scores: list) -> None:
        """Adds the k best by all scores (a row a query), of equals those of the smallest ids, which come first."""
        allowed = np.ones(every.shape, bool)
        for i, x in enumerate(q.tolist()):
            allowed[i, low[x] : high[x]] = False
        for i, x in enumerate(q.tolist()):
            c = np.flatnonzero(allowed[i])
            c = c[np.argsort(-every[i, c], kind="stable")[:k]] if len(c) <= 4 * k else c[self._top(every[i, c], k)]
            at.append((np.full(len(c), x), c))
            scores.append(every[i, c].astype(np.int64))

    @staticmethod
    def _top(scores: np.ndarray, k: int) -> np.ndarray:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, equal = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
        return np.concatenate([over, equal[: k - len(over)]])


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each q, by q and falling score, ties to smaller ids."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[kept], ids[kept], scores[kept]


def stream(batches, k: int):
    """(query_id, vec_id, score) of rows (group, kind, vec_id, v) by group, candidates (kind 0) before queries: the k best of the group for each query."""
    group, held, blocks = None, {}, {}

    def blocks_of(dim: int) -> list[Block]:
        if dim in held:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim)))
            blocks[dim] = blocks.get(dim, []) + [Block(rows[at : at + BLOCK], ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
        return blocks.get(dim, [])

    for b in batches:
        groups, kind = np.asarray(b.column("group")), np.asarray(b.column("kind"))
        cuts = np.flatnonzero((np.diff(groups, prepend=groups[:1] - 1) != 0) | (np.diff(kind, prepend=-1) != 0))
        for a, z in zip(cuts, np.append(cuts[1:], len(groups))):
            if groups[a] != group:
                group, held, blocks = int(groups[a]), {}, {}
            part = b.slice(a, z - a)
            size, ids = np.asarray(part.column("v").value_lengths()), np.asarray(part.column("vec_id"))
            flat, starts = np.asarray(part.column("v").flatten()), np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                of = np.flatnonzero(size == dim)
                if not kind[a]:
                    held.setdefault(dim, []).append((ids[of], flat[starts[of, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                        blocks_of(dim)
                    continue
                for some in (of[i : i + ASKED] for i in range(0, len(of), ASKED)):
                    queries, own = flat[starts[some, None] + np.arange(dim)], ids[some]
                    q, found, scores = (np.empty(0, np.int64) for _ in range(3))
                    for block in blocks_of(dim):
                        n = np.bincount(q, minlength=len(some))
                        bars = np.full(len(some), -np.inf)
                        bars[n == k] = scores[np.cumsum(n)[n == k] - 1]
                        new_q, new_ids, new, _ = block.search_all(queries, own, k, bars)
                        q, found, scores = best(np.concatenate([q, new_q]), np.concatenate([found, new_ids]), np.concatenate([scores, new]), k)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    rows = quantised(vectors)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(4 * vectors.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // GROUP))
    left = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).alias("group"), F.lit(0).alias("kind"), "vec_id", "v")
    right = asked.select(F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("group"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = left.unionAll(right).repartition(groups, "group").sortWithinPartitions("group", "kind")
    best = dealt.mapInArrow(lambda batches: stream(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
