"""Hard-negative mining by inner product, with bounds in a basis turned to the principal components.

The rows' second moments over all vectors give an orthogonal rotation whose leading components hold most of the
length. For an anchor and a block of candidates the products of the leading components are summed step by step;
what is left is at most the product of the two residual norms, plus a slack for the rounding of the rotation. A
candidate goes as soon as these bounds put it outside every wanted window of scores, or under the k-th best score
that is certain in it. The survivors' scores are integer products of the unturned vectors, so results are exact
whatever the rotation.

The first search gives each anchor its positives (rows of its label), the second, with one window per positive,
their negatives (rows of other labels). Candidates are dealt once into groups of some GROUP rows by a hash, every
anchor goes to every group, and a task holds one group and lets the anchors stream by; equal vectors of one label
are compared once, with their smallest ids. Only the best of a group leave it, and are ranked over all groups.

Rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take no part; vectors
of another length than the anchor's are no candidates. An anchor's own row is told by its vec_id; repeated rows are
rows of their own, repeated anchors are asked once (the smallest label and vector). Ties go to smaller ids. An
empty table gives none. Scores past 2^63 wrap. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from wakeline.llm.common import materialise, table
from wakeline.llm.topk import quantised

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
EVERY = 100
GROUP = 1 << 16
PARTS = (8, 4, 2)  # looks at the bounds after an 8th, a 4th and half of the components
RESOLVE = 32
CHUNK = 16  # anchors whose first products are made at once


def moments(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The commonest length of the vectors and the sum of their outer products; d * d numbers, summed on the executors."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            size = np.asarray(b.column("v").value_lengths())
            flat, starts = np.asarray(b.column("v").flatten()).astype(float), np.cumsum(size) - size
            for d in np.unique(size).tolist():
                x = flat[starts[size == d][:, None] + np.arange(d)]
                sums[d] = sums.get(d, np.zeros((d, d))) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["d", "at", "m"])

    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not top:
        return 0, np.empty((0, 0))
    d = top[0].d
    got = rows.filter(F.size("v") == d).mapInArrow(run, "d long, at long, m double").groupBy("at").agg(F.sum("m").alias("m")).toPandas()
    return d, got.sort_values("at")["m"].to_numpy().reshape(d, d)


def rotation(second: np.ndarray) -> np.ndarray:
    """Rows are orthonormal directions, by falling share of the length."""
    if not np.isfinite(second).all():
        return np.eye(len(second))
    return np.linalg.eigh((second + second.T) / 2)[1].T[::-1].copy()


class Block:
    """Candidates of one length in the turned basis; equal rows of one label are held once, with their `keep` smallest ids."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, turn: np.ndarray, keep: int):
        rows, labels, ids = distinct(rows, labels, ids, keep)
        same = np.zeros(len(ids), bool)
        same[1:] = (labels[1:] == labels[:-1]) & (rows[1:] == rows[:-1]).all(1)
        first = np.flatnonzero(~same)
        self.rows, self.labels, self.ids, self.bounds = rows[first], labels[first], ids, np.append(first, len(ids))
        real = self.rows.astype(float)
        self.turned = real @ turn.T
        d = rows.shape[1]
        self.stops = sorted({max(1, d // p) for p in PARTS})
        self.rest = [np.sqrt((self.turned[:, s:] ** 2).sum(1)) for s in self.stops]
        self.norm = np.sqrt((real**2).sum(1))
        self.slack = float(np.abs(turn @ turn.T - np.eye(d)).sum()) + d * d * 2.0**-48
        self.peak = float(np.abs(real).max(initial=0)) + 1
        self.turn, self.real = turn, real

    def leading(self, queries: np.ndarray) -> np.ndarray:
        """Products of the first components, a row a query."""
        return (queries.astype(float) @ self.turn[: self.stops[0]].T) @ self.turned[:, : self.stops[0]].T

    def search(self, query: np.ndarray, first: np.ndarray, chosen: np.ndarray, own: int | None, low: np.ndarray, high: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window low..high the k best (ids, scores) in it, and how many rows were verified; `chosen` tells the candidates."""
        q = query.astype(float)
        turned, size, bars = self.turn @ q, float(np.sqrt((q**2).sum())), low.astype(float)
        if own is not None:  # a row that is there under the anchor's id alone must not raise the bars
            ends, mine = self.bounds[1:], np.append(0, np.cumsum(self.ids == own))
            chosen = chosen & (mine[ends] - mine[self.bounds[:-1]] < ends - self.bounds[:-1])
        alive, part, at = np.flatnonzero(chosen), first[chosen], 0
        for n, stop in enumerate(self.stops):
            if n:
                part = part + self.turned[alive, at:stop] @ turned[at:stop]
            at = stop
            left = self.rest[n][alive] * float(np.sqrt((turned[stop:] ** 2).sum())) + self.slack * size * self.norm[alive] + 1e-6
            most, least, keep = part + left, part - left, np.zeros(len(alive), bool)
            for i in range(len(low)):
                sure = least[most <= high[i]]
                if len(sure) >= k:
                    bars[i] = max(bars[i], np.partition(sure, len(sure) - k)[len(sure) - k])
                keep |= (most >= bars[i]) & (least <= high[i])
            alive, part = alive[keep], part[keep]
            if len(alive) <= RESOLVE:
                break
        exact = (float(np.abs(q).max(initial=0)) + 1) * self.peak * len(q) < 2**52
        score = (self.real[alive] @ q).astype(np.int64) if exact else self.rows[alive] @ query
        copies = self.bounds[alive + 1] - self.bounds[alive]
        ids = self.ids[np.repeat(self.bounds[alive], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)]
        score = np.repeat(score, copies)
        if own is not None:
            ids, score = ids[ids != own], score[ids != own]
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        out = []
        for lo, hi in zip(low, high):
            inside = np.flatnonzero((score >= lo) & (score <= hi))[:k]
            out.append((ids[inside], score[inside]))
        return out, len(alive)


def distinct(rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by content and id; of equal ones the `keep` with the smallest ids."""
    content = np.ascontiguousarray(np.column_stack([labels, rows])).view(np.dtype((np.void, 8 * (rows.shape[1] + 1)))).ravel()
    group = np.unique(content, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    group = group[order]
    begins = np.append(0, np.flatnonzero(np.diff(group)) + 1) if len(group) else np.empty(0, np.int64)
    place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    order = order[place < keep]
    return rows[order], labels[order], ids[order]


SCHEMA = "group long, kind int, vec_id long, label long, v array<long>, low array<double>, high array<double>"


def stream(batches, turn: np.ndarray, k: int, own_label: bool):
    """(anchor_id, window, vec_id, score) of rows by group, candidates (kind 0) before anchors; the k best of the group in each of an anchor's windows."""
    group, held, blocks = None, {}, {}

    def hold(d, rows, labels, ids):
        held.setdefault(d, []).append((rows, labels, ids))
        if sum(len(x[2]) for x in held[d]) > 2 * GROUP:  # repeated rows, as a group has some GROUP others
            held[d] = [distinct(*(np.concatenate(x) for x in zip(*held[d])), k + 1)]

    def block(d):
        if d not in blocks and d in held:
            blocks[d] = Block(*(np.concatenate(x) for x in zip(*held.pop(d))), turn if len(turn) == d else np.eye(d), k + 1)
        return blocks.get(d)

    for b in batches:
        groups, kind = np.asarray(b.column("group")), np.asarray(b.column("kind"))
        cuts = np.flatnonzero((np.diff(groups, prepend=groups[0] - 1) != 0) | (np.diff(kind, prepend=-1) != 0))
        for a, z in zip(cuts, np.append(cuts[1:], len(groups))):
            if groups[a] != group:
                group, held, blocks = int(groups[a]), {}, {}
            part = b.slice(a, z - a)
            size = np.asarray(part.column("v").value_lengths())
            flat, starts = np.asarray(part.column("v").flatten()), np.cumsum(size) - size
            ids, labels = np.asarray(part.column("vec_id")), np.asarray(part.column("label"))
            windows = list(zip(part.column("low").to_pylist(), part.column("high").to_pylist())) if kind[a] else []
            found = []
            for d in np.unique(size).tolist():
                of = np.flatnonzero(size == d)
                rows = flat[starts[of, None] + np.arange(d)]
                if not kind[a]:
                    hold(d, rows, labels[of], ids[of])
                elif block(d) is not None:
                    for at in range(0, len(of), CHUNK):
                        some = of[at : at + CHUNK]
                        leading = blocks[d].leading(rows[at : at + CHUNK])
                        for j, first, i in zip(range(at, at + CHUNK), leading, some.tolist()):
                            chosen = (blocks[d].labels == labels[i]) == own_label
                            low, high = (np.array(x) for x in windows[i])
                            got, _ = blocks[d].search(rows[j], first, chosen, int(ids[i]) if own_label else None, low, high, k)
                            found += [(int(ids[i]), w, *x) for w, x in enumerate(got) if len(x[0])]
            if found:
                n = [len(x[2]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in found], n)), pa.array(np.repeat([x[1] for x in found], n), pa.int32()), pa.array(np.concatenate([x[2] for x in found])), pa.array(np.concatenate([x[3] for x in found]))], ["anchor_id", "window", "vec_id", "score"]
                )


def best(rows: DataFrame, anchors: DataFrame, turn: np.ndarray, k: int, own_label: bool) -> DataFrame:
    """anchor_id, window, place (from 1), vec_id, score: the k best candidates in each of an anchor's windows (arrays low and high)."""
    spark = rows.sparkSession
    groups = max(4 * spark.sparkContext.defaultParallelism, -(-rows.count() // GROUP))
    no = F.array().cast("array<double>")
    left = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).alias("group"), F.lit(0).alias("kind"), "vec_id", "label", "v", no.alias("low"), no.alias("high"))
    right = anchors.select(F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("group"), F.lit(1).alias("kind"), "vec_id", "label", "v", "low", "high")
    dealt = left.unionAll(right).repartition(groups, "group").sortWithinPartitions("group", "kind")
    got = dealt.mapInArrow(lambda batches: stream(batches, turn, k, own_label), "anchor_id long, window int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("place", place).filter(F.col("place") <= k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding)."""
    labels = vectors.filter(F.col("label").isNotNull())
    rows = quantised(labels, F.col("label").cast("long").alias("label"))
    turn = rotation(moments(rows)[1])
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    asked = materialise(asked, "anchors")
    every_score = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    near = best(rows, asked.withColumns(dict(zip(("low", "high"), every_score))), turn, positives, True)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # `positives` at most
    near = materialise(near, "positives")
    down = lambda x: F.floor(x / F.lit(100).cast("decimal(3,0)")).cast("double")
    least, most = (F.transform("near", lambda p: -down(p["score"].cast("decimal(25,0)") * -low)), F.transform("near", lambda p: down(p["score"].cast("decimal(25,0)") * high)))
    both = asked.join(near, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", least.alias("low"), most.alias("high"))
    far = best(rows, both, turn, negatives, False).select("anchor_id", "window", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    each = near.select("anchor_id", F.posexplode("near").alias("window", "p")).select("anchor_id", "window", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return far.join(each, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
