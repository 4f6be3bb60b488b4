"""Toxicity: cumulative-link ordinal regression on sparse word features.

Grades are ordered: 0 clean, 1 toxic, 2 toxic and of low quality (the labels have no finer severity). One weight vector is shared by all
thresholds: P(grade >= k) = sigmoid(x.w - cut_k) with cut_1 <= cut_2. Features are words and their
prefixes, counted and divided by the square root of the number of words. The model is fitted on at
most SAMPLE toxic and twice as many clean labelled rows, those with the smallest hashes of doc_id, weighted back to the
classes' true sizes, with an L1 penalty, so that few weights remain. Every document is scored whole.

Null and empty texts score as a text without words. Labels that are null, or of documents that do
not exist, are left out; of documents that share a labelled doc_id one is fitted on. Without both classes in the labels every document gets the grade 0 or the
only class there is. Repeated documents are scored each for itself; a very long text costs its length. Only doc_id, text, toxic and
quality are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import table
from wakeline.llm.counts import slices

SAMPLE = 2500  # toxic labelled rows at most; twice as many clean ones
GRADES = 3
PREFIXES = (4, 5, 6)
MIN_DOCS = 3
STEPS = 450
PENALTY = 2e-3
LENGTH_POWER = 0.5
REJECT = 0.3
BUCKETS = 1 << 22
TRIM = " .,;:!?\"'()[]{}<>#*%$&|-_/"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word of each place, and the bounds of each text's places."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[\t-\r]", " ")
    split = pc.split_pattern(clean, " ")
    coded = split.flatten().dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, characters=TRIM).dictionary_encode()
    return bare.dictionary, np.asarray(bare.indices)[np.asarray(coded.indices)], np.asarray(split.offsets)


def features(word: str) -> list[int]:
    """Hashed ids of the word and its prefixes."""
    return [zlib.crc32(f.encode()) % BUCKETS for f in (word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k))] if word else []


@dataclass
class Ordinal:
    weights: dict[int, float]
    cuts: list[float]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k), k = 1.., a row per text."""
        known, codes, bounds = words(texts)
        get = self.weights.get
        weight = np.array([sum([get(f, 0.0) for f in features(w)]) for w in known.to_pylist()], float)
        counts = np.asarray(pc.not_equal(known, ""), float)
        total = np.concatenate([[0], np.cumsum(weight[codes])])
        n = np.concatenate([[0], np.cumsum(counts[codes])])
        score = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, n[bounds[1:]] - n[bounds[:-1]]) ** LENGTH_POWER
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts) - score[:, None], -50, 50)))


def fit(cols: np.ndarray, vals: np.ndarray, size: np.ndarray, grade: np.ndarray, share: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Ordinal:
    """cols, vals: feature ids and values of all documents in a row; size: how many each has; share: its weight."""
    keep = np.bincount(cols, minlength=1) >= MIN_DOCS
    names, index = np.flatnonzero(keep), (np.cumsum(keep) - 1).astype(np.int32)
    used = keep[cols]
    cols, vals, owner = index[cols[used]], vals[used], np.repeat(np.arange(len(size), dtype=np.int32), size)[used]
    del keep, index, used
    rows, share = np.arange(len(size)), share / share.sum()
    w, cuts = np.zeros(len(names)), np.array([np.log((share[grade < k].sum() + 1e-4) / (share[grade >= k].sum() + 1e-4)) for k in range(1, GRADES)])
    cuts = np.maximum.accumulate(cuts)
    g2, c2 = np.full(len(w), 1e-8), np.full(len(cuts), 1e-8)
    above = grade[:, None] >= np.arange(1, GRADES)
    for _ in range(steps):  # proximal AdaGrad
        score = np.bincount(owner, vals * w.astype(np.float32)[cols], len(rows))
        p = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -50, 50)))
        edge = np.column_stack([np.ones(len(rows)), p, np.zeros(len(rows))])
        of = np.maximum(1e-9, edge[rows, grade] - edge[rows, grade + 1])
        slope = np.column_stack([np.zeros(len(rows)), p * (1 - p), np.zeros(len(rows))])
        lower, upper = slope[rows, grade], slope[rows, grade + 1]
        d = share * (upper - lower) / of  # derivative of the loss by the score
        gw = np.bincount(cols, vals * d.astype(np.float32)[owner], len(w)) if len(w) else w
        gc = np.zeros(len(cuts))
        for k in range(1, GRADES):
            s = slope[:, k] * share / of
            gc[k - 1] = s[grade == k].sum() - s[grade == k - 1].sum()
        g2 += gw**2
        c2 += gc**2
        rate = 0.7 / np.sqrt(g2)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalty * 0.05)
        cuts = np.maximum.accumulate(cuts - 0.3 * gc / np.sqrt(c2))
    return Ordinal({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, [float(x) for x in cuts])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    grade = F.when(toxic == 0, 0).when((toxic == 1) & (F.coalesce(quality, F.lit(1)) == 1), 1).when(toxic == 1, 2)
    return labels.select(F.col("doc_id").cast("long"), grade.alias("grade")).filter("doc_id is not null and grade is not null")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits on the labelled rows with the smallest hashes, `sample` toxic ones and twice as many clean ones."""
    marks = graded(labels)
    sizes = {r.toxic: r["count"] for r in marks.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    order = F.xxhash64("doc_id")
    chosen = marks.filter("grade = 0").orderBy(order, "doc_id").limit(2 * sample).unionAll(marks.filter("grade > 0").orderBy(order, "doc_id").limit(sample))

    def run(batches):
        for b in slices(batches):
            known, codes, bounds = words(b.column("text"))
            names = [features(w) for w in known.to_pylist()]
            got = []
            for i, j in zip(bounds[:-1], bounds[1:]):
                counts: dict[int, int] = {}
                at, n = np.unique(codes[i:j], return_counts=True)
                total = 0
                for word, k in zip(at.tolist(), n.tolist()):
                    total += k * bool(names[word])
                    for f in names[word]:
                        counts[f] = counts.get(f, 0) + k
                got.append((list(counts), [k / max(1, total) ** LENGTH_POWER for k in counts.values()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.float32()))], ["doc_id", "grade", "names", "counts"])

    # One row for each chosen id (of repeated ones that with the smallest hash of its text), so 3 * sample at most, whatever the size of the tables.
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen.groupBy("doc_id").agg(F.min("grade").alias("grade"))), "doc_id")
    text = text.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = text.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, names array<int>, counts array<float>").toArrow()
    if not rows.num_rows:
        return Ordinal({}, [50.0] * (GRADES - 1))
    rows = rows.take(pc.sort_indices(rows["doc_id"])).combine_chunks()
    names, counts, grade = (rows[c].combine_chunks() for c in ("names", "counts", "grade"))
    cols, vals, size, grade = np.array(names.flatten()), np.array(counts.flatten()), np.array(pc.list_value_length(names)), np.array(grade)
    del rows, names, counts  # numbers of 4 bytes are all that the fit holds
    pa.default_memory_pool().release_unused()
    share = np.array([sizes.get(bool(g), 0) / np.sum((grade > 0) == g) for g in grade > 0])
    return fit(cols, vals, size, grade, share)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, p_toxic, p_severe, severity (the expected grade) and toxic per document."""

    def run(batches):
        for b in slices(batches):
            p = model.probabilities(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(GRADES - 1)), pa.array(p.sum(1)), pa.array(p[:, 0] >= REJECT)], ["doc_id", "p_toxic", "p_severe", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, p_toxic double, p_severe double, severity double, toxic boolean")


def clean(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of docs that are not toxic."""

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(model.probabilities(b.column("text"))[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
