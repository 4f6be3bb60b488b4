"""Periodic run detection by an all-lag scan of word ids.

A run is a stretch of consecutive words whose smallest period q (words q apart are identical) fits at least
EXPONENT times, of LEAST words or more, that no neighbouring word extends. For each lag q up to n / EXPONENT the
array of word ids is compared with itself shifted by q, and the stretches of equal places are run-length coded: one
of L places is a run of L + q words. Such a stretch has `step` places or more, so a first look at every step-th
place (and its neighbours) tells the lags that hold none. A stretch that also has a smaller period is found there
with the same bounds, as that period divides the lag; so the smallest lag of a (start, length) is its period.

Texts are scanned in blocks of some BLOCK words, longest first, all texts of a block at one lag at once. A text
that needs more than RANGE comparisons is dealt out as (text, every k-th lag) rows, which go to separate tasks; its
runs come together afterwards, fewer than the text has words.

Null and empty texts have no runs and collapse to an empty text. A null doc_id stays. Repeated rows and repeated
ids are rows of their own; an empty table gives none. A very long text costs its length in each of its lag ranges.
Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import table

LEAST = 24
EXPONENT = 3
BLOCK = 1 << 16
RANGE = 1 << 26
RUNS = "array<struct<start:long,length:long,period:long>>"
SPACE = r"[\x20\x09-\x0D]+"


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: just the six ASCII white space characters


def scan(ids: np.ndarray, sizes: np.ndarray, lags: Iterable[int]) -> np.ndarray:
    """Rows (start, length, period) of the stretches at the lags; ids: the texts in a row, no id in two texts; sizes: their words, falling."""
    ends, found = np.cumsum(sizes), [np.empty((0, 3), np.int64)]
    for q in lags:
        texts = int(np.searchsorted(-sizes, -max(LEAST, EXPONENT * q), "right"))
        if not texts:
            break
        n = int(ends[texts - 1])
        a, b, step = ids[: n - q], ids[q:n], max(LEAST - q, (EXPONENT - 1) * q)
        seen = np.flatnonzero(a[::step] == b[::step]) * step
        before, after = np.maximum(seen - 1, 0), np.minimum(seen + 1, n - q - 1)
        if not (((seen > 0) & (a[before] == b[before])) | ((seen + 1 < n - q) & (a[after] == b[after]))).any():
            continue
        same = np.zeros(n - q + 2, bool)
        np.equal(a, b, out=same[1:-1])
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, length = edges[::2], edges[1::2] - edges[::2]
        long = length >= step
        found.append(np.column_stack([start[long], length[long] + q, np.full(long.sum(), q)]))
    return np.concatenate(found)


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' word ids in a row, longest text first; the order of the texts and their sizes in it."""
    sizes = np.array([len(w) for w in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    parts, used = [np.empty(0, np.int32)], 0
    for i in order.tolist():
        words = pa.array(texts[i], pa.binary()).dictionary_encode()
        parts.append(np.asarray(words.indices) + np.int32(used))
        used += len(words.dictionary)
    return np.concatenate(parts), order, sizes[order]


def runs_of(texts: list[list[bytes]], part: int = 0, parts: int = 1) -> list[np.ndarray]:
    """For each text its runs (start, length, period) by start and period, at every parts-th lag."""
    ids, order, sizes = coded(texts)
    longest = int(sizes[0]) if len(sizes) else 0
    found = scan(ids, sizes, range(1 + part, longest // EXPONENT + 1, parts))
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(1)  # the smallest period of a stretch
    found = found[fresh]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    begins = np.cumsum(sizes) - sizes
    at = np.searchsorted(found[:, 0], begins)
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for k, i in enumerate(order.tolist()):
        out[i] = found[at[k] : at[k + 1] if k + 1 < len(at) else None] - np.array([begins[k], 0, 0])
    return out


def collapse(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run its first period only."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])


def blocks(rows: Iterable[list[bytes]]):
    """Lists of texts of some BLOCK words in all."""
    held, n = [], 0
    for words in rows:
        held.append(words)
        n += len(words)
        if n >= BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed; each text in one piece."""

    def run(batches):
        for b in batches:
            raw, at = b.column("text").to_pylist(), 0
            order = sorted(range(len(raw)), key=lambda i: len(raw[i]))  # texts alike in length share a block, so that no lag runs over a few of them only
            ids = b.column("doc_id").take(pa.array(order, pa.int64()))
            for texts in blocks(split(raw[i]) for i in order):
                found = runs_of(texts)
                shown = [collapse(w, r.tolist()).decode() for w, r in zip(texts, found)]
                runs = [[dict(zip(("start", "length", "period"), x)) for x in r.tolist()] for r in found]
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(runs, kind), pa.array(shown, pa.string())], ["doc_id", "runs", "collapsed"])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed of rows (doc_id, text, parts), each text scanned as `parts` ranges of lags in separate tasks."""
    key = ["doc_id", "hash"]
    each = docs.groupBy("doc_id", F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("text"), F.first("parts").alias("parts"), F.count("*").alias("copies"))
    ranges = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition("hash", "part")

    def run(batches):
        for b in batches:
            for doc_id, digest, text, part, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hash", "text", "part", "parts"))):
                (found,) = runs_of([split(text)], part, parts)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array([digest] * len(found), pa.string()), *(pa.array(found[:, k]) for k in range(3))], [*key, "start", "length", "period"])

    found = ranges.select(*key, "text", "part", "parts").mapInArrow(run, "doc_id long, hash string, start long, length long, period long")
    least = found.groupBy(*key, "start", "length").agg(F.min("period").alias("period"))
    runs = least.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    both = each.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")

    def cut(batches):
        for b in batches:
            runs = [r or [] for r in b.column("runs").to_pylist()]
            shown = [collapse(split(t), [(x["start"], x["length"], x["period"]) for x in r]).decode() for t, r in zip(b.column("text").to_pylist(), runs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, b.schema.field("runs").type), pa.array(shown, pa.string())], ["doc_id", "runs", "collapsed"])

    copies = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("doc_id", "text", "runs").mapInArrow(cut, f"doc_id long, runs {RUNS}, collapsed string")


def find(docs: DataFrame, most: int = RANGE) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed (the words without what repeats) for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.when(F.length("text").cast("double") ** 2 / 4 / EXPONENT > most, F.size(F.split("text", SPACE))).otherwise(0).cast("double")  # others are short whatever their words
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.ceil(words * words / EXPONENT / most)).cast("int"))
    return scanned(rows.filter("parts = 1")).unionAll(in_ranges(rows.filter("parts > 1")))


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, in one of ten documents periodic from some place on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, its words joined by a space after `repeated`."""

    def run(batches):
        for b in batches:
            texts = [b" ".join(repeated(i, split(t))).decode() for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(with_repeats(table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
