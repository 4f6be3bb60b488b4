"""Near copies by exact Jaccard similarity of five-word shingles: SimHash links first, MinHash bands for what they cannot see.

Texts of equal words are one class. The fingerprints of the classes over five-word shingles are linked by the
binary trie self-join of `simhash`, and what it links is verified by the Jaccard similarity of the shingles, LEAST
percent or more. Two texts at 0.8 differ by some 10 of 64 bits, so the budget of 4 bits finds few of them (README has
figures), and no wider budget prunes the trie. So each class also has BANDS hashes of ROWS minima; classes that
share one lie in a bucket. While buckets are long, their members are compared with one of them, as many times as
that halves what is left; then all classes of mixed buckets are compared where they share one of their rarest
shingles, which all similar texts do (`jaccard.rare_pairs`). So a bucket costs its size, not its square, and no pair that shares a
bucket is lost; a pair at 0.8 shares one with probability 0.9996. The groups are the connected components of the links.

A text of five words or fewer is one shingle; null, empty and blank texts are equal. Repeated rows and ids are
rows of their own; an empty table gives none. A very long text costs its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from wakeline.llm.common import discard, materialise
from wakeline.llm.components import components
from wakeline.llm.counts import slices
from wakeline.llm.jaccard import ROUNDS_WHILE, rare_pairs, shingle_sets, verified
from wakeline.llm.simhash import fingerprint, near_links

WORDS = 5
LEAST = 80  # percent
BANDS, ROWS = 20, 5
SEED = 42


def bands(shingle: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS minima each."""
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(shingle), 4096):
        x = shingle[i : i + 4096, None] * factors
        low = np.minimum(low, ((x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)).min(0))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ low[k::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out


def sketches(rows: DataFrame) -> DataFrame:
    """row, doc_id, key (of the text's words), n (shingles), fp (of the shingles), bands."""

    def run(batches):
        import xxhash

        factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            keys = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            sets = [(len(x), bands(x, factors).view(np.int64)) for x in shingle_sets(b.column("text"), WORDS)]
            fps = np.array([fingerprint(t, WORDS) for t in texts], np.uint64).view(np.int64)
            n, own = pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(keys, pa.binary()), n, pa.array(fps), own], ["row", "doc_id", "key", "n", "fp", "bands"])

    return rows.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, key binary, n long, fp long, bands array<long>")


def fingerprint_pairs(classes: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes: those of one fingerprint with the first of them (prints: fp, head), and a forest of the trie's links between fingerprints."""
    same = classes.join(prints, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = lambda end: prints.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    links = near_links(prints).join(heads("a"), "a").join(heads("b"), "b")
    return same.unionAll(links.select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))).distinct()


def distinct_rows(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with the smallest doc_id (null only if no other is there); the columns of docs."""
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its number
    seen = materialise(sketches(rows), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = seen.groupBy("key").agg(least.alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = materialise(classes.select(F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), "n", "fp", "bands"), "classes")
    every = classes.filter("n > 0").select("node", "n", F.explode("bands").alias("bucket"))
    discard(seen)
    shared = every.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = materialise(every.join(shared, "bucket"), "members")
    prints = materialise(classes.groupBy("fp").agg(F.min("node").alias("head")), "prints")
    tried = materialise(fingerprint_pairs(classes, prints), "pairs")
    discard(prints)
    wanted = members.select(F.col("node").alias("row")).unionAll(tried.select("a")).unionAll(tried.select("b")).distinct()
    texts = materialise(rows.join(wanted, "row", "left_semi").select(F.col("row").alias("node"), F.col("text").cast("string").alias("text")), "texts")
    links = materialise(verified(tried, texts, WORDS, LEAST), "links")

    def mixed() -> DataFrame:
        """The members of buckets that are not one component yet, with their roots."""
        found = components(links)
        rooted = members.join(found, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        out = materialise(rooted.join(several, "bucket", "left_semi"), "mixed")
        discard(found)
        return out

    def left(open_: DataFrame) -> float:
        each = open_.groupBy("bucket", "root").count().groupBy("bucket").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
        return each.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")).cast("double")), F.lit(0.0))).first()[0] / 2

    def compare(pairs: DataFrame) -> None:
        nonlocal tried, links
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried, links = tried.unionAll(pairs), links.unionAll(materialise(verified(pairs, texts, WORDS, LEAST), "links"))

    open_ = mixed()
    salt, before, rest = 0, float("inf"), left(open_)
    while rest > ROUNDS_WHILE * open_.count() and rest <= before / 2:
        pivot = open_.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.struct(F.xxhash64("node", F.lit(salt)), F.col("node"))).alias("p"))
        compare(open_.join(pivot, "bucket").filter("root <> p.root").select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct())
        discard(open_)
        open_ = mixed()
        salt, before, rest = salt + 1, rest, left(open_)
    rare = rare_pairs(open_.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root")), texts, WORDS, LEAST)
    compare(rare)
    discard(rare, open_, members, texts)
    named = classes.select("node", "doc_id", F.col("node").alias("row"))
    found = components(links)
    named = named.join(found, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("node"))
    kept = materialise(named.groupBy("node").agg(least.alias("first")).select(F.col("first.row").alias("row")), "kept")
    discard(found, classes, links, tried)
    return rows.join(kept, "row", "left_semi").select(*docs.columns)
