"""Benchmark decontamination: rare n-gram seeds with a count that loses nothing, then Smith-Waterman alignment.

The score of a passage is its best local alignment with a test item, word by word, as a share of the
item's alignment with itself. The n-grams are neighbouring word pairs; a document has a pair's words next to
each other or with one word between. In an alignment of score t or more over an item of n words, a changed or
missing word breaks two pairs and costs 3 points of 2 a word, two or more words put in break one pair and cost
2; so min((4 t - 1) / 3, t) n - 1 pairs stay (a third of the words, less one, for t = 0.5; of three words also
the outer two are a pair), on diagonals at most 2 n (1 - t) apart.

A first pass counts the pairs in all documents. If `need` of an item's pairs must stay, at least HITS of its
rarest (all - need + HITS) must; those are its seeds, rare by what the join costs: occurrences in the
documents times places in items. Only seeds join documents to items, so what is frequent joins nothing, and
no passage is lost whatever the frequencies. Stretches with HITS seeds near one diagonal are checked for
`need` pairs and aligned, so that only the score decides.

Items go to the tasks in blocks of ITEMS, so what is sent has a bound; two passes over the documents are
made for each block. A task joins at most JOINED rows at a time.

Null or empty texts and items of fewer than LEAST_WORDS words match nothing. Repeated items and
documents give a row each per different (doc_id, item_id). Null doc_ids and item_ids are matched and
returned as null. An empty table on either side gives no rows. Very long texts are read whole. Only doc_id,
item_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import table
from wakeline.llm.counts import slices
from wakeline.llm.toxicity import words

LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
ITEMS = 20_000
HITS = 3
JOINED = 1 << 20
CELLS = 1 << 20  # words of the windows aligned at once


class Items:
    """The word pairs of a block of items, and what an alignment of score `least` keeps of them; `choose` makes the rare ones its seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None], least: float = LEAST_SCORE):
        known, codes, bounds = words(pa.array(texts, pa.string()))
        real = np.asarray(pc.not_equal(known, ""))
        self.ids, self.vocabulary = ids, known
        self.words = [c[real[c]] for c in (codes[i:j].astype(np.int64) for i, j in zip(bounds[:-1], bounds[1:]))]
        self.base = len(known) + 1
        pairs = [(g, i, p) for i, w in enumerate(self.words) if len(w) >= LEAST_WORDS for apart in ((1, 2) if len(w) == 3 else (1,)) for p, g in enumerate(self.pairs(w, apart).tolist())]
        flat = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair, start = np.unique(flat[:, 0], return_index=True)
        self.first = np.append(start, len(flat))  # places of pair k: first[k] .. first[k + 1]
        self.item, self.place = flat[:, 1], flat[:, 2]
        n = [len(w) for w in self.words]
        self.need = np.array([max(1, math.ceil(min((4 * least - 1) / 3, least) * x - 1 - 1e-9)) for x in n], np.int64)
        self.band = np.array([math.ceil(2 * x * (1 - least)) for x in n], np.int64)
        self.hits = np.minimum(self.need, HITS)

    def choose(self, frequency: np.ndarray) -> None:
        """Keeps of each item the rarest of its pairs, `all - need + hits` of them, as seeds."""
        n_places = np.diff(self.first)
        pair = np.repeat(np.arange(len(self.pair)), n_places)
        cost = ((frequency + 1) * n_places)[pair]
        order = np.lexsort((pair, cost, self.item))
        item = self.item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        every = np.bincount(self.item, minlength=len(self.need))
        seeds = np.sort(order[rank < (every - self.need + self.hits)[item]])
        kept, start = np.unique(pair[seeds], return_index=True)
        self.pair, self.first, self.item, self.place = self.pair[kept], np.append(start, len(seeds)), self.item[seeds], self.place[seeds]

    def holds(self, item: int, window: np.ndarray) -> bool:
        """Whether a window has as many of an item's pairs as its alignment must."""
        w = self.words[item]
        own = np.concatenate([self.pairs(w, apart) for apart in ((1, 2) if len(w) == 3 else (1,))])
        return np.isin(own, np.concatenate([self.pairs(window, 1), self.pairs(window, 2)])).sum() >= self.need[item]

    def pairs(self, w: np.ndarray, apart: int) -> np.ndarray:
        """Codes of the pairs of each word and the one `apart` places on; -1 where a word is unknown."""
        a, b = w[:-apart], w[apart:]
        return np.where((a >= 0) & (b >= 0), a * self.base + b, -1)


def align(item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of an item with each window, all windows at once."""
    width = max(map(len, windows))
    text = np.full((len(windows), width), -2, np.int64)
    for i, w in enumerate(windows):
        text[i, : len(w)] = w
    before, best = np.zeros((len(windows), width + 1), np.int32), np.zeros(len(windows), np.int32)
    slide = -GAP * np.arange(width + 1, dtype=np.int32)
    for word in item.tolist():
        step = before[:, :-1] + np.where(text == word, MATCH, MISMATCH).astype(np.int32)
        now = np.zeros_like(before)
        now[:, 1:] = np.maximum(np.maximum(step, before[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slide, axis=1) - slide
        best = np.maximum(best, now.max(1))
        before = now
    return best


def coded(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row, as the items know them (-1: unknown), and the text of each."""
    known, codes, bounds = words(texts)
    ids = np.asarray(pc.fill_null(pc.index_in(known, value_set=items.vocabulary.cast(known.type)), -1), np.int64)
    real = ~np.asarray(pc.equal(known, ""))[codes]
    return ids[codes][real], np.repeat(np.arange(len(texts)), np.diff(bounds))[real]


def held_pairs(w: np.ndarray, owner: np.ndarray, items: Items, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The items' pairs that the texts hold, and where."""
    pair = items.pairs(w, apart)
    if not len(items.pair) or not len(pair):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.minimum(np.searchsorted(items.pair, pair), len(items.pair) - 1)
    at = np.flatnonzero((pair >= 0) & (items.pair[k] == pair) & (owner[:-apart] == owner[apart:]))
    return k[at], at


def pair_frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each pair of the items stands in all documents; as many numbers as the block has pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items = shared.value
        total = np.zeros(len(items.pair), np.int64)
        for b in slices(batches):
            w, owner = coded(b.column("text"), items)
            total += np.bincount(held_pairs(w, owner, items, 1)[0], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.pair), np.int64)
    out[counted["k"].to_numpy()] = counted["n"].to_numpy()
    return out


def stretches(k: np.ndarray, at: np.ndarray, owner: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, first and last diagonal) where enough of an item's seeds stand near one diagonal."""
    n = items.first[k + 1] - items.first[k]
    entry = np.repeat(items.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, doc, diagonal = items.item[entry], owner[np.repeat(at, n)], np.repeat(at, n) - items.place[entry]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    i = np.arange(len(doc))
    j = i + items.hits[item] - 1
    z = np.minimum(j, len(doc) - 1)
    held = (j < len(doc)) & (doc[z] == doc) & (item[z] == item) & (diagonal[z] - diagonal <= items.band[item])
    i, j = i[held], j[held]
    inside = np.cumsum(np.bincount(i, minlength=len(doc) + 1) - np.bincount(j + 1, minlength=len(doc) + 1))[:-1] > 0
    doc, item, diagonal = doc[inside], item[inside], diagonal[inside]
    new = (np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(diagonal, prepend=0) > items.band[item])
    cuts = np.append(np.flatnonzero(new), len(doc)).tolist()
    return [(int(doc[i]), int(item[i]), int(diagonal[i]), int(diagonal[j - 1])) for i, j in zip(cuts[:-1], cuts[1:])]


def passages(docs: DataFrame, items: Items) -> DataFrame:
    """Candidates (doc_id, item, window): the stretches that hold as many of an item's pairs as its alignment must."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items = shared.value
        for b in slices(batches):
            w, owner = coded(b.column("text"), items)
            hits = [held_pairs(w, owner, items, apart) for apart in (1, 2)]
            k, at = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
            order = np.argsort(at, kind="stable")
            k, at = k[order], at[order]
            size = np.cumsum(items.first[k + 1] - items.first[k])
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            rows, lo = [], 0
            while lo < len(k):  # whole texts, JOINED rows or one text at a time
                hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + JOINED, "right"))
                if hi < len(k):
                    hi = max(int(np.searchsorted(at, ends[owner[at[hi]]])), lo)
                    hi = hi if hi > lo else int(np.searchsorted(at, ends[owner[at[lo]] + 1]))
                for doc, m, first, last in stretches(k[lo:hi], at[lo:hi], owner, items):
                    window = w[max(ends[doc], first - items.band[m]) : min(ends[doc + 1], last + len(items.words[m]) + items.band[m])]
                    if items.holds(m, window):
                        rows.append((doc, m, window))
                lo = hi
            where = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(where), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["doc_id", "item", "window"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, item int, window array<int>")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score for passages that score `least` or more; the best passage of each pair."""
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates()
    parts = max(1, -(-named.count() // ITEMS))
    named = named.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    out = None
    for part in range(parts):
        own = sorted(((r.item_id, r.text) for r in named.filter(F.col("part") == part).collect()), key=str)  # ITEMS or so
        items = Items([i for i, _ in own], [t for _, t in own], least)
        items.choose(pair_frequencies(docs, items))
        shared = spark.sparkContext.broadcast((items.ids, items.words))

        def score(batches, shared=shared):
            ids, texts = shared.value
            for b in batches:
                item, windows = b.column("item").to_pylist(), b.column("window").to_pylist()
                by: dict[int, dict[tuple, list[int]]] = {}
                for r, (i, w) in enumerate(zip(item, windows)):
                    by.setdefault(i, {}).setdefault(tuple(w), []).append(r)
                got = np.zeros(len(item))
                for i, own in by.items():
                    keys = sorted(own, key=len, reverse=True)
                    while keys:
                        n = max(1, min(256, CELLS // len(keys[0])))
                        few, keys = keys[:n], keys[n:]
                        for w, s in zip(few, align(texts[i], [np.array(x, np.int64) for x in few]).tolist()):
                            got[own[w]] = s / (MATCH * len(texts[i]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([ids[i] for i in item], pa.int64()), pa.array(got)], ["doc_id", "item_id", "score"])

        scored = passages(docs, items).mapInArrow(score, "doc_id long, item_id long, score double").filter(F.col("score") >= least)
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
