"""SimHash near-dedup: fingerprints of word shingles, joined by a binary trie self-join.

Two fingerprints of 64 bits within 4 bits of each other differ by at most 2 bits in one of their
halves. So there are two tries, over the fingerprint and over the fingerprint turned by 32 bits, and
in each a pair of nodes is pruned when its prefixes differ by more than 2 bits in the first half or
by more than 4 in all. The top of a trie is split until a node holds few fingerprints; the pairs of
such nodes that survive are the tasks, and inside a task the traversal goes on down to short slices.
A task skips slices that it has already connected and returns a spanning forest, not all pairs.

Null and empty texts have the fingerprint zero and link like any other; equal fingerprints link.
A null doc_id takes part and gets the smallest other id of its component (null if there is none).
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import materialise, table
from wakeline.llm.components import components
from wakeline.llm.counts import slices

SHINGLE_WORDS = 4
SEED = 42
BUDGET = 4
NODE_ROWS = 4096  # a node of the trie's top has as many fingerprints at most, or one in 8192 of all
SLICE_PAIRS = 4096
STEP_BITS = 6


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if over half of the shingles' hashes set it."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and just the six ASCII white space characters
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(size)
    starts, ends = (ends - size)[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def turned(fp: np.ndarray) -> np.ndarray:
    return fp << np.uint64(32) | fp >> np.uint64(32)


def differ(a: int, b: int, depth: int) -> bool:
    """Whether 64-bit keys that share these first `depth` bits must be over the budget."""
    x = (a ^ b) >> (64 - depth) if depth else 0
    half = x >> (depth - 32) if depth > 32 else x
    return half.bit_count() > BUDGET // 2 or x.bit_count() > BUDGET


def link(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning forest (positions in left, then right) of the links within sorted keys, or between two sorted lists."""
    keys = left if right is None else np.concatenate([left, right])
    parent, shift = np.arange(len(keys)), 0 if right is None else len(left)

    def roots(i: int, j: int) -> np.ndarray:
        r = parent[i:j]
        while True:
            up = parent[r]
            if (up == r).all():
                parent[i:j] = r
                return r
            r = up

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def prefix(i: int, j: int) -> int:
        return 64 - int(keys[i] ^ keys[j - 1]).bit_length()

    def cut(i: int, j: int, depth: int) -> int:
        top = int(keys[i]) >> (64 - depth) << (64 - depth) if depth else 0
        return i + int(np.searchsorted(keys[i:j], np.uint64(top | 1 << (63 - depth))))

    todo = [(0, shift or len(keys), shift, len(keys))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        same = a == c and b == d
        da, dc = prefix(a, b), prefix(c, d)
        if not same and differ(int(keys[a]), int(keys[c]), min(da, dc)):
            continue
        if (b - a) * (d - c) <= SLICE_PAIRS:
            ra, rc = roots(a, b), roots(c, d)
            if (ra == ra[0]).all() and (rc == ra[0]).all():
                continue
            near = np.bitwise_count(keys[a:b, None] ^ keys[None, c:d]) <= BUDGET
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                x, y = root(a + i), root(c + j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        elif same:
            m = cut(a, b, da)
            todo += [(a, m, m, b), (m, b, m, b), (a, m, a, m)]
        else:
            if b - a + d - c <= SLICE_PAIRS:
                ra = roots(a, b)
                if (ra == ra[0]).all() and (roots(c, d) == ra[0]).all():
                    continue
            if b - a >= d - c:
                m = cut(a, b, da)
                todo += [(m, b, c, d), (a, m, c, d)]
            else:
                m = cut(c, d, dc)
                todo += [(a, b, m, d), (a, b, c, m)]
    up = roots(0, len(keys))
    return [(int(i), int(up[i])) for i in np.flatnonzero(up != np.arange(len(keys)))]


def trie_top(keys: DataFrame, rows: int) -> list[tuple[int, int, int]]:
    """(trie, depth, prefix) of the nodes of at most `rows` keys whose parents hold more; there are some 2 n / rows."""
    leaves, heavy, depth = [], [(t, 0) for t in (0, 1)], 0
    while heavy:
        down = depth + STEP_BITS if depth + STEP_BITS <= 64 else 64
        part = keys.withColumn("up", F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long"))
        part = part.join(F.broadcast(keys.sparkSession.createDataFrame(heavy, "trie int, up long")), ["trie", "up"])
        counted = part.groupBy("trie", F.shiftrightunsigned("key", 64 - down).alias("prefix")).count().collect()  # 64 a heavy node at most
        counts = {(r.trie, down, r.prefix % (1 << 64)): r["count"] for r in counted}
        for d in range(down - 1, depth - 1, -1):
            for t, deeper, p in [k for k in counts if k[1] == d + 1]:
                counts[t, d, p >> 1] = counts.get((t, d, p >> 1), 0) + counts[t, deeper, p]
        heavy, walk = [], [(t, depth, p % (1 << 64)) for t, p in heavy]
        while walk:
            t, d, p = walk.pop()
            n = counts.get((t, d, p), 0)
            if n <= rows:
                if n:
                    leaves.append((t, d, p))
            elif d == down:
                heavy.append((t, p if p < 1 << 63 else p - (1 << 64)))
            else:
                walk += [(t, d + 1, 2 * p), (t, d + 1, 2 * p + 1)]
        depth = down
    return leaves


def node_pairs(leaves: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Positions of the pairs of nodes, each with itself included, that the error budget allows."""
    out = []
    for trie in (0, 1):
        own = sorted((p << (64 - d), d, i) for i, (t, d, p) in enumerate(leaves) if t == trie)
        starts = [x[0] for x in own]
        import bisect

        def split(lo: int, hi: int) -> int:
            """The first node in [lo, hi) with the bit set in which they first differ."""
            x = starts[lo] ^ starts[hi - 1]
            bit = x.bit_length() - 1
            return bisect.bisect_left(starts, starts[hi - 1] >> bit << bit, lo, hi)

        def depth(lo: int, hi: int) -> int:
            return own[lo][1] if hi - lo == 1 else 64 - (starts[lo] ^ starts[hi - 1]).bit_length()

        todo = [(0, len(own), 0, len(own))] if own else []
        while todo:
            a, b, c, d = todo.pop()
            if (a, b) != (c, d) and differ(starts[a], starts[c], min(depth(a, b), depth(c, d))):
                continue
            if b - a == d - c == 1:
                out.append((own[a][2], own[c][2]))
            elif (a, b) == (c, d):
                m = split(a, b)
                todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
            elif b - a >= d - c:
                m = split(a, b)
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = split(c, d)
                todo += [(a, b, c, m), (a, b, m, d)]
    return out


def near_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints `fp` (distinct) that connect all within the budget."""

    def both(batches):
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            key = np.concatenate([fp, turned(fp)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(fp)), pa.int32()), pa.array(key)], ["trie", "key"])

    keys = classes.select("fp").mapInArrow(both, "trie int, key long")
    n = classes.count()
    leaves = trie_top(keys, max(NODE_ROWS, n >> 13))
    pairs = node_pairs(leaves)
    tasks: list[list[tuple[int, int]]] = [[] for _ in leaves]
    for k, (u, v) in enumerate(pairs):
        tasks[u].append((k, 0))
        if v != u:
            tasks[v].append((k, 1))
    order = {t: sorted((p << (64 - d), i) for i, (x, d, p) in enumerate(leaves) if x == t) for t in (0, 1)}
    bounds = {t: np.array([s for s, _ in order[t]], np.uint64) for t in (0, 1)}
    ids = {t: np.array([i for _, i in order[t]], np.int64) for t in (0, 1)}
    sizes = np.array([len(x) for x in tasks], np.int64)
    flat = np.array([y for x in tasks for y in x], np.int64).reshape(-1, 2)
    shared = classes.sparkSession.sparkContext.broadcast((bounds, ids, np.append(0, np.cumsum(sizes)), flat))  # of the order of the surviving node pairs

    def deal(batches):
        bounds, ids, ends, flat = shared.value
        for b in batches:
            trie, key = np.asarray(b.column("trie")), np.asarray(b.column("key")).view(np.uint64)
            for t in (0, 1):
                own = np.sort(key[trie == t])
                if not len(own):
                    continue
                leaf = ids[t][np.searchsorted(bounds[t], own, "right") - 1]
                cuts = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
                for a, z in zip(cuts[:-1], cuts[1:]):
                    to = flat[ends[leaf[a]] : ends[leaf[a] + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(to[:, 0], z - a)), pa.array(np.repeat(to[:, 1], z - a), pa.int32()), pa.array(np.full(len(to) * (z - a), t), pa.int32()), pa.array(np.tile(own[a:z], len(to)).view(np.int64))], ["pair", "side", "trie", "key"]
                    )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        key, side = rows["key"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        left, right = np.sort(key[side == 0]), np.sort(key[side == 1])
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        found = np.array(link(left, right if len(right) else None), np.int64).reshape(-1, 2)
        fp = np.concatenate([left, right])
        fp = (turned(fp) if rows["trie"].iloc[0] else fp).view(np.int64)
        return pd.DataFrame({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    return keys.mapInArrow(deal, "pair long, side int, trie int, key long").groupBy("pair").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) per document."""
    prints = materialise(fingerprints(docs, words), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(near_links(classes))
    linked = classes.join(found, classes.fp == found.node).select("fp", "root", "first_id")
    first = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(first, "root").select("fp", "component_id")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(materialise(named, "named"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
