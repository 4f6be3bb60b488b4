"""N-gram Jaccard join by a partitioned universe: segments, one-deletion neighbourhoods, cost-based allocation, exact verification.

Documents are sets of distinct WORDS-word shingles (64-bit hashes); sets that are equal are one class, a node. Two
sets of n and l shingles are similar (PERCENT or more) only if at most H = (100 - PERCENT)(n + l) / (100 + PERCENT)
shingles lie in one of them alone. Sizes are cut into bands, and in a band the universe of shingles is hashed into
segments, as many as the largest H of the band and one more. A set is indexed in its own band and looks for
partners in the bands that its partners can lie in: a signature is the hash of what the set has in a segment; in
every WIDE-th segment also of that without any one shingle. If a set looks into segments with allocations v
(0: not, 1: equal contents, 2: contents that differ by one shingle at most) that sum to H + 1, then by the
pigeonhole principle it meets every similar set. The allocation is by cost: lists of a signature that nobody else
has are free, then the shortest lists come first, so lists that many unlike sets share (empty segments, common
passages) are left out. All counts cover all documents.

Lists are not expanded into pairs. While they are long, their members are compared with the most central one, as
many times as that halves what is left. Then the nodes of lists that are not connected yet are compared where they
share one of their rarest shingles (a prefix of each set, rare ones first), which all similar sets do. So a large group of
copies with edits of their own costs its size, whether they are similar or just not, and no link between components
is lost. Pairs are verified on the sets of the whole texts. Two different sets share a hash with probability n * n / 2^65.

A text of fewer words than WORDS is one shingle; null, empty and blank texts have none and are linked with nothing.
A null doc_id takes part and gets the smallest other id of its component (null if there is none). Repeated rows and
ids are rows of their own; an empty table gives none; a very long text costs its length. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from wakeline.llm.common import materialise, table
from wakeline.llm.components import components

WORDS = 4
PERCENT = 85
WIDE = 8
SEED = 42
BLOCK = 1 << 20  # bytes of text hashed at once, or one text
LARGEST = 1 << 29  # shingles; no text has more
BROADCAST_NODES = 1_000_000
ROUNDS_WHILE = 4  # lists are compared with a pivot while this many times their members is left to compare
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # odd, of no meaning


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the bounds of each text's words."""
    import xxhash

    clean = pc.ascii_lower(pc.fill_null(texts, ""))
    for c in "\t\n\v\f\r":  # with the space, just the six ASCII white space characters
        clean = pc.replace_substring(clean, c, " ")
    split = pc.split_pattern(clean, " ")
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    of = np.array([xxhash.xxh64_intdigest(w, SEED) for w in known], np.uint64)
    codes = np.asarray(coded.indices)
    word = codes != (known.index("") if "" in known else -1)
    return of[codes[word]], np.append(0, np.cumsum(word))[np.asarray(split.offsets) - split.offsets[0].as_py()]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    block = np.cumsum(size) // BLOCK
    cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(texts) else np.zeros(1, int)
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h, bounds = hashed_words(texts.slice(begin, end - begin))
        last = max(0, len(h) - words + 1)
        every = mixed(sum((h[k : last + k] * FACTORS[k] for k in range(words)), np.zeros(last, np.uint64)))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if z - a >= words:
                x = np.sort(every[a : z - words + 1])
                yield x[np.append(True, x[1:] != x[:-1])]
            elif z > a:
                yield mixed(np.array([(h[a:z] * FACTORS[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def budget(n: int, l: int) -> int:  # noqa: E741
    """How many shingles two similar sets of n and l may not share at most."""
    return (100 - PERCENT) * (n + l) // (100 + PERCENT)


def least_partner(n: int) -> int:
    return -(-PERCENT * n // 100)


def size_bands() -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) from the smallest size at which two different sets can be similar."""
    out, lo = [], next(n for n in range(1, LARGEST) if budget(n, n + 1) and (n * 100 >= PERCENT * (n + 1)))
    while lo <= LARGEST:
        hi = max(lo, lo * 100 // PERCENT)
        out.append((lo, hi, budget(hi, hi * 100 // PERCENT) + 1))
        lo = hi + 1
    return out


BANDS = size_bands()
LOWS = np.array([b[0] for b in BANDS])
# A place packs the size (29 bits), the band (8), the segment (24) and the kind (2).
EXACT, DELETED, LOOK = 0, 1, 2  # LOOK is added in bands other than the set's own, where it is not indexed


def band_of(n: int) -> int:
    return int(np.searchsorted(LOWS, n, "right")) - 1


def signatures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and places of a set, x sorted."""
    n, sigs, places = len(x), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    own = band_of(n)
    if own < 0:
        return sigs[0], places[0]
    parts = mixed(x ^ FACTORS[0])
    total = np.append(np.uint64(0), np.cumsum(parts))
    for band in range(max(0, band_of(least_partner(n))), own + 1):
        m = BANDS[band][2]
        segment = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # rises with x
        bounds = np.append(0, np.cumsum(np.bincount(segment, minlength=m)))
        sums = total[bounds[1:]] - total[bounds[:-1]]
        wide = segment % WIDE == 0
        less, of = sums[segment[wide]] - parts[wide], segment[wide]
        at = np.concatenate([np.arange(m), of])
        sigs.append(mixed(np.concatenate([sums, less]) + (at + (band << 24)).astype(np.uint64) * FACTORS[1]))
        kind = np.repeat([EXACT, DELETED], [m, len(of)]) + (0 if band == own else LOOK)
        places.append((n << 34) + (band << 26) + (at << 2) + kind)
    return np.concatenate(sigs), np.concatenate(places)


def whole(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, md5 of the text, n (shingles), node (hash of the set) for each row."""

    def run(batches):
        import xxhash

        for b in batches:
            sets = [(len(x), xxhash.xxh3_64_intdigest(x.tobytes())) for x in shingle_sets(b.column("text"))]
            node = np.array([h for _, h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("md5"), pa.array([n for n, _ in sets], pa.int64()), pa.array(node)], ["doc_id", "md5", "n", "node"])

    return docs.withColumn("md5", F.md5("text")).mapInArrow(run, "doc_id long, md5 string, n long, node long")


def signed(docs: DataFrame) -> DataFrame:
    """sig, node, place for each signature of each row; rows with equal sets give equal signatures."""

    def run(batches):
        import xxhash

        seen: set[int] = set()  # saves work on copies that lie near each other
        for b in batches:
            held, size = [], 0
            for x in shingle_sets(b.column("text")):
                node = xxhash.xxh3_64_intdigest(x.tobytes())
                if node in seen:
                    continue
                if len(seen) >= 1 << 16:
                    seen.clear()
                seen.add(node)
                sig, place = signatures(x)
                held.append((sig, np.full(len(sig), node, np.uint64), place))
                size += len(sig)
                if size >= 1 << 18:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    def rows(held):
        sig, node, place = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node.view(np.int64)), pa.array(place)], ["sig", "node", "place"])

    return docs.select("text").mapInArrow(run, "sig long, node long, place long")


def kind() -> Column:
    return F.col("place").bitwiseAND(F.lit(3))


def size() -> Column:
    return F.shiftright("place", 34)


def shared(sigs: DataFrame) -> DataFrame:
    """The signatures that more than one node has, with e and d: how many nodes are indexed under it as they are, and without one shingle."""
    one = Window.partitionBy("sig")
    several = sigs.withColumns({"_lo": F.min("node").over(one), "_hi": F.max("node").over(one)}).filter("_lo <> _hi")
    each = several.select("sig", "node", "place").distinct()
    count = lambda k: F.sum(F.when(kind() == k, 1).otherwise(0)).over(one)
    counted = each.withColumns({"e": count(EXACT), "d": count(DELETED), "x": count(EXACT + LOOK)})
    return counted.filter("e > 0 or (d > 0 and x > 0)").select("sig", "node", "place", "e", "d")


def allocated(live: DataFrame) -> DataFrame:
    """node, slot (size, band and segment), unit: the lookups that a set makes, unit 1 for equal contents and 2 for contents with one shingle more or less."""
    exact, own = kind() % 2 == EXACT, F.when(kind() == EXACT, 1).otherwise(0)
    slots = live.repartition("node").groupBy("node", F.shiftright("place", 2).alias("slot")).agg(
        F.coalesce(F.max(F.when(exact, F.col("e") - own)), F.lit(0)).alias("c1"),
        (F.coalesce(F.sum(F.when(~exact, F.col("e"))), F.lit(0)) + F.coalesce(F.max(F.when(exact, F.col("d"))), F.lit(0))).alias("c2"),
    )
    segment, band, n = F.col("slot").bitwiseAND(F.lit((1 << 24) - 1)), F.shiftright("slot", 24).bitwiseAND(F.lit(255)).cast("int"), F.shiftright("slot", 32)
    cost = F.greatest("c1", "c2")
    unit = lambda k, c: F.struct(F.lit(k).alias("unit"), c.alias("cost"))
    units = F.array_compact(F.array(F.when(F.col("c1") > 0, unit(1, F.col("c1"))), F.when((segment % WIDE == 0) & (cost > 0), unit(2, cost))))
    of = slots.select("node", "slot", band.alias("band"), n.alias("n"), F.explode(units).alias("u")).select("node", "slot", "band", "n", "u.*")
    known = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("band"))
    all_units = known(m + -(-m // WIDE) for _, _, m in BANDS)
    most = F.floor((100 - PERCENT) * (F.col("n") + F.least("n", known(hi for _, hi, _ in BANDS).cast("long"))) / (100 + PERCENT))
    one = Window.partitionBy("node", "band")
    free = all_units - F.count("*").over(one)
    return of.withColumns({"_need": most + 1 - free, "_rank": F.row_number().over(one.orderBy("cost", "unit", "slot"))}).filter("_rank <= _need").select("node", "slot", "unit")


def lists(live: DataFrame, chosen: DataFrame) -> DataFrame:
    """bucket, node, n, look: the lists that are looked into, with who looks (look = 1) and who is indexed there (0)."""
    slot = live.withColumn("slot", F.shiftright("place", 2))
    asked = slot.join(chosen, ["node", "slot"])
    exact = kind() % 2 == EXACT
    bucket = lambda where: F.xxhash64("sig", F.lit(where)).alias("bucket")
    looks = asked.filter(((F.col("unit") == 1) & exact) | ((F.col("unit") == 2) & ~exact)).select(bucket(EXACT), "node", size().alias("n"))
    looks = looks.unionAll(asked.filter((F.col("unit") == 2) & exact).select(bucket(DELETED), "node", size().alias("n"))).distinct()
    index = live.filter(kind() == EXACT).select(bucket(EXACT), "node", size().alias("n")).unionAll(live.filter(kind() == DELETED).select(bucket(DELETED), "node", size().alias("n")))
    index = index.join(looks.select("bucket").distinct(), "bucket", "left_semi")
    return looks.withColumn("look", F.lit(1)).unionAll(index.withColumn("look", F.lit(0)))


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; texts: node, text."""

    def run(batches):
        held: dict[int, tuple[str, np.ndarray]] = {}  # the text seen last on either side, as pivots come often

        def of(side: int, text: str) -> np.ndarray:
            if side not in held or held[side][0] != text:
                held[side] = text, next(shingle_sets(pa.array([text]), words))
            return held[side][1]

        for b in batches:
            keep = [similar(of(0, x), of(1, y), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rare_pairs(nodes: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, root) with different roots that can be similar by the order of their rarest shingles.

    With all shingles in one order, rare ones first, the first shingle that two similar sets share comes so early in
    both that enough are left behind it. Copies with edits of their own begin with shingles that nobody else has.
    """

    def run(batches):
        for b in batches:
            for node, x in zip(b.column("node").to_pylist(), shingle_sets(b.column("text"), words)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x.view(np.int64))], ["node", "shingle"])

    every = texts.join(nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, shingle long")
    common = every.withColumn("f", F.count("*").over(Window.partitionBy("shingle"))).filter("f > 1")  # a node's others come first, so their number is enough
    one = Window.partitionBy("node")
    ranked = common.withColumns({"r": F.row_number().over(one.orderBy("f", "shingle")), "held": F.count("*").over(one)}).join(nodes, "node")
    ranked = ranked.withColumn("at", F.col("n") - F.col("held") + F.col("r") - 1)
    n, other = F.col("n"), F.ceil(F.col("n") * percent / 100)
    shared_by = lambda a, b: F.ceil(percent * (a + b) / (100 + percent))
    looks = materialise(ranked.filter(F.col("at") <= n - shared_by(n, other)).select("shingle", "node", "n", "root", "at"), "prefixes")
    index = looks.filter(F.col("at") <= n - shared_by(n, n)).select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "at")))
    fits = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") > F.col("node2")))
    enough = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("n2") - F.col("at2") - 1) >= shared_by(F.col("n"), F.col("n2"))
    both = looks.join(index, (looks.shingle == index.shingle) & (F.col("root") != F.col("root2")) & fits & enough & (F.col("n2") * 100 >= F.col("n") * percent))
    return both.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect all similar nodes which meet in a list; members: bucket, node, n, look, weight."""
    pair = F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")
    near = F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * PERCENT
    held = materialise(members.withColumn("root", F.col("node")), "members")
    links = tried = None

    def verify(pairs):
        nonlocal links, tried, held
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        new = materialise(verified(pairs, texts), "links")
        tried, links = (pairs, new) if links is None else (tried.unionAll(pairs), links.unionAll(new))
        found = components(links)
        named = held.drop("root").join(found, "node", "left").select("bucket", "node", "n", "look", "weight", F.coalesce("root", "node").alias("root"))
        open_ = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        held = materialise(named.join(open_, "bucket", "left_semi"), "members")

    def left() -> int:
        """Pairs that lookups must compare and that are not connected yet."""
        each = held.groupBy("bucket", "root").agg(F.sum("look").alias("p"), F.sum(1 - F.col("look")).alias("i"))
        of = each.groupBy("bucket").agg((F.sum("p") * F.sum("i") - F.sum(F.col("p") * F.col("i"))).cast("double").alias("c"))
        return of.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]

    salt, before, rest = 0, float("inf"), left()
    while rest > ROUNDS_WHILE * held.count() and rest <= before / 2:
        order = F.struct("weight", "node") if not salt else F.struct(F.xxhash64("node", F.lit(salt)), F.col("node"))
        pivots = held.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "root"), order).alias("p"))
        verify(held.join(pivots, "bucket").filter((F.col("root") != F.col("p.root")) & near).select(*pair).distinct())
        salt, before, rest = salt + 1, rest, left()
    left_over = held.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    verify(rare_pairs(left_over, texts))
    return links


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    rows = whole(docs)
    every = materialise(nodes(rows), "nodes")
    live = materialise(shared(signed(rows)), "signatures")
    weight = live.filter(kind() == EXACT).groupBy("node").agg(F.sum("e").alias("weight"))
    members = lists(live, allocated(live)).join(weight, "node", "left").select("bucket", "node", "n", "look", F.coalesce("weight", F.lit(0)).alias("weight"))
    members = materialise(members, "lists")
    classes = every.filter("n > 0").groupBy("node").agg(F.min("md5").alias("md5"), F.min("doc_id").alias("first_id"))
    wanted = materialise(classes.join(members.select("node").distinct(), "node").select("node", "md5"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    texts = rows.withColumn("md5", F.md5("text")).join(wanted, "md5").groupBy("node").agg(F.first("text").alias("text"))
    found = components(linked(members, materialise(texts, "texts")))
    roots = classes.select("node", "first_id").join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(roots.join(least, "root").select("node", "component_id"), "named")
    some = every.filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionAll(every.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.r, s.g, n.n FROM s JOIN c USING (g) JOIN n USING (r)),
o AS (
  SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT x, y FROM o UNION ALL SELECT y, x FROM o),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN d ON reach.y = d.r GROUP BY x) m USING (r)
"""
