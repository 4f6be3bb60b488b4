"""The n-gram Jaccard join against all pairs: bands, empty segments, hot groups, chains, passages; nulls, short texts, repeats."""

import random
import re

import duckdb
import numpy as np
import pytest

from wakeline.llm import jaccard

SCHEMA = "doc_id long, text string, node long, n long, sig long, md5 string, root long"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    first = {}
    for i, (doc, _) in enumerate(rows):
        first.setdefault(top(i), []).extend([doc] if doc is not None else [])
    return sorted(((doc, len(sets[i]), min(first[top(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(i, f"x{rng.random()}"), lambda: words.insert(i, f"y{rng.random()}"), lambda: words.pop(i)])()
    return " ".join(words)


def sample(rng, n):
    rows = [None, "", "  \n", "one", "ONE", "one two three", "a b c d", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i", "same " * 50, "same " * 90, "É é e"]
    for size in (8, 10, 12, 20, 45, 90, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        rows += [" ".join(base)] * 3 + [edited(rng, base, max(1, int(size * rng.choice([0.01, 0.02, 0.03, 0.05])))) for _ in range(n)]
    chain = [f"c{i}" for i in range(300)]
    for i in range(12):  # each like the next only
        rows.append(" ".join(chain))
        chain = chain[12:] + [f"c{i}-{k}" for k in range(12)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"q{rng.random()}" for _ in range(40)) for _ in range(2 * n)]
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[20]), (None, None), (4, rows[30]), (4, rows[60]), (4, rows[60])]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = sample(rng, 6)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "m", 4) for i, t in rows], SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in jaccard.joined(docs).collect()), key=repr) == plain(rows)


def test_empty_table_and_lonely_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.joined(docs).collect() == []
    docs = spark.createDataFrame([(7, "a text that is like no other", 1, 2, 3, "m", 4)], SCHEMA)
    assert [tuple(r) for r in jaccard.joined(docs).collect()] == [(7, 4, 7)]


def test_a_hot_group_is_not_expanded(spark, monkeypatch):
    """300 copies with single edits, each like the original only by chance: the pairs verified grow with the group, not with its square."""
    rng, sent = random.Random(3), []
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 2) if i else " ".join(base)) for i in range(300)]
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, texts: (sent.append(pairs.count()), verified(pairs, texts))[1])
    got = {tuple(r) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r[2] for r in got} == {0} and len(got) == 300
    assert sum(sent) < 5 * 300


def test_copies_just_not_similar_are_not_expanded(spark, monkeypatch):
    """400 copies with three edits of their own lie under the bound from the original and far from each other."""
    rng, sent = random.Random(4), []
    base = [f"w{i}" for i in range(150)]

    def three(k):
        words = list(base)
        for i in (10 + 40 * j + rng.randrange(30) for j in range(3)):
            words[i] = f"x{k}-{i}"
        return " ".join(words)

    rows = [(0, " ".join(base))] + [(k, three(k)) for k in range(1, 400)]
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, texts: (sent.append(pairs.count()), verified(pairs, texts))[1])
    got = sorted((tuple(r) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == plain(rows) and len({r[2] for r in got}) == 400
    assert sum(sent) < 10 * 400  # of 79,800


def test_words_as_bytes_split_them():
    import pyarrow as pa

    texts = ["a\tb\nc\vd\x0ce\rf  g", " ", None, "\u00a0x\u3000y É", "\x1cq \x85", "no", ""]
    h, bounds = jaccard.hashed_words(pa.array(texts))
    assert np.diff(bounds).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(h) == bounds[-1] and len({*h.tolist()}) == len({w for t in texts for w in (t or "").encode().lower().split()})


def test_every_similar_pair_shares_an_allocated_segment():
    """The pigeonhole on sets of all sizes: contents that differ in no or one shingle in more units than the budget leaves out."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(6, 900))
        x = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2))
        lost = int(rng.integers(0, max(1, n // 12) + 1))
        y = np.unique(np.append(x[rng.permutation(len(x))[lost:]], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1)), np.int64).astype(np.uint64)))
        if not jaccard.similar(x, y):
            continue
        big, small = (x, y) if len(x) >= len(y) else (y, x)
        band = jaccard.band_of(len(small))
        if band < 0:
            assert np.array_equal(x, y)
            continue
        assert len(np.setxor1d(x, y)) <= jaccard.budget(len(x), len(y)) < jaccard.BANDS[band][2]
        tables = []
        for s in (big, small):
            sig, place = jaccard.signatures(s)
            mine = (place >> 26 & 255) == band
            tables.append({k: set(sig[mine & (place % 2 == k)].tolist()) for k in (0, 1)})
        a, b = tables
        assert len(a[0]) == len(b[0]) == jaccard.BANDS[band][2]
        equal = len(a[0] & b[0])
        assert equal >= jaccard.BANDS[band][2] - jaccard.budget(len(x), len(y)) and equal


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    names = [x[0] for x in con.execute(jaccard.ORACLE).description]
    df = jaccard.op11_jaccard_join(spark, d)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(con.execute(jaccard.ORACLE).fetchall())


def test_only_shingles_that_several_nodes_have_are_sorted_by_node(spark, monkeypatch):
    rng, looks = random.Random(5), []
    texts = [[f"w{g}_{rng.randrange(400)}" for _ in range(80)] for g in range(3) for _ in range(2)]
    texts += [[*t[:k], "edit", *t[k + 1 :]] for t in texts[:4] for k in (0, 30, 79)]
    sets = [shingles(" ".join(t)) for t in texts]
    nodes = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node long, n long, root long")
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: looks.append(df) or df)
    found = {(r.a, r.b) for r in jaccard.rare_pairs(nodes, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= 85 * len(a | b)}
    assert want and want <= found
    plan = looks[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("row_number()") < re.search(r"Filter \(+f#\d+L > 1", plan).start()  # printed from the top: the sort by node reads what the filter leaves
