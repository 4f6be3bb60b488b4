"""Periodic runs against a plain search of every stretch, whole and dealt out by lags; nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from wakeline.llm import periodic

SCHEMA = "doc_id long, text string, hash string, parts int, runs string, start long, n_runs string"


def plain_runs(words):
    """Every stretch that its smallest period fits three times, 24 words or more, and that cannot be extended."""
    out, n = [], len(words)
    for i in range(n):
        for j in range(i + 24, n + 1):
            q = next(p for p in range(1, j - i + 1) if all(words[x] == words[x + p] for x in range(i, j - p)))
            if j - i < 3 * q or (i and words[i - 1] == words[i - 1 + q]) or (j < n and words[j] == words[j - q]):
                continue
            out.append((i, j - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def sample():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a b " * 12, "x " + "a b c " * 8 + "y", "é ü " * 20, "A a " * 13, "w w " * 30]
    for _ in range(40):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(20, 40))]
        block = [rng.choice("abcd") for _ in range(rng.randint(1, 9))] * rng.randint(2, 9)
        texts.append(rng.choice([" ", "\n", "  "]).join(words[:10] + block + words[10:]))
    return [(i, t) for i, t in enumerate(texts)] + [(3, "a " * 30), (3, "a " * 30), (None, "b c " * 20), (None, None)]


@pytest.mark.parametrize("most", [periodic.RANGE, 40])
def test_runs_match_a_plain_search(spark, monkeypatch, most):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "h", 7, "r", 1, "n") for i, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(periodic, "table", lambda *_: docs)
    find = periodic.find
    monkeypatch.setattr(periodic, "find", lambda d: find(d, most))
    got = sorted(map(repr, (tuple(r) for r in periodic.op12_periodic_runs(spark, "").collect())))
    assert got == sorted(repr(digest(*r)) for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert find(empty, most).collect() == []


def test_lag_ranges_go_to_many_tasks(spark):
    text = " ".join(f"w{i % 700}" for i in range(4000))
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, text + " end")], "doc_id long, text string")
    got = {(r.doc_id, tuple(map(tuple, r.runs)), len(r.collapsed.split())) for r in periodic.find(docs, 100_000).collect()}
    assert got == {(1, ((0, 4000, 700),), 700), (2, ((0, 4000, 700),), 701)}
    assert periodic.find(docs, 100_000).count() == 4


def test_long_texts_are_scanned_whole():
    words = [str(i).encode() for i in range(30_000)]
    assert not len(periodic.runs_of([words])[0])
    far = words[:3000] + words[20_000:29_000] * 3
    assert [r.tolist() for r in periodic.runs_of([far, [b"a"] * 30, words])] == [[[3000, 27_000, 9000]], [[0, 30, 1]], []]


def test_a_smaller_period_of_the_same_stretch_wins():
    found = periodic.runs_of([b"a b a b a b".split() * 20])[0]
    assert found.tolist() == [[0, 120, 2]]
    assert periodic.collapse(b"x a b a b y".split(), [(1, 4, 2)]) == b"x a b y"
