"""Spans of matches in texts with very many of them."""

import re
import time

import pyspark.sql.functions as F

from wakeline.llm import native


def test_spans_of_many_matches(spark):
    pattern = r"[a-z]+[0-9]"
    texts = ["", "a1", "no match", "é a1 b2x c3", "x1" * 40, " ".join(f"ab{i % 10}" for i in range(5000))]
    kept, around = native.matches(F.col("text"), pattern)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(s) for s in r.spans] for r in df.select("i", native.lay_out(kept, around).alias("spans")).collect()}
    assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_two_hundred_thousand_matches_take_seconds(spark):
    n = 200_000
    df = spark.range(1).select(F.repeat(F.lit("ab1 "), n).alias("text"))
    kept, around = native.matches(F.col("text"), "[a-z]+[0-9]")
    began = time.time()
    r = df.select(F.size(s := native.lay_out(kept, around)), F.element_at(s, -1)["start"], F.element_at(s, -1)["end"]).first()
    assert tuple(r) == (n, 4 * n - 4, 4 * n - 1)
    assert time.time() - began < 60
