"""What reaches the driver or one task stays bounded when one id or one group holds most rows."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from wakeline.llm import common, components, near_copies, topk, toxicity


def test_the_fit_takes_one_row_of_a_labelled_id(spark, monkeypatch):
    rows = [(1, f"bad words number {i}") for i in range(3000)] + [(i, "fine text of a document") for i in range(2, 40)] + [(40 + i, f"bad bad words {i}") for i in range(20)]
    labels = [(1, 1, 1)] + [(i, 1, 0) for i in range(2, 40)] + [(40 + i, 1, 1) for i in range(20)] + [(2, 1, 0)]
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda cols, vals, size, *a, **k: (seen.append(len(size)), fit(cols, vals, size, *a, **k))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == [59]
    again = toxicity.train(docs.repartition(3, "text"), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"))
    assert again == model


def test_template_pages_are_compared_exactly(spark, monkeypatch):
    """Pages that share a template of two thirds of their words, and pairs at 0.8 among them: none is lost, and few pairs are compared."""
    rng, sent = random.Random(7), []
    frame = [f"t{i}" for i in range(160)]
    texts = [" ".join(frame + [f"u{k}-{i}" for i in range(80)]) for k in range(500)]
    near = {}
    for k in range(0, 40):
        words = texts[k].split()
        for i in rng.sample(range(8), 3):
            words[165 + 9 * i] = f"edit{k}-{i}"
        near[k] = len(texts)
        texts.append(" ".join(words))
    check = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: (sent.append(pairs.count()), check(pairs, *a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in near_copies.distinct_rows(docs).collect()}
    assert kept == set(range(500))
    assert sum(sent) < 20 * len(texts)


def test_lists_read_by_many_queries_at_once():
    """Bounds of all queries come from one product: the same answers, most candidates never resolved, no time a candidate."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(8192, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    rows[3000:3500] = rows[7]  # copies: more equals than places
    rows[40] = 0
    block, queries, own = topk.Block(rows, np.arange(8192) // 2 * 2), rows[:400], np.arange(400) // 2 * 2  # repeated ids
    start = time.process_time()
    q, ids, scores, read = block.search_all(queries, own, 5, np.full(400, -np.inf))
    assert time.process_time() - start < 8  # some 40 s one by one
    for i in (0, 1, 7, 40, 99, 399):
        want = sorted((-int(s), int(j)) for s, j in zip(rows @ queries[i], block.ids) if j != own[i])[:5]
        assert list(zip((-scores[q == i]).tolist(), ids[q == i].tolist())) == want
    assert np.median(read) < 0.9 * rows.size


def test_packing_of_the_pipeline_encodes_small_groups(monkeypatch):
    """Ids are those of large groups; no group holds more than the bytes asked for and one text."""
    from wakeline.llm import encode

    enc, seen = encode.encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    own = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda texts: seen.append(sum(len(x) for x in texts.to_pylist())) or own(texts))
    texts = pa.array([f"a small text, number {i}, of words" * (i % 7) for i in range(3_000)])
    assert enc.encode(texts, 1 << 16).equals(enc.encode(texts)) and max(seen[:-1]) < 1 << 17 < seen[-1]
    assert corpus_pipeline.PACKING_BYTES < encode.GROUP_BYTES


def test_tables_on_the_way_are_removed(spark, tmp_path, monkeypatch):
    """Near duplicates leave the rows and the numbers of those kept, components the roots and the edges that are left (none)."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    kinds = lambda: sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "wakeline").iterdir())
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(50, 50), (60, 50)}
    assert kinds() == ["edges", "roots"]
    texts = [" ".join(f"w{k}-{i}" for i in range(60)) for k in range(6)] + [" ".join([f"w0-{i}" for i in range(59)] + [f"x{k}"]) for k in range(20)]
    got = near_copies.distinct_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == list(range(6))
    assert set(kinds()) - {"edges", "roots"} == {"kept", "rows"}  # and the last, empty edges of each call
