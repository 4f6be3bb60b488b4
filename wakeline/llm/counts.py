"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-tokens.

No piece of the vocabulary has a space mark after another character, a line break, or a letter beside
a punctuation mark, so no merge crosses these places and a text's count is the sum over the pre-tokens
between them (checked on the vocabulary when the model is loaded; texts with spaces in a row keep
each run together with what follows). The corpus' distinct pre-tokens are counted by one shuffle. The
frequent ones, at most FREQUENT of at most SHORT bytes, go to every task; what they leave of a
document's frequencies is joined by shuffle. Ids are never kept.

Null texts are empty (0 tokens); rows with null or repeated doc_ids each give a row; an empty table
gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import materialise, table

MARK = "▁"
PUNCTUATION = ".,;:!?#*%$&|"
FREQUENT = 1 << 19
SHORT = 32
GROUP_BYTES = 1 << 24
WORDS_A_CALL = 512
RUN = re.compile(" *[^ ]+| +")


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.opens = np.zeros(self.model.get_piece_size(), bool)
        self.opens[[i for i in range(len(self.opens)) if self.model.id_to_piece(i).startswith(MARK)]] = True
        def crosses(a: str, b: str) -> bool:
            return a.isalpha() and b in PUNCTUATION or a in PUNCTUATION and b.isalpha() or a != MARK and b == MARK or "\n" in (a, b)

        if any(crosses(a, b) for p in pieces for a, b in zip(p, p[1:])) or any(re.match(f"{MARK}{{2,}}[^{MARK}]", p) for p in pieces):
            raise ValueError("pieces of this vocabulary cross the pre-tokens")
        self.lead = len(self.model.encode("\n"))

    def count(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token: after a space if it opens with one, else as it is."""
        out = np.zeros(len(tokens), np.int64)
        plain = [i for i, t in enumerate(tokens) if t[:1] == " " and len(t) > 1 and not t[1:2].isspace() and len(t.split()) == 1 and not t[-1].isspace()]
        for at in range(0, len(plain), WORDS_A_CALL):
            group = plain[at : at + WORDS_A_CALL]
            ids = np.asarray(self.model.encode("".join([tokens[i] for i in group])[1:]))
            first = np.flatnonzero(self.opens[ids])
            out[group] = np.diff(first, append=len(ids))
        rest = np.setdiff1d(np.arange(len(tokens)), plain).tolist()
        for i, ids in zip(rest, self.model.encode(["\n" + tokens[i] for i in rest], num_threads=1) if rest else []):
            out[i] = len(ids) - self.lead
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the pre-token of each place, and the bounds of each text's places."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    runs = np.asarray(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")))
    even = pc.if_else(pa.array(runs), "", texts)
    split = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
    coded = split.flatten().dictionary_encode()
    chunks, code, bounds = coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.asarray(split.offsets)
    spaced = pc.if_else(pc.starts_with(chunks, "\n"), chunks, pc.binary_join_element_wise(" ", chunks, ""))
    core = pc.ascii_rtrim(spaced, characters=PUNCTUATION)
    cut = pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, 1))
    tail = pc.if_else(cut, pc.replace_substring_regex(spaced, rf"(?s)^.*?([{re.escape(PUNCTUATION)}]*)\z", r"\1"), "")
    both = pa.concat_arrays([pc.if_else(cut, core, spaced), tail]).dictionary_encode()
    names, at = both.dictionary, np.asarray(both.indices).astype(np.int64)
    places = np.stack([at[: len(chunks)][code], at[len(chunks) :][code]], 1).reshape(-1)
    bounds = bounds.astype(np.int64) * 2
    blank = np.asarray(pc.equal(names, ""))
    empty = np.repeat(np.asarray(pc.equal(even, "")), np.diff(bounds))  # an empty text has no pre-token
    keep = ~blank[places] & ~empty
    ends = np.concatenate([[0], np.cumsum(keep)])
    places, bounds = places[keep], ends[bounds]
    if runs.any():
        known = {t: i for i, t in enumerate(names.to_pylist())}
        extra, at, pieces, prior = [], [0], [], 0
        for i in range(len(texts)):
            own = places[bounds[i] : bounds[i + 1]]
            if runs[i]:
                own = np.array([known.setdefault(t, len(known)) for t in RUN.findall(" " + texts[i].as_py())], np.int64)
            pieces.append(own)
            at.append(at[-1] + len(own))
        names, places, bounds = pa.array(list(known), pa.string()), np.concatenate(pieces), np.array(at)
    return names, places, bounds


def slices(batches):
    """The batches in parts of bounded text."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), np.int64))
        cuts = np.unique(np.searchsorted(ends, np.arange(GROUP_BYTES, ends[-1] if len(ends) else 0, GROUP_BYTES)) + 1).tolist()
        yield from (b.slice(a, z - a) for a, z in zip([0, *cuts], [*cuts, b.num_rows]) if z > a)


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, freq over all documents, pieces."""

    def tally(batches):
        for b in slices(batches):
            names, places, _ = pretokens(b.column("text"))
            n = np.bincount(places, minlength=len(names))
            used = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([names.filter(used), pa.array(n[n > 0], pa.int64())], ["pretoken", "freq"])

    def measure(batches):
        for b in batches:
            yield b.append_column("pieces", pa.array(counter(path).count(b.column("pretoken").to_pylist())))

    tallied = docs.select(F.col("text").cast("string")).mapInArrow(tally, "pretoken string, freq long")
    return tallied.groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(measure, "pretoken string, freq long, pieces long")


def frequent(vocab: DataFrame, limit: int = FREQUENT) -> pa.Table:
    """The pre-tokens above the lowest frequency step with at most `limit` of them; limit * SHORT bytes at most."""
    short = vocab.filter(F.octet_length("pretoken") <= SHORT).withColumn("step", F.floor(16 * F.log2("freq")))
    total, cut = 0, math.inf
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r.step):  # some hundred steps
        total += r["count"]
        if total > limit:
            break
        cut = r.step
    return short.filter(F.col("step") >= cut).select("pretoken", "pieces").toArrow() if cut < math.inf else pa.table({"pretoken": pa.array([], pa.string()), "pieces": pa.array([], pa.int64())})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens per document."""
    vocab = materialise(vocabulary(docs, path), "pretokens")
    top = frequent(vocab).combine_chunks()
    names = top["pretoken"].combine_chunks() if top.num_rows else pa.array([], pa.string())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("pretoken", names.type), ("pieces", pa.int64())])) as w:
        w.write_table(pa.table({"pretoken": names, "pieces": top["pieces"]}))
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches):
        from pyspark import TaskContext

        known = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        values, pieces = known["pretoken"].combine_chunks() if known.num_rows else pa.array([], pa.string()), np.asarray(known["pieces"])
        key = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            names, places, bounds = pretokens(b.column("text"))
            at = np.asarray(pc.fill_null(pc.index_in(names, value_set=values.cast(names.type)), -1), np.int64)
            count = np.where(at >= 0, pieces[at] if len(pieces) else 0, 0)
            total = np.concatenate([[0], np.cumsum(count[places])])
            keys = key + np.arange(b.num_rows)
            key += b.num_rows
            owner = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            left = at[places] < 0
            pair, n = np.unique(owner[left] * len(names) + places[left], return_counts=True)
            none = pa.nulls(len(pair), pa.int64())
            marks = pa.array([f"\0{k}" for k in keys.tolist()], names.type)  # joins to nothing, spreads evenly
            base = [pa.array(keys), b.column("doc_id"), pc.fill_null(pc.binary_length(b.column("text")).cast(pa.int64()), 0), pa.array(total[bounds[1:]] - total[bounds[:-1]]), marks, pa.array(np.zeros(b.num_rows, np.int64))]
            rest = [pa.array(keys[pair // max(1, len(names))]), none, none, none, names.take(pa.array(pair % max(1, len(names)))), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(base, rest)], ["key", "doc_id", "n_bytes", "known", "pretoken", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "key long, doc_id long, n_bytes long, known long, pretoken string, n long")
    joined = rows.join(vocab.select("pretoken", "pieces"), "pretoken", "left")
    tokens = F.coalesce(F.col("known"), F.lit(0)) + F.col("n") * F.coalesce("pieces", F.lit(0))
    return joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens")).drop("key")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
