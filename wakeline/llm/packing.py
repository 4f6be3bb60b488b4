"""Packing: vector bin packing under limits on tokens, segments and loss-bearing tokens.

An example is cut into full sequences from its front; what is left of it is a piece. Pieces are
dealt at random into groups of bounded size, and each group is packed bin by bin: of the pieces
that fit, the one with the largest dot product of its demand with the bin's free capacity (both as
shares of the limits) goes in next. When none fits, the largest piece is cut to fill the bin.

A null text is empty (one end id), an empty table gives no rows, repeated rows are packed each for
itself (groups are dealt by the number of the written piece, so equal rows do not meet in one), a null
prompt_tokens counts as 0. A very long text is cut like any other. Only doc_id, text and, if named, the prompt column are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import materialise, table
from wakeline.llm.encode import GROUP_BYTES, encoder, id_arrays
from wakeline.llm.huffman import crc

MAX_TOKENS = 1024
MAX_SEGMENTS = 128
MIN_CUT = 4  # a gap of fewer tokens is padded
GROUP_PIECES = 4096
BATCH = 4096  # documents a worker holds as ids
PIECE = "row long, doc_id long, start long, length int, doc_tokens long, prompt long, ids binary, ids_crc32 long, full_id long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int, max_loss: int, end_id: int, prompt: str | None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces of every example; `row` numbers them, full_id those that make a sequence by themselves."""

    def run(batches):
        from pyspark import TaskContext

        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        full = row
        for b in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            prompts = b.column("prompt").to_pylist()
            rows = {k: [] for k in ("row", "doc_id", "start", "length", "doc_tokens", "prompt", "ids", "ids_crc32", "full_id")}
            for doc, raw, given in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"), group_bytes).to_pylist(), prompts):
                ids = np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id))
                for at in range(0, len(ids), max_tokens):
                    part = ids[at : at + max_tokens]
                    whole = len(part) == max_tokens and max(0, at + max_tokens - max(at, given)) <= max_loss
                    full += whole
                    row += 1
                    for k, v in zip(rows, (row, doc, at, len(part), len(ids), given, part.tobytes(), crc(part), full if whole else None)):
                        rows[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    given = F.coalesce(F.col(prompt).cast("long"), F.lit(0)) if prompt else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), given.alias("prompt")).mapInArrow(run, PIECE)


def place(length: np.ndarray, loss_from: np.ndarray, limits: tuple[int, int, int], min_cut: int = MIN_CUT) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, tokens, bin, offset) for pieces whose tokens from `loss_from` on bear loss."""
    top, segments, max_loss = limits
    at, size = np.zeros(len(length), np.int64), np.asarray(length, np.int64).copy()
    loss = np.maximum(0, size - loss_from)
    stacks: dict[tuple[int, int], list[int]] = {}
    for i in range(len(size)):
        stacks.setdefault((int(size[i]), int(loss[i])), []).append(i)
    kinds = sorted(stacks)
    index = {k: n for n, k in enumerate(kinds)}
    demand = np.array(kinds, np.int64).reshape(-1, 2)
    alive = np.array([len(stacks[k]) for k in kinds], np.int64)
    left, out, bin_id = len(size), [], 0

    def put(i: int) -> None:
        nonlocal demand, alive
        k = (int(size[i]), int(loss[i]))
        if k not in index:
            index[k], stacks[k] = len(demand), []
            demand, alive = np.vstack([demand, [k]]), np.append(alive, 0)
        stacks[k].append(i)
        alive[index[k]] += 1

    def take(n: int) -> int:
        alive[n] -= 1
        return stacks[(int(demand[n, 0]), int(demand[n, 1]))].pop()

    while left:
        free = np.array([top, segments, max_loss], np.int64)
        while left and free[1] and free[0]:
            fits = (alive > 0) & (demand[:, 0] <= free[0]) & (demand[:, 1] <= free[2])
            if fits.any():
                score = demand[:, 0] * (free[0] / top**2) + free[1] / segments**2 + demand[:, 1] * (free[2] / max_loss**2)
                i = take(int(np.argmax(np.where(fits, score, -1))))
                n = int(size[i])
            else:
                n = int(np.argmax(np.where(alive > 0, demand[:, 0], -1)))
                prefix = max(0, int(demand[n, 0] - demand[n, 1]))  # tokens before the first loss
                n_cut = min(int(free[0]), int(demand[n, 0]) - 1, prefix + int(free[2]))
                if n_cut < min(min_cut, top):
                    break
                i = take(n)
                n = n_cut
            bears = max(0, n - max(0, int(size[i] - loss[i])))
            out.append((i, int(at[i]), n, bin_id, int(top - free[0])))
            free -= (n, 1, bears)
            at[i], size[i], loss[i] = at[i] + n, size[i] - n, loss[i] - bears
            if size[i]:
                put(i)
            else:
                left -= 1
        bin_id += 1
    return out


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = 0, prompt: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every id of every example in exactly one piece of exactly one sequence; `prompt` names a column with each example's loss-free leading tokens."""
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    cut = materialise(pieces(docs, tokenizer, max_tokens, limits[2], end_id, prompt, group_bytes), "pieces")
    groups = max(1, -(-cut.filter("full_id is null").count() // GROUP_PIECES))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row").reset_index(drop=True)
        length, start = rows["length"].to_numpy(), rows["start"].to_numpy()
        loss_from = np.clip(rows["prompt"].to_numpy() - start, 0, length)
        got = pd.DataFrame(place(length, loss_from, limits), columns=["i", "from", "length", "bin", "offset"])
        ids = [np.frombuffer(x, "<u2") for x in rows["ids"]]
        parts = [ids[i][a : a + n] for i, a, n in zip(got["i"], got["from"], got["length"])]
        of = rows.iloc[got["i"]].reset_index(drop=True)
        bears = np.clip(got["from"] + got["length"] - np.maximum(got["from"], loss_from[got["i"]]), 0, got["length"])
        return pd.DataFrame({
            "doc_id": of["doc_id"], "start": of["start"] + got["from"], "length": got["length"], "ids_crc32": [crc(p) for p in parts], "doc_tokens": of["doc_tokens"],
            "sequence_id": 2 * (key[0] * GROUP_PIECES * 4096 + got["bin"]) + 1, "offset": got["offset"], "loss_tokens": bears, "ids": [p.tobytes() for p in parts],
        })

    rest = cut.filter("full_id is null").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = rest.groupBy("bucket").applyInPandas(run, PACKED)
    loss = F.greatest(F.lit(0), F.least(F.col("length"), F.col("start") + F.col("length") - F.col("prompt"))).cast("long")
    full = cut.filter("full_id is not null").select("doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", (2 * F.col("full_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), loss.alias("loss_tokens"), "ids")
    return full.unionByName(packed)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids", "loss_tokens")
