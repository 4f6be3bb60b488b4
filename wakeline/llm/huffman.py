"""Token-id output: canonical length-limited Huffman coding of ids from global counts.

The file format is a folder of two Parquet tables that need nothing else to be decoded.
`codes`: one row with the format's version, the tokenizer's file name, and the code length of each token,
which fixes the canonical code. `documents`: a row is one document: doc_id, part and local_start (its
place in ascending doc_id order), n_tokens, and independent blocks of at most BLOCK ids, each with its
payload bytes and, every STEP ids, a checkpoint: the bit at which that id's code begins. A block is
decoded from the code lengths alone; all stretches between checkpoints are decoded side by side.

Null texts are empty, null doc_ids come first, repeated doc_ids are kept and ordered by content (their
range is cut by content too, so that an id with a third of the rows spreads over many tasks), an empty
table gives no documents. Very long texts are cut into blocks. Only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window

from wakeline.llm.common import materialise, table, table_path
from wakeline.llm.encode import encoder, id_arrays

MAX_BITS = 16
BLOCK = 1 << 16
STEP = 256
GROUP_TOKENS = 1 << 20  # coded or decoded at once, or one document
VERSION = 1
CODES = "version int, tokenizer string, tokens array<int>, lengths array<int>"


def id_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id and the ids of its whole text with `end_id` appended, as little-endian unsigned 16-bit values."""

    def run(batches):
        enc, end = encoder(path), np.uint16(end_id)
        for b in batches:
            ids = enc.encode(b.column("text"))
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8) // 2 if len(ids) else np.zeros(1, np.int64)
            flat = np.frombuffer(ids.buffers()[2], "<u2")[at[0] : at[-1]] if len(ids) and ids.buffers()[2] else np.empty(0, "<u2")
            flat = np.insert(flat, at[1:] - at[0], end)
            out = id_arrays(flat, at - at[0] + np.arange(len(at))).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def flat_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column in a row and the bounds of each value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, "<u2"), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 2
    data = column.buffers()[2]
    return (np.frombuffer(data, "<u2", data.size // 2) if data else np.empty(0, "<u2"))[at[0] : at[-1]], at - at[0]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_counts(ids: DataFrame) -> DataFrame:
    """token, n over the whole table; a task emits each token once."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(flat_ids(b.column("ids"))[0], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["token", "n"])

    return ids.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def code_lengths(weights: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive weights (package-merge)."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(weights, kind="stable")
    coins = np.asarray(weights, np.int64)[order]
    packages, is_coin = np.empty(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([coins, packages])
        rank = np.argsort(both, kind="stable")
        is_coin.append(rank < n)
        both = both[rank]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_coin):
        used = int(level[:take].sum())
        length[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """The canonical code of {token: length}: shorter codes first, then smaller tokens."""

    def __init__(self, lengths: dict[int, int]):
        self.length, self.code = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        self.entry = np.zeros(1 << MAX_BITS, np.uint32)  # by the next MAX_BITS bits: the token and, above it, its length
        at = 0
        for size, token in sorted((v, k) for k, v in lengths.items()):
            width = 1 << (MAX_BITS - size)
            self.length[token], self.code[token] = size, at << (48 - MAX_BITS)  # left-aligned in 48 bits
            self.entry[at : at + width] = size << 16 | token
            at += width

    def encode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Payload of byte-aligned blocks that begin at `starts`, their byte bounds, each id's bit in the payload."""
        size = self.length[ids]
        ends = np.cumsum(size)
        count = np.diff(starts, append=len(ids))
        first = (ends - size)[starts]
        n_bytes = (np.append(first[1:], ends[-1]) - first + 7) // 8
        bounds = np.concatenate([[0], np.cumsum(n_bytes)])
        at = ends - size
        at += np.repeat(8 * bounds[:-1] - first, count)
        word = at >> 5
        value = self.code[ids] >> (at & 31).view(np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(word[-1] + 2, np.uint64)
        out[word[heads]] = np.bitwise_or.reduceat(value >> np.uint64(16), heads)
        out[word[heads] + 1] |= np.bitwise_or.reduceat((value & np.uint64(0xFFFF)) << np.uint64(16), heads)
        return out.astype(">u4").tobytes()[: bounds[-1]], bounds, at

    def decode(self, payload: np.ndarray, bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids of stretches of `count` ids that begin at `bit`, in a row; all stretches advance together."""
        b = np.concatenate([payload, np.zeros(3, np.uint8)]).astype(np.uint32)
        window = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        order = np.argsort(-count, kind="stable")
        at = bit[order].astype(np.uint32 if 8 * len(payload) < 1 << 31 else np.int64)
        place = (np.cumsum(count) - count)[order]
        out = np.empty(count.sum(), np.uint16)
        steps = int(count.max()) if len(count) else 0
        for i, k in enumerate(np.searchsorted(-count[order], -np.arange(steps)).tolist()):  # k stretches have more than i ids
            p = at[:k]
            seen = self.entry[window[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF]
            out[place[:k] + i] = seen.astype(np.uint16)
            p += (seen >> 16).astype(at.dtype)
        return out


BLOCKS = pa.list_(pa.struct([("n_ids", pa.int32()), ("checkpoints", pa.list_(pa.int32())), ("payload", pa.binary())]))
ROW = "doc_id long, part int, local_start long, n_tokens long, blocks array<struct<n_ids:int,checkpoints:array<int>,payload:binary>>"


def write(ids: DataFrame, lengths: dict[int, int], path: str, tokenizer: str = "") -> None:
    """Writes an id_table in ascending doc_id order, and its codes."""

    def run(batches):
        from pyspark import TaskContext

        code, part, local = Code(lengths), TaskContext.get().partitionId(), 0
        for b in batches:
            flat, bounds = flat_ids(b.column("ids"))
            n = np.diff(bounds)
            cuts = np.unique(np.searchsorted(bounds, np.arange(0, bounds[-1], GROUP_TOKENS))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(n)]):
                if hi == lo:
                    continue
                ids, size = flat[bounds[lo] : bounds[hi]], n[lo:hi]
                per = -(-size // BLOCK)
                doc = np.repeat(np.arange(hi - lo), per)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                starts = (bounds[lo:hi] - bounds[lo])[doc] + k * BLOCK
                count = np.minimum(size[doc] - k * BLOCK, BLOCK)
                payload, at, bits = code.encode(ids, starts)
                marks_n = -(-count // STEP)
                j = np.arange(marks_n.sum()) - np.repeat(np.cumsum(marks_n) - marks_n, marks_n)
                marks = bits[np.repeat(starts, marks_n) + j * STEP] - np.repeat(8 * at[:-1], marks_n)
                blocks = pa.StructArray.from_arrays(
                    [
                        pa.array(count, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(marks_n)]), pa.int32()), pa.array(marks, pa.int32())),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(payload)]).cast(pa.binary()),
                    ],
                    fields=list(BLOCKS.value_type),
                )
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), blocks).cast(BLOCKS)
                begin = local + np.cumsum(size) - size
                local += int(size.sum())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int32()), pa.array(begin), pa.array(size), listed], ["doc_id", "part", "local_start", "n_tokens", "blocks"])

    spark = ids.sparkSession
    codes = spark.createDataFrame([(VERSION, os.path.basename(tokenizer), list(lengths), list(lengths.values()))], CODES)
    codes.coalesce(1).write.parquet(f"{path}/codes")
    keyed = ids.withColumn("sum", F.crc32("ids"))
    ordered = keyed.repartitionByRange("doc_id", "sum").sortWithinPartitions("doc_id", "sum").drop("sum")
    ordered.mapInArrow(run, ROW).write.option("compression", "none").parquet(f"{path}/documents")


def code_table(spark: SparkSession, path: str) -> dict[int, int]:
    """The code length of each token, as written beside the documents."""
    codes = spark.read.schema(CODES).parquet(f"{path}/codes").first()
    if codes.version != VERSION:
        raise ValueError(f"format version {codes.version} of {path} is not {VERSION}")
    return dict(zip(codes.tokens, codes.lengths))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens and the decoded ids of files that write() made."""
    lengths = code_table(spark, path)

    def groups(b):
        ends = np.cumsum(np.asarray(b.column("n_tokens")))
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, GROUP_TOKENS), "right")).tolist()
        return [b.slice(lo, hi - lo) for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]) if hi > lo]

    def run(batches):
        code = Code(lengths)
        for b in (part for whole in batches for part in groups(whole)):
            blocks = b.column("blocks")
            per = np.diff(np.asarray(blocks.offsets))
            flat = blocks.flatten()
            n, marks, payload = (flat.field(i) for i in range(3))
            payload = payload.cast(pa.large_binary())
            size = np.asarray(n, np.int64)
            at = np.frombuffer(payload.buffers()[1], np.int64, len(payload) + 1, payload.offset * 8) if len(payload) else np.zeros(1, np.int64)
            data = np.frombuffer(payload.buffers()[2], np.uint8)[at[0] : at[-1]] if len(payload) else np.empty(0, np.uint8)
            marks_n = np.diff(np.asarray(marks.offsets)).astype(np.int64)
            bit = np.asarray(marks.flatten(), np.int64) + 8 * np.repeat(at[:-1] - at[0], marks_n)
            j = np.arange(len(bit)) - np.repeat(np.cumsum(marks_n) - marks_n, marks_n)
            ids = code.decode(data, bit, np.minimum(np.repeat(size, marks_n) - j * STEP, STEP))
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per)])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")] + [id_arrays(ids, ends).cast(pa.binary())], ["doc_id", "part", "local_start", "n_tokens", "ids"])

    return spark.read.schema(ROW).parquet(f"{path}/documents").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids binary")


def write_corpus(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Encodes whole texts and writes them with their code, which has one length per vocabulary entry at most."""
    ids = materialise(id_table(docs, tokenizer, end_id), "ids")
    counts = [(r.token, r.n) for r in token_counts(ids).collect()]  # bounded by the vocabulary
    lengths = code_lengths(np.array([n for _, n in counts], np.int64))
    lengths = {t: int(size) for (t, _), size in zip(counts, lengths)}
    write(ids, lengths, path, tokenizer)


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "huffman")
    write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)

    def digest(batches):
        for b in batches:
            flat, at = flat_ids(b.column("ids"))
            sums = [crc(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    decoded = read(spark, path).mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    totals = spark.read.schema(ROW).parquet(f"{path}/documents").groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return decoded.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
