"""Byte-level BPE encoding of Arrow string arrays, one library call per distinct word.

A byte-level BPE pre-tokenizer starts a new pre-token at a single space or line break that has
text before it, and between letters and the punctuation that follows them. Texts are therefore
cut there, the distinct pieces of a batch go through the tokenizers library in long joined
strings, and the ids are gathered back by numpy. Texts in which the cut is not safe (three white
space characters in a row, two at the end, special strings) go through the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the pre-tokenizer's pattern knows it.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = rf"{SPACE}{{3}}|{SPACE}{{2}}\z"
PUNCTUATION = ".,;:!?#*%$&"
WORDS_A_CALL = 512
GROUP_BYTES = 1 << 23  # of text at once; a worker holds some ten times as much


def gather(pool: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries `codes` of a pool of entries of the given sizes, in a row, and where each begins and the last ends."""
    begins = np.cumsum(size) - size
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    kind = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((begins[codes] - ends[:-1]).astype(kind), n)
    at += np.arange(ends[-1], dtype=kind)
    return pool[at], ends


class Encoder:
    """encode(texts): the ids the library gives each text, little-endian unsigned 16-bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for piece, i in vocab.items() if piece.startswith("Ġ")]] = True
        self.newline = np.arange(1 << 16) == vocab["Ċ"]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row and their counts, each text by itself."""
        got = [np.asarray(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u2"), *got]), np.array([len(x) for x in got], np.int64)

    def _joined(self, words: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sep + word for words without white space, and their counts."""
        cuts = pa.array([*range(0, len(words), WORDS_A_CALL), len(words)], pa.int32())
        calls = pc.binary_join(pa.ListArray.from_arrays(cuts, words), sep)
        ids, _ = self._whole([sep + x for x in calls.to_pylist()])
        first = np.flatnonzero((self.opens if sep == " " else self.newline)[ids])
        return ids, np.diff(first, append=len(ids))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct chunks: those that open with a line break as they are, others after a space."""
        broken = np.asarray(pc.starts_with(chunks, "\n"))
        body = pc.if_else(pa.array(broken), pc.utf8_slice_codeunits(chunks, 1), chunks)
        core = pc.ascii_rtrim(body, characters=PUNCTUATION)
        cut = np.asarray(pc.utf8_is_alpha(core))
        core = pc.if_else(pa.array(cut), core, body)
        ends = pa.array(cut & np.asarray(pc.not_equal(core, body)))
        tail = pc.replace_substring_regex(body.filter(ends), rf"^.*?([{PUNCTUATION}]*)\z", r"\1")
        tail = pc.replace_with_mask(pa.array([""], body.type).take(pa.array(np.zeros(len(body), np.int32))), ends, tail).dictionary_encode()
        alone = np.asarray(pc.or_(pc.equal(core, ""), pc.match_substring_regex(core, SPACE)))
        kind = np.where(alone, 2, np.where(broken, 1, 0))
        pools, sizes, leaf, base = [], [], np.empty(len(chunks), np.int64), 0
        for k in range(3):
            rows = np.flatnonzero(kind == k)
            if k == 2:
                odd = [x if x[:1] == "\n" else " " + x for x in chunks.take(pa.array(rows)).to_pylist()]
                ids, n = self._whole(odd)
                leaf[rows] = base + np.arange(len(rows))
            else:
                words = core.take(pa.array(rows)).dictionary_encode()
                ids, n = self._joined(words.dictionary, "\n" if k else " ")
                leaf[rows] = base + np.asarray(words.indices)
            pools.append(ids)
            sizes.append(n)
            base += len(n)
        tails, tail_size = self._whole(tail.dictionary.to_pylist())
        tail_at = np.where(alone, -1, np.asarray(tail.indices))
        codes = np.stack([leaf, np.where(tail_at < 0, base + len(tail_size), base + tail_at)], 1).reshape(-1)
        ids, ends = gather(np.concatenate([*pools, tails]), np.concatenate([*sizes, tail_size, [0]]), codes)
        return ids, np.diff(ends[::2])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, offsets = split.flatten(), np.asarray(split.offsets)
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        codes[offsets[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        ids, n = self._chunks(coded.dictionary)
        heads, heads_n = self._whole(flat.take(pa.array(offsets[:-1])).to_pylist())
        ids, ends = gather(np.concatenate([ids, heads]), np.concatenate([n, heads_n]), codes)
        return ids, ends[offsets]

    def encode(self, texts: pa.Array, group_bytes: int = GROUP_BYTES) -> pa.Array:
        """Large binary ids of each text (null: none); `group_bytes` of text at once, fewer take less memory and more time."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, UNSAFE)
        for s in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        fast = texts.filter(pc.invert(whole))
        ends = np.cumsum(np.asarray(pc.binary_length(fast), np.int64))
        cuts = np.unique(np.searchsorted(ends, np.arange(group_bytes, ends[-1] if len(ends) else 0, group_bytes)) + 1).tolist()
        got = []
        for a, b in zip([0, *cuts], [*cuts, len(fast)]):
            if b > a:
                ids, at = self._encode(fast.slice(a, b - a))
                got.append(id_arrays(ids, at))
        out = pa.concat_arrays(got) if got else pa.array([], pa.large_binary())
        if len(fast) < len(texts):
            slow = np.asarray(whole)
            ids, n = self._whole(texts.filter(whole).to_pylist())
            order = np.empty(len(texts), np.int64)
            order[np.flatnonzero(~slow)], order[np.flatnonzero(slow)] = np.arange(len(fast)), np.arange(len(n)) + len(fast)
            out = pa.concat_arrays([out, id_arrays(ids, np.concatenate([[0], np.cumsum(n)]))]).take(pa.array(order))
        return out


def id_arrays(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Large binary values from ids in a row and their bounds."""
    at = np.asarray(at, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(2 * at), pa.py_buffer(np.ascontiguousarray(ids))])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
