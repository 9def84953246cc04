"""Token counts and ids with a public byte-level BPE vocabulary, by chunks that repeat.

No pre-token runs from a non-space into white space, so a text can be cut there and its chunks encoded
one by one. All chunks of a slice of texts are found and hashed with array operations; each distinct
one is encoded once, and the ids of the slice are gathered from those.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext

from .common import binaries
from .textarrays import U, buffers, hashes_between, mix, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokeniser of that vocabulary (public pattern of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts that share one set of distinct chunks.
TOGETHER = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(2)
def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    import tiktoken

    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=_ranks(vocabulary), special_tokens={}).encode_ordinary


@lru_cache(2)
def _token_bytes(vocabulary: str) -> np.ndarray:
    ranks = _ranks(vocabulary)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return sizes


def _after_wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space beyond ASCII."""
    a, b, c = raw[np.maximum(at - 3, 0)], raw[np.maximum(at - 2, 0)], raw[at - 1]
    wide = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return wide | (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, and at ASCII white space after a character that is no white space."""
    space = _SPACE[raw]
    begin = np.zeros(len(raw), bool)
    begin[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(begin)
    at = at[raw[at - 1] >= 0x80]
    begin[at[_after_wide_space(raw, at)]] = False
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begin)


def _encoded_each(raw: np.ndarray, start: np.ndarray, end: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks, one after the other, and their bounds. Chunks that begin with white space and
    end with none are encoded as one string, in which no pre-token runs from one into the next."""
    encode = encoder(vocabulary)
    safe = _SPACE[raw[start]] & ~_SPACE[raw[end - 1]] & ~_after_wide_space(raw, end)
    s, size = start[safe], (end - start)[safe]
    ends = np.cumsum(size)
    text = raw[np.repeat(s - (ends - size), size) + np.arange(size.sum())].tobytes().decode()
    ids = np.array(encode(text), np.uint16)
    counts = np.empty(len(start), np.int64)
    counts[safe] = np.diff(np.searchsorted(np.cumsum(_token_bytes(vocabulary)[ids]), ends, "right"), prepend=0)
    rest = np.flatnonzero(~safe)
    others = [np.array(encode(raw[start[k] : end[k]].tobytes().decode()), np.uint16) for k in rest]
    counts[rest] = [len(x) for x in others]
    order = np.argsort(np.concatenate((np.repeat(np.flatnonzero(safe), counts[safe]), np.repeat(rest, counts[rest]))), kind="stable")
    return np.concatenate((ids, *others))[order], np.concatenate(([0], np.cumsum(counts)))


def _chunked(texts: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct chunks of a slice of texts and their bounds, the number of each chunk, and
    the chunks before each text (n + 1). Chunks are told apart by 64 bits of their bytes and length."""
    raw, offsets = buffers(texts)
    start = chunk_starts(raw, offsets)
    end = np.append(start[1:], len(raw)) if len(start) else start
    code, distinct = pd.factorize(mix(hashes_between(raw, start, end) + (end - start).astype(U)))
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    ids, bounds = _encoded_each(raw, start[first], end[first], vocabulary)
    return ids, bounds, code, np.searchsorted(start, offsets)


def token_counts(texts: pa.Array, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The number of tokens of each text (0 for nulls)."""
    _, bounds, code, chunks = _chunked(texts, vocabulary)
    return np.diff(np.concatenate(([0], np.cumsum(np.diff(bounds)[code])))[chunks])


def token_ids(texts: pa.Array, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts as 16-bit numbers (vocabularies of at most 65,536 tokens), and their bounds by text."""
    ids, bounds, code, chunks = _chunked(texts, vocabulary)
    size = np.diff(bounds)[code]
    ends = np.concatenate(([0], np.cumsum(size)))
    return ids[np.repeat(bounds[:-1][code] - ends[:-1], size) + np.arange(ends[-1])], ends[chunks]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    return int(token_counts(pa.array([text], pa.string()), vocabulary)[0])


def counted(vocabulary: str):
    """(doc_id, text) -> (doc_id, row, n_tokens); ``row`` is a number of its own for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                part = batch.slice(a, b - a)
                rows = np.arange(row, row := row + b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows), pa.array(token_counts(part.column(1), vocabulary))], ["doc_id", "row", "n_tokens"])

    return run


def encoded(vocabulary: str):
    """(doc_id, text) -> (doc_id, row, ids); null texts have null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                part = batch.slice(a, b - a)
                ids = binaries(*token_ids(part.column(1), vocabulary))
                if part.column(1).null_count:
                    ids = pa.compute.if_else(part.column(1).is_valid(), ids, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(row, row := row + b - a)), ids], ["doc_id", "row", "ids"])

    return run
