"""Operator 10, token output: static range asymmetric numeral system (rANS) over token ids.

One frequency table, counted over the whole corpus, serves all blocks. A block interleaves LANES
64-bit states in one stream of 32-bit words: token i belongs to lane i mod LANES. Each block
stands alone, has checkpoints from which its stretches of EVERY steps are decoded in parallel, and
checksums of its stream and of its tokens. All blocks of a batch are coded at once with array
operations, and all stretches of a batch's blocks are decoded at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written
from .tokens import VOCABULARY, encoded

#: Bits of the frequencies' sum; states stay in [LOW, LOW << 32).
BITS, LOW = 18, 1 << 31
LANES, STEPS, EVERY = 64, 1024, 256
BLOCK = LANES * STEPS
#: Blocks coded at once by a task.
TOGETHER = 64
U = np.uint64

SCHEMA = (
    "kind string, block bigint, n_tokens int, stream binary, states binary, checkpoints binary, token_crc bigint, stream_crc bigint, "
    "doc_ids array<bigint>, rows array<bigint>, starts array<bigint>, lengths array<int>"
)
_ARROW = pa.schema(
    [("kind", pa.string()), ("block", pa.int64()), ("n_tokens", pa.int32()), ("stream", pa.binary()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("token_crc", pa.int64()),
     ("stream_crc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
)


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each token that occurs."""
    counts = np.asarray(counts, np.float64)
    some, total = counts > 0, 1 << bits
    if not some.any():
        return np.zeros(len(counts), np.int64)
    spare = total - int(some.sum())
    if spare < 0:
        raise ValueError("more distinct tokens than the table can hold")
    exact = counts / counts.sum() * spare
    freq = np.floor(exact).astype(np.int64) + some
    # the largest remainders get what rounding left over
    left = total - int(freq.sum())
    order = np.lexsort((np.arange(len(counts)), -np.where(some, exact - np.floor(exact), -1)))
    freq[order[:left]] += 1
    return freq


class Table:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.freq = bits, freq.astype(U)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)


def encode_blocks(blocks: np.ndarray, t: Table) -> list[tuple[bytes, bytes, bytes]]:
    """Stream, first states and checkpoints of each block. ``blocks``: shape (blocks, steps, LANES)."""
    count, steps, lanes = blocks.shape
    x = np.full((count, lanes), LOW, U)
    words, out = np.empty((steps, count, lanes), np.uint32), np.empty((steps, count, lanes), bool)
    marks = []
    shift, low = U(t.bits), U(32)
    for step in range(steps - 1, -1, -1):
        symbol = blocks[:, step]
        freq = t.freq[symbol]
        full = x >= (freq << U(31 - t.bits + 32))
        words[step], out[step] = x, full  # the low 32 bits
        x = np.where(full, x >> low, x)
        quotient = x // freq
        x = (quotient << shift) + (x - quotient * freq) + t.start[symbol]
        if step % EVERY == 0 and step:
            marks.append((step, x.copy()))
    per_step = out.sum(2)
    done = []
    for b in range(count):
        mask = out[:, b]
        ends = np.concatenate(([0], np.cumsum(per_step[:, b])))
        checks = b"".join(np.array([step, ends[step]], np.uint32).tobytes() + state[b].tobytes() for step, state in reversed(marks))
        done.append((words[:, b][mask].tobytes(), x[b].tobytes(), checks))
    return done


def decode_block(n_tokens: int, stream: bytes, states: bytes, t: Table, step: int = 0, word: int = 0, steps: int | None = None) -> np.ndarray:
    """Tokens of a block from its first states, or from a checkpoint's step, word and states."""
    x, words = np.frombuffer(states, U).copy(), np.frombuffer(stream, np.uint32)
    end = -(-n_tokens // LANES) if steps is None else step + steps
    found = np.empty((end - step, LANES), np.uint16)
    mask, shift = U((1 << t.bits) - 1), U(t.bits)
    for k in range(end - step):
        slot = x & mask
        symbol = t.symbol[slot]
        found[k] = symbol
        x = t.freq[symbol] * (x >> shift) + slot - t.start[symbol]
        need = np.flatnonzero(x < U(LOW))
        x[need] = (x[need] << U(32)) | words[word : word + len(need)]
        word += len(need)
    return found.ravel()[: max(0, n_tokens - step * LANES)]


def checkpoints(data: bytes) -> list[tuple[int, int, bytes]]:
    """(step, word, states) of each checkpoint."""
    size = 8 + LANES * 8
    return [(*np.frombuffer(data[i : i + 8], np.uint32).tolist(), data[i + 8 : i + size]) for i in range(0, len(data), size)]


def decode_blocks(blocks: list[tuple[int, bytes, bytes, bytes]], t: Table) -> list[np.ndarray]:
    """Tokens of blocks (n_tokens, stream, states, checkpoints). All stretches between checkpoints, of all
    blocks, take their steps together."""
    begins, states, words, at, owner = [], [], [], 0, []
    steps = np.array([-(-n // LANES) for n, *_ in blocks], np.int64)
    for k, (_, stream, first, checks) in enumerate(blocks):
        marks = [(0, 0, first), *checkpoints(checks)] if steps[k] else []
        begins += [(m[0], at + m[1]) for m in marks]
        states += [m[2] for m in marks]
        owner += [k] * len(marks)
        words.append(np.frombuffer(stream, np.uint32))
        at += len(words[-1])
    if not begins:
        return [np.zeros(0, np.uint16) for _ in blocks]
    x, words = np.frombuffer(b"".join(states), U).reshape(-1, LANES).copy(), np.append(np.concatenate(words), np.uint32(0))
    step, word = np.array(begins, np.int64).T
    owner = np.array(owner)
    # a stretch ends where the next of its block begins
    stop = np.where(np.append(owner[1:] == owner[:-1], False), np.append(step[1:], 0), steps[owner])
    last = int((stop - step).max())
    found = np.empty((len(step), last, LANES), np.uint16)
    mask, shift = U((1 << t.bits) - 1), U(t.bits)
    for k in range(last):
        slot = x & mask
        symbol = t.symbol[slot]
        found[:, k] = symbol
        x = t.freq[symbol] * (x >> shift) + slot - t.start[symbol]
        need = (x < U(LOW)) & (k < stop - step)[:, None]
        place = word[:, None] + np.cumsum(need, 1) - 1
        x[need] = (x[need] << U(32)) | words[place[need]]
        word = word + need.sum(1)
    out = []
    for k, (n, *_) in enumerate(blocks):
        mine = np.flatnonzero(owner == k)
        out.append(np.concatenate([found[i, : stop[i] - step[i]].ravel() for i in mine] or [np.zeros(0, np.uint16)])[:n])
    return out


def _coded(freq: np.ndarray):
    def code(held: list, t: Table, number: int) -> pa.RecordBatch:
        """``held``: (segments, tokens) of blocks, numbered from ``number``; those with fewer steps come last."""
        coded = []
        pad = int(np.argmax(t.freq))
        for steps in sorted({-(-len(x) // LANES) for _, x in held}, reverse=True):
            same = [x for _, x in held if -(-len(x) // LANES) == steps]
            blocks = np.full((len(same), steps * LANES), pad, np.uint16)
            for row, x in zip(blocks, same):
                row[: len(x)] = x
            coded += encode_blocks(blocks.reshape(len(same), steps, LANES), t)
        held = sorted(held, key=lambda h: -(-len(h[1]) // LANES), reverse=True)
        rows = [
            ("block", number + k, len(x), stream, states, checks, zlib.crc32(x.tobytes()), zlib.crc32(stream), *map(list, zip(*seg)))
            for k, ((seg, x), (stream, states, checks)) in enumerate(zip(held, coded))
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(freq)
        held, segments, tokens, size, number = [], [], [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = ids.as_py()
                values = np.frombuffer(ids or b"", np.uint16)
                if ids is None or not len(values):
                    segments.append((doc, key, 0, -1 if ids is None else 0))
                at = 0
                while at < len(values):
                    part = values[at : at + BLOCK - size]
                    segments.append((doc, key, at, len(part)))
                    tokens.append(part)
                    at, size = at + len(part), size + len(part)
                    if size == BLOCK:
                        held.append((segments, np.concatenate(tokens)))
                        segments, tokens, size = [], [], 0
                        if len(held) == TOGETHER:
                            yield code(held, t, number)
                            held, number = [], number + len(held)
        if segments:
            held.append((segments, np.concatenate(tokens) if tokens else np.zeros(0, np.uint16)))
        if held:
            yield code(held, t, number)

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(65536, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            ids = b"".join(x for x in batch.column(0).slice(at, 500).to_pylist() if x is not None)
            counts += np.bincount(np.frombuffer(ids, np.uint16), minlength=65536)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["token", "n"])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token ids of all texts as rANS blocks (SCHEMA), preceded by a row of kind 'table'.

    Texts are tokenised once; ids are written, counted over the whole corpus, and coded. The table
    (kind 'table': ``stream`` has the frequencies as 32-bit numbers) has a row for each vocabulary
    id at most, whatever the corpus. ``block`` is each block's own number. A block lists the pieces it
    holds in order: doc_ids, rows (a number of each row of ``docs``, so that the pieces of a text
    can be told from those of others with its doc_id, or none), starts (in tokens of the text) and
    lengths. Empty texts are pieces of length 0, null texts of length -1; null doc_ids stay null;
    repeated rows are pieces each, with rows of their own; very long texts run over several blocks;
    of equal remainders, the smaller id's frequency is rounded up. An empty table gives only the row
    of kind 'table'. Other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    ids = written(docs.mapInArrow(encoded(vocabulary), "doc_id bigint, row bigint, ids binary"), "token-ids")
    counted = ids.select("ids").mapInArrow(_histogram, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.token for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r.token] = r.n
    freq = quantised(counts)
    head = spark.createDataFrame([("table", None, 0, freq.astype(np.uint32).tobytes(), None, None, None, zlib.crc32(freq.astype(np.uint32).tobytes()), [], [], [], [])], SCHEMA)
    return head.unionByName(ids.mapInArrow(_coded(freq), SCHEMA))


PIECES = "doc_id bigint, row bigint, start bigint, ids array<int>"


def decode(blocks: DataFrame) -> DataFrame:
    """Pieces of ``encode``'s result, in parallel by block and, within each, from all its checkpoints at
    once: doc_id, row, start, ids. Null texts have null ids. Raises on a wrong checksum."""
    head = blocks.where("kind = 'table'").select("stream", "stream_crc").first()
    if zlib.crc32(head.stream) != head.stream_crc:
        raise ValueError("the frequency table is damaged")
    freq = np.frombuffer(head.stream, np.uint32).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(freq)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                if any(zlib.crc32(r["stream"]) != r["stream_crc"] for r in rows):
                    raise ValueError("a block's stream is damaged")
                for r, tokens in zip(rows, decode_blocks([(r["n_tokens"], r["stream"], r["states"], r["checkpoints"]) for r in rows], t)):
                    if zlib.crc32(tokens.tobytes()) != r["token_crc"]:
                        raise ValueError("a block's tokens are damaged")
                    lengths = np.array(r["lengths"], np.int64)
                    ends = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0)))).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.astype(np.int32)))
                    ids = pa.compute.if_else(pa.array(lengths >= 0), ids, pa.scalar(None, ids.type))
                    yield pa.RecordBatch.from_arrays([*(pa.array(r[c], pa.int64()) for c in ("doc_ids", "rows", "starts")), ids], ["doc_id", "row", "start", "ids"])

    return blocks.where("kind = 'block'").mapInArrow(run, PIECES)


def decoded_texts(blocks: DataFrame) -> DataFrame:
    """The token ids of each row of ``docs``, put together: doc_id, row, ids."""
    pieces = decode(blocks).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return pieces.select("doc_id", "row", F.when(F.expr("exists(p, x -> x.ids is not null)"), F.flatten("p.ids")).alias("ids"))


def op10_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
