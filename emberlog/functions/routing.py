"""Which shard owns a host. The rule is the same for producers, stores and look-ups."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import import_here

_MASK = (1 << 64) - 1


def siphash13(data: bytes) -> int:
    """SipHash with one compression and three finalisation rounds, key 0."""
    v = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]

    def rotated(x: int, by: int) -> int:
        return ((x << by) | (x >> (64 - by))) & _MASK

    def rounds(count: int) -> None:
        a, b, c, d = v
        for _ in range(count):
            a, c = (a + b) & _MASK, (c + d) & _MASK
            b, d = rotated(b, 13) ^ a, rotated(d, 16) ^ c
            a = rotated(a, 32)
            c, a = (c + b) & _MASK, (a + d) & _MASK
            b, d = rotated(b, 17) ^ c, rotated(d, 21) ^ a
            c = rotated(c, 32)
        v[:] = a, b, c, d

    padded = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
    for i in range(0, len(padded), 8):
        word = int.from_bytes(padded[i : i + 8], "little")
        v[3] ^= word
        rounds(1)
        v[0] ^= word
    v[2] ^= 255
    rounds(3)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def siphash13_all(texts: pa.Array) -> np.ndarray:
    """SipHash-1-3, key 0, of the UTF-8 bytes of each text and 0xFF: all texts take each step together."""
    data = [(t + b"\xff") for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(t) for t in data], np.int64)
    # the last word holds what is left of the bytes, and their number
    words = sizes // 8 + 1
    rows = np.zeros((len(data), int(words.max(initial=1)) * 8), np.uint8)
    for row, t in zip(rows, data):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    if len(data):
        rows[np.arange(len(data)), words * 8 - 1] = sizes & 255
    table = rows.view("<u8")
    u = np.uint64
    v = [np.full(len(data), x, u) for x in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]

    def rotated(x: np.ndarray, by: int) -> np.ndarray:
        return (x << u(by)) | (x >> u(64 - by))

    def step(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        a, c = a + b, c + d
        b, d = rotated(b, 13) ^ a, rotated(d, 16) ^ c
        a = rotated(a, 32)
        c, a = c + b, a + d
        b, d = rotated(b, 17) ^ c, rotated(d, 21) ^ a
        return [a, b, rotated(c, 32), d]

    for k in range(table.shape[1]):
        on, word = k < words, table[:, k]
        a, b, c, d = step(v[0], v[1], v[2], v[3] ^ word)
        v = [np.where(on, new, old) for new, old in zip((a ^ word, b, c, d), v)]
    v[2] = v[2] ^ u(255)
    for _ in range(3):
        v = step(*v)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


class Md5Router:
    """The default: expressed in built-in functions, so any SQL engine can check it."""

    name = "md5"

    def shard(self, host: str, shards: int) -> int:
        return int(hashlib.md5(host.encode()).hexdigest()[:8], 16) % shards if shards > 1 else 0

    def column(self, host: Column, shards: int) -> Column:
        if shards <= 1:
            return F.lit(0)
        return (F.conv(F.substring(F.md5(host), 1, 8), 16, 10).cast("bigint") % shards).cast("int")

    def routed(self, df: DataFrame, shards: int) -> DataFrame:
        return df.withColumn("shard", self.column(F.col("host_id"), shards))


class SipRouter:
    """The layout of existing topics: SipHash-1-3 of the host's bytes and 0xFF. Only the host goes to
    Python, in Arrow batches, whose distinct hosts are hashed at once; no join, no shuffle, and rows
    without a host keep none."""

    name = "sip13"

    def shard(self, host: str, shards: int) -> int:
        return siphash13(host.encode() + b"\xff") % shards if shards > 1 else 0

    def column(self, host: Column, shards: int) -> Column:
        if shards <= 1:
            return F.lit(0)

        @F.arrow_udf("int")
        def owner(hosts: pa.Array) -> pa.Array:
            coded = hosts.dictionary_encode()
            shard = (siphash13_all(coded.dictionary) % np.uint64(shards)).astype(np.int32)
            return pa.array(shard).take(coded.indices)

        return owner(host)

    def routed(self, df: DataFrame, shards: int) -> DataFrame:
        import_here(df.sparkSession)
        return df.withColumn("shard", self.column(F.col("host_id"), shards))


ROUTERS = {r.name: r for r in (Md5Router(), SipRouter())}


def violations(df: DataFrame, shards: int, router: Md5Router | SipRouter = ROUTERS["md5"], given: str = "partition") -> DataFrame:
    """Rows whose ``given`` shard isn't the one that owns their host."""
    return router.routed(df, shards).where(F.col("shard") != F.col(given))
