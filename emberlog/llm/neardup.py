"""Operator 2, MinHash near-dedup with tensored banding.

Two small collections of bands are hashed, and each pair of a band of the one and a band of the other
keys a table: BAND**2 tables from 2 * BAND * WIDTH min-hashes. Nodes (distinct shingle sets) that share
a key meet; candidates are verified one pair at a time by the exact similarity of their sets, and only
verified pairs are connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, documents_like, group_bounds, joined, parts_for, pick, table, written
from .textarrays import PLAIN_BETWEEN, PLAIN_BYTE, U, Words, mix, slices
from .windows import pieces, shares

#: Words of a shingle, and the least Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 2, 0.6
#: Two collections of BAND bands of WIDTH min-hashes: their pairs form BAND**2 tables of
#: 2 * WIDTH min-hashes from 2 * BAND * WIDTH in all (40 for 100 tables). A pair of similarity s
#: meets in some table with probability (1 - (1 - s**WIDTH)**BAND)**2: 0.977 at 0.6, 0.9997 at 0.8.
BAND, WIDTH = 10, 2
HASHES = 2 * BAND * WIDTH
#: Nodes whose keys are sent together, and bytes of keys in a batch that a worker hands over.
TOGETHER, HANDED = 20_000, 2 << 20
#: Bits of the Bloom filter of candidates, at any size of the corpus: with few candidates it keeps
#: nearly all other sets out of the shuffle, with very many it lets them pass.
BLOOM_BITS, BLOOM_HASHES = 1 << 25, 4
#: Counters of how often shingles occur in open buckets, at any size: they only say what order to look in.
COUNTERS = 1 << 20
#: Pieces in which tables of tasks are merged.
CUTS = 16

_RNG = np.random.Generator(np.random.PCG64(20))
_MULTIPLY = _RNG.integers(0, 2**31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit shingle hashes of all texts, and their bounds by text. A text of fewer
    words than a shingle has one shingle of them all; one without words has none."""
    found = Words.of(texts, PLAIN_BETWEEN)
    h, counts = found.hashes(PLAIN_BYTE), found.counts
    text = found.text_of_word()
    pair = h.copy()
    for k in range(1, SHINGLE):
        pair[:-k] = mix(pair[:-k] * U(0x9E3779B97F4A7C15) + h[k:])
    left = found.first[1:][text] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
    keep = (left >= SHINGLE) | ((counts[text] < SHINGLE) & (left == counts[text]))
    pair, text = pair[keep], text[keep]
    if SHINGLE > 1:
        short = counts[text] < SHINGLE
        pair[short] = h[keep][short]
    key = (text.astype(U) << U(32)) | (pair >> U(32))
    key = np.unique(key)
    return (key & U(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key, np.arange(len(texts) + 1, dtype=U) << U(32))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of each non-empty cut of ``values``."""
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(values * _MULTIPLY[k] + _ADD[k], bounds[:-1])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """2 * BAND 64-bit band hashes: the first collection, then the second."""
    out = np.zeros((len(sig), 2 * BAND), U)
    for k in range(WIDTH):
        out = mix(out * U(0x9E3779B97F4A7C15) + sig[:, k::WIDTH].astype(U) + U(k + 1))
    return out


def _sets(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with shingles: (rows, values, bounds, name), where a set's name is a hash of it."""
    for batch in batches:
        for a, b in slices(batch.column(at)):
            rows = batch.slice(a, b - a)
            values, bounds = shingles(rows.column(at))
            some = np.flatnonzero(np.diff(bounds))
            if not len(some):
                continue
            rows, bounds = rows.take(pa.array(some)), np.append(bounds[:-1][some], bounds[-1])
            name = mix(np.add.reduceat(mix(values.astype(U) + U(0x2545F4914F6CDD1D)), bounds[:-1]) + np.diff(bounds).astype(U))
            yield rows, values, bounds, name.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, values, bounds, name in _sets(batches, 1):
        sig = signatures(values, bounds)
        cut = np.arange(len(sig) + 1) * HASHES
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(name), binaries(sig.ravel(), cut), binaries(values, bounds)], ["doc_id", "row", "node", "sig", "shingles"])


def table_keys(sig: np.ndarray) -> np.ndarray:
    """The BAND**2 keys of each signature: a band of the first collection with one of the second."""
    band = bands(sig)
    first, second = band[:, :BAND] * U(0x9E3779B97F4A7C15), band[:, BAND:]
    number = np.arange(BAND * BAND, dtype=U).reshape(1, BAND, BAND)
    return mix(first[:, :, None] + second[:, None, :] + (number << U(1))).reshape(len(sig), BAND * BAND)


KEYED = "task int, keys binary, nodes binary"


def _keyed(tasks: int):
    """(node, sig) -> the keys of many nodes and the nodes, packed by the task that a key selects."""

    def sent(nodes: list[np.ndarray], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = table_keys(np.concatenate(sigs))
        nodes = np.repeat(np.concatenate(nodes), keys.shape[1])
        keys = keys.ravel()
        task = ((keys >> U(32)) % U(tasks)).astype(np.uint16 if tasks <= 65536 else np.int32)
        order = np.argsort(task, kind="stable")
        to, bounds = group_bounds(task[order])
        to, keys, nodes = to.astype(np.int32), keys[order], nodes[order]
        for a, b in pieces(bounds, HANDED // 8):
            mine, cuts = slice(bounds[a], bounds[b]), bounds[a : b + 1] - bounds[a]
            yield pa.RecordBatch.from_arrays([pa.array(to[a:b]), binaries(keys[mine], cuts), binaries(nodes[mine], cuts)], ["task", "keys", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sigs, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                nodes.append(part.column("node").to_numpy())
                sigs.append(joined(part.column("sig"), np.uint32).reshape(-1, HASHES))
                size += part.num_rows
                if size >= TOGETHER:
                    yield from sent(nodes, sigs)
                    nodes, sigs, size = [], [], 0
        if size:
            yield from sent(nodes, sigs)

    return run


MET = "a bigint, b bigint, bucket bigint, members binary"
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("members", pa.binary())])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all rows of a task: the pairs of each bucket's least node with its others (a, b), and each
    distinct bucket of more than two nodes (bucket: a hash of its members)."""
    held = [(joined(b.column("keys"), U), joined(b.column("nodes"), np.int64)) for b in batches if b.num_rows]
    if not held:
        return
    keys, nodes = (np.concatenate(x) for x in zip(*held))
    del held
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[once], nodes[once]
    _, bounds = group_bounds(keys)
    size = np.diff(bounds)
    leader = np.repeat(nodes[bounds[:-1]], size)
    other = np.ones(len(nodes), bool)
    other[bounds[:-1]] = False
    a, b = leader[other], nodes[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    none = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())
    yield from pa.table([pa.array(a), pa.array(b), *none], schema=_MET).to_batches(max_chunksize=100_000)
    name = mix(np.add.reduceat(mix(nodes.view(U).copy()), bounds[:-1]) + size.astype(U)).view(np.int64)
    many = np.flatnonzero(size > 2)
    _, first = np.unique(name[many], return_index=True)
    for k in np.array_split(many[first], max(1, len(first) // 1000)):
        if len(k):
            members = [nodes[bounds[i] : bounds[i + 1]].tobytes() for i in k]
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(name[k]), pa.array(members, pa.binary())], schema=_MET)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, members) -> (bucket, node)."""
    for batch in batches:
        for bucket, members in zip(*(c.to_pylist() for c in batch.columns)):
            nodes = np.frombuffer(members, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), bucket)), pa.array(nodes)], ["bucket", "node"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a < b), root the least node of its component.

    Alternates large and small stars until nothing changes; each round is written, so a lost
    executor costs one round at most.
    """
    edges = written(edges.distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(small_least, large.b == small_least.n).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = written(small.select(F.col("e.m").alias("a"), F.col("e.b").alias("b")).where("a <> b").distinct(), "edges")
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        edges = new


def _bloom_bits(names: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(names.view(U).copy())
    for k in range(BLOOM_HASHES):
        yield (((h >> U(9 * k)) ^ (h * U(2 * k + 3))) & U(BLOOM_BITS - 1)).astype(np.int64)


def _merged(filled: DataFrame, kind: type, size: int, add: np.ufunc) -> np.ndarray:
    """One array of tasks' arrays (rows of cut, data), merged by ``add`` in CUTS pieces: what reaches the
    driver is one array, whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for cut, data in zip(*(c.to_pylist() for c in batch.columns)):
                mine = found.setdefault(cut, np.zeros(len(data) // np.dtype(kind).itemsize, kind))
                add(mine, np.frombuffer(data, kind), out=mine)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["cut", "data"])

    out = np.zeros((CUTS, size // CUTS), kind)
    for r in filled.repartitionById(CUTS, F.col("cut")).mapInArrow(run, "cut int, data binary").collect():
        out[r.cut] = np.frombuffer(r.data, kind)
    return out.ravel()


def _cut(values: np.ndarray) -> pa.RecordBatch:
    cuts = values.reshape(CUTS, -1)
    some = np.flatnonzero(cuts.any(1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([c.tobytes() for c in cuts[some]], pa.binary())], ["cut", "data"])


def _bloom_filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field = np.zeros(BLOOM_BITS, bool)
    for batch in batches:
        for bits in _bloom_bits(batch.column(0).to_numpy()):
            field[bits] = True
    yield _cut(np.packbits(field))


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """The filter's bytes (BLOOM_BITS / 8, whatever the number of nodes), filled and merged by tasks."""
    return _merged(nodes.mapInArrow(_bloom_filled, "cut int, data binary"), np.uint8, BLOOM_BITS // 8, np.bitwise_or)


def _bloom_hits(field: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.ones(len(names), bool)
    for bits in _bloom_bits(names):
        out &= (field[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1 > 0
    return out


def _hit(bloom):
    """(node, shingles) of nodes in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_bloom_hits(bloom.value, batch.column("node").to_numpy())))

    return run


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarity of sets of 32-bit numbers (ascending, as binaries), pair by pair."""

    def keyed(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pa.compute.binary_length(sets).to_numpy().astype(np.int64) // 4
        return np.repeat(np.arange(len(sizes), dtype=U) << U(32), sizes) | joined(sets, np.uint32).astype(U), sizes

    (x, n), (y, m) = keyed(a), keyed(b)
    at = np.searchsorted(x, y)
    same = x[np.minimum(at, max(len(x) - 1, 0))] == y if len(x) else np.zeros(len(y), bool)
    both = np.bincount((y[same] >> U(32)).astype(np.int64), minlength=len(n))
    return both / np.maximum(n + m - both, 1)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch.column("set_b")):
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similarities(part.column("set_a"), part.column("set_b")))], ["a", "b", "similarity"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, one by one, however many share a node. Sets are merged, by
    the same plan at every size."""
    mine = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b")
    both = mine.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_compared, "a bigint, b bigint, similarity double")


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles.astype(U)) & U(COUNTERS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for a, b in slices(batch.column(0)):
            counts += np.bincount(_counter(joined(batch.column(0).slice(a, b - a), np.uint32)), minlength=COUNTERS)
    yield _cut(counts)


PREFIXES = "shingle bigint, node bigint, root bigint, size int, place int"


def _prefixes(counts, similarity: float):
    """(node, root, shingles) -> the first shingles of each set, in order of their counters: two sets that
    are similar enough have one of these in common, so common ones need no look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("shingles")):
                part = batch.slice(i, j - i)
                sizes = pa.compute.binary_length(part.column("shingles")).to_numpy().astype(np.int64) // 4
                values = joined(part.column("shingles"), np.uint32)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                often = counts.value[_counter(values)]
                order = np.lexsort((values, often, owner))
                place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                length = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
                # a counter of 1 is of a shingle that no other set has
                keep = (place < length[owner]) & (often[order] > 1)
                k = pa.array(owner[keep])
                columns = [pa.array(values[order][keep].astype(np.int64)), part.column("node").take(k), part.column("root").take(k), pa.array(sizes[owner[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "node", "root", "size", "place"])

    return run


def prefix_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, root_a, root_b): all pairs of ``nodes`` (node, root, shingles) of different roots that can be
    as similar as that. No such pair is left out: in any order of the shingles, two sets of that
    similarity share one among the first (1 - similarity) of each, and from there on enough are left.
    Rare shingles come first, so that what many sets share (a passage, a template) yields no pairs."""
    counts = nodes.sparkSession.sparkContext.broadcast(_merged(nodes.select("shingles").mapInArrow(_counted, "cut int, data binary"), np.int64, COUNTERS, np.add))
    firsts = nodes.mapInArrow(_prefixes(counts, similarity), PREFIXES)
    x, y = (firsts.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "size", "place"))) for k in "ab")
    enough = f"least(size_a - place_a, size_b - place_b) >= {similarity / (1 + similarity)} * (size_a + size_b) - 1e-6"
    met = x.join(y, "shingle").where(f"node_a < node_b AND root_a <> root_b AND {enough}")
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "root_a", "root_b").distinct()


def verified_groups(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root): what pairs that meet in a table (MET) and are at least so similar connect, for
    nodes that any such pair has.

    First, each bucket's least node is compared with its others, and what is similar is connected. The
    members of buckets that aren't connected by then may be similar to each other: for them, an
    exact join by rare shingles (``prefix_pairs``) finds all pairs of different components that can
    be, also of different buckets. So every pair of a bucket is compared, connected otherwise, or
    known to be dissimilar, and texts that share a template don't cost a pair each with each.
    """
    checked = written(compared(met.where("bucket IS NULL").select("a", "b").distinct(), sets), "checked")
    roots = written(components(checked.where(F.col("similarity") >= similarity).select("a", "b")), "roots")
    members = met.where("bucket IS NOT NULL").select("bucket", "members").dropDuplicates(["bucket"]).mapInArrow(_members, "bucket bigint, node bigint")
    placed = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    apart = placed.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("bucket")
    loose = placed.join(apart, "bucket", "left_semi").select("node", "root").distinct()
    loose = written(loose.join(sets.hint("merge"), "node"), "loose")
    cross = written(prefix_pairs(loose, similarity).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "cross")
    similar = compared(cross.select("a", "b"), sets).where(F.col("similarity") >= similarity).select("a", "b")
    links = similar.join(cross, ["a", "b"]).select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
    again = written(components(links).select(F.col("node").alias("root"), F.col("root").alias("_root")), "roots")
    # nodes that were alone until now are roots of their own
    alone = again.select(F.col("root").alias("node"), "root").join(roots, "node", "left_anti")
    return roots.unionByName(alone).join(again, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))


def _rows(docs: DataFrame) -> DataFrame:
    """With ``_row``: a hash of doc_id and text, the same only for rows that are repeated."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, node) of all documents with words, and (node, group) of the nodes that have near
    copies. A node is a distinct set of shingles: copies of a text are one node from the start."""
    docs = _rows(pick(docs, "doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "_row")
    spark = docs.sparkSession
    tasks = parts_for(docs, shares(spark)[0])
    # the sets are written beside the signatures: reading them again costs less than cutting the texts again
    signed = written(docs.mapInArrow(_signed, "doc_id bigint, row bigint, node bigint, sig binary, shingles binary"), "signatures")
    nodes = signed.groupBy("node").agg(F.first("sig").alias("sig"))
    met = written(nodes.mapInArrow(_keyed(tasks), KEYED).repartitionById(tasks, F.col("task")).select("keys", "nodes").mapInArrow(_met, MET), "met")
    pairs = met.where("bucket IS NULL")
    bloom = spark.sparkContext.broadcast(bloom_of(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))))
    sets = signed.select("node", "shingles").mapInArrow(_hit(bloom), "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    groups = verified_groups(met, written(sets, "sets"), similarity)
    return signed.select("doc_id", "row", "node"), groups.withColumnRenamed("root", "group")


def decisions(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For all rows that have near copies: doc_id, row, rows (how often it is repeated), stays, keep_id."""
    named, groups = near_groups(docs, similarity)
    classes = named.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    classes = classes.groupBy("group", "doc_id", "row").agg(F.count("*").alias("rows"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = classes.groupBy("group").agg(F.sum("rows").alias("_n"), F.min(key).alias("_kept")).where("_n > 1")
    return classes.join(kept, "group").select(
        "doc_id", "row", "rows", (F.col("row") == F.col("_kept.row")).alias("stays"), F.col("_kept.doc_id").alias("keep_id")
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Near copies and what stays for them: doc_id, keep_id.

    Texts are compared as sets of word pairs without case and punctuation. Candidates meet in one of
    BAND**2 tables, whose keys each combine a band of one small collection of min-hashes with a band of
    another. Candidates are verified by the exact Jaccard similarity of their sets, pair by pair, and
    only verified pairs are connected: texts that share a template but aren't similar never meet in
    one task. The least doc_id of each group stays (nulls last, ties by a hash of the row): every
    other row of the group is listed with it. Copies with the same set are one node, and of n near
    copies about n pairs are compared. All pairs of a table are compared, connected already, or known
    to be dissimilar; none is left out (``verified_groups``).

    Null texts and texts without words are never copies; very long texts are compared whole. A null
    doc_id is listed as null. Rows that are repeated (same doc_id and text) are copies: each but one
    is listed, with its own doc_id as keep_id if it is the one that stays. An empty table gives an
    empty result; other columns are ignored.
    """
    listed = decisions(docs, similarity).where("NOT stays OR rows > 1")
    return listed.select("doc_id", "keep_id", F.explode(F.expr("array_repeat(0, cast(rows - if(stays, 1, 0) as int))"))).select("doc_id", "keep_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` lists: one row of each group stays, and
    every row without near copies (null and empty texts among them). Of repeated rows one stays.
    Columns other than those of ``documents`` are dropped; an empty table stays empty."""
    docs = documents_like(docs)
    decided = written(decisions(docs, similarity).select("row", "rows", "stays"), "decided")
    rows = _rows(docs)
    same = F.col("_row") == F.col("row")
    # by one plan at every size, whose sort can spill
    plain = rows.join(decided.where("NOT stays").hint("merge"), same, "left_anti")
    again = decided.where("stays AND rows > 1")
    if not again.isEmpty():
        once = plain.join(again, same, "left_semi").dropDuplicates(["_row"])
        plain = plain.join(again, same, "left_anti").unionByName(once)
    return plain.drop("_row")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
