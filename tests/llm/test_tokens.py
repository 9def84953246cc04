from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import packing, rans
from emberlog.llm.packing import best_boundaries, pack
from emberlog.llm.rans import LANES, LOW, Table, checkpoints, decode, decode_block, decode_blocks, decoded_texts, encode, encode_blocks, quantised
from emberlog.llm.tokens import count_tokens, encoder, token_counts, token_ids


_ODD_TEXT = st.text(st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0\u1680\u2003\u2028\u205f\u3000'!?.aA1é日"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), _ODD_TEXT), max_size=6))
def test_chunks_give_the_tokens_of_the_whole(texts):
    whole = [encoder()(t or "") for t in texts]
    column = pa.array(texts, pa.string())
    ids, bounds = token_ids(column)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole
    assert token_counts(column).tolist() == [len(x) for x in whole]


def test_boundaries_are_optimal():
    rng = random.Random(1)
    cost = lambda h, cuts: sum(n * (min(b for b in cuts if b >= x) - x) for x, n in h.items())
    for _ in range(300):
        h, k = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}, rng.randint(1, 4)
        lengths = sorted(h)
        best = min(cost(h, c) for m in range(1, min(k, len(lengths)) + 1) for c in itertools.combinations(lengths, m) if c[-1] == lengths[-1])
        found = best_boundaries(h, k)
        assert len(found) <= k and cost(h, found) == best
    assert best_boundaries({}, 3) == []


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, max_tokens=700, buckets=5, budget=3000).collect()
    want = {r.doc_id: len(encoder()(r.text)) for r in docs.collect()}
    total, batches = {}, {}
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        batches.setdefault(r.bucket_tokens, {}).setdefault(r.batch, []).append(r)
    assert total == {k: v for k, v in want.items() if v}
    histogram = {}
    for r in rows:
        histogram[r.n_tokens] = histogram.get(r.n_tokens, 0) + 1
    bounds = best_boundaries(histogram, 5)
    assert sorted(batches) == bounds and all(r.bucket_tokens == min(b for b in bounds if b >= r.n_tokens) for r in rows)
    for bucket, by in batches.items():
        full = 3000 // bucket
        assert sorted(by) == list(range(len(by))) and all(len(by[k]) == full for k in range(len(by) - 1)) and len(by[len(by) - 1]) <= full
    with pytest.raises(ValueError):
        pack(docs, max_tokens=100, budget=99)


def test_packing_odd_tables(odd, empty, odd_rows):
    rows = pack(odd).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {5: 2 * count_tokens(odd_rows[4][1]), None: count_tokens(odd_rows[3][1])} | {i: n for i, t in odd_rows if i not in (5, None) and (n := count_tokens(t))}
    assert pack(empty).collect() == []


def test_frequencies():
    f = quantised(np.array([0, 1, 10**9, 5, 0]), 8)
    assert f.sum() == 256 and f[[0, 4]].tolist() == [0, 0] and (f[[1, 2, 3]] > 0).all()
    assert quantised(np.zeros(3)).sum() == 0
    with pytest.raises(ValueError):
        quantised(np.ones(9), 3)


def test_blocks_round_trip_from_every_checkpoint():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.3, 500)
    t = Table(quantised(counts))
    for steps in (1, 255, 256, 700):
        x = rng.choice(500, (3, steps, rans.LANES), p=counts / counts.sum()).astype(np.uint16)
        for block, (stream, states, checks) in zip(x, encode_blocks(x, t)):
            flat = block.ravel()
            for n in (flat.size, flat.size - 7):
                assert (decode_block(n, stream, states, t) == flat[:n]).all()
            marks = checkpoints(checks)
            assert [m[0] for m in marks] == list(range(256, steps, 256))
            for i, (step, word, state) in enumerate(marks):
                end = marks[i + 1][0] if i + 1 < len(marks) else steps
                assert (decode_block(flat.size, stream, state, t, step, word, end - step) == flat[step * 64 : end * 64]).all()


def scalar(tokens, t):
    """One token and one state at a time, from the definition: the stream's words, and the first states."""
    state, words = [LOW] * LANES, []
    for i in range(len(tokens) - 1, -1, -1):
        f, c = int(t.freq[tokens[i]]), int(t.start[tokens[i]])
        x = state[i % LANES]
        if x >= (LOW >> t.bits << 32) * f:
            words.append(x & 0xFFFFFFFF)
            x >>= 32
        state[i % LANES] = (x // f << t.bits) + x % f + c
    return words[::-1], state


def test_blocks_equal_a_scalar_coder():
    rng = np.random.default_rng(4)
    counts = rng.zipf(1.2, 300)
    t = Table(quantised(counts))
    x = rng.choice(300, (2, 300, LANES), p=counts / counts.sum()).astype(np.uint16)
    for block, (stream, states, _) in zip(x, encode_blocks(x, t)):
        words, first = scalar(block.ravel().tolist(), t)
        assert np.frombuffer(stream, np.uint32).tolist() == words and np.frombuffer(states, np.uint64).tolist() == first


def test_blocks_of_all_sizes_are_decoded_together():
    rng = np.random.default_rng(5)
    counts = rng.zipf(1.3, 500)
    t = Table(quantised(counts))
    blocks, want = [], []
    for n in (0, 1, 64, 65, 256 * 64, 256 * 64 + 1, 700 * 64 - 3, 1024 * 64):
        flat = rng.choice(500, n, p=counts / counts.sum()).astype(np.uint16)
        padded = np.concatenate((flat, np.zeros(-n % LANES, np.uint16)))
        blocks.append((n, *encode_blocks(padded.reshape(1, -1, LANES), t)[0]))
        want.append(flat.tolist())
    assert [x.tolist() for x in decode_blocks(blocks, t)] == want
    assert decode_blocks([], t) == []


def texts_of(blocks):
    return sorted(((r.doc_id, r.ids) for r in decoded_texts(blocks).collect()), key=repr)


def tokens_of(rows):
    return sorted(((i, None if t is None else encoder()(t)) for i, t in rows), key=repr)


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blocks = encode(docs)
    assert texts_of(blocks) == tokens_of((r.doc_id, r.text) for r in docs.collect())
    numbers = [r.block for r in blocks.where("kind = 'block'").collect()]
    assert len(set(numbers)) == len(numbers)


def test_odd_tables_round_trip(odd, empty, odd_rows):
    assert texts_of(encode(odd)) == tokens_of(odd_rows)
    assert encode(empty).count() == 1 and decode(encode(empty)).collect() == []


def test_repeated_and_null_ids_over_several_blocks(table_of):
    rng = random.Random(6)
    long = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(90_000))
    same = long()
    rows = [(None, long()), (None, long()), (5, same), (5, same), (5, long()), (None, None), (None, ""), (5, "short")]
    blocks = encode(table_of(rows).repartition(3))
    assert blocks.count() > 6 and texts_of(blocks) == tokens_of(rows)


def test_damage_is_found(spark, table_of):
    from pyspark.sql import functions as F

    blocks = encode(table_of([(1, "some words that are coded")]))
    broken = blocks.withColumn("token_crc", F.when(F.col("kind") == "block", F.lit(1).cast("bigint")).otherwise(F.col("token_crc")))
    with pytest.raises(Exception, match="damaged"):
        decode(broken).collect()
