from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from emberlog.llm import neardup
from emberlog.llm.neardup import SIMILARITY, components, drop_near_duplicates, near_duplicates, prefix_pairs, shingles, similarities, table_keys, verified_groups


def brute(rows):
    """(doc_id, keep_id) by comparing all pairs."""
    values, b = shingles(pa.array([t for _, t in rows], pa.string()))
    sets = [set(values[b[i] : b[i + 1]].tolist()) for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda x: (x is None, x))
        out += [(x, ids[0]) for x in ids[1:]]
    return sorted(out, key=repr)


def copies(seed, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text).capitalize() + rng.choice(["", ".", "!"])))
    rng.shuffle(rows)
    return rows


def test_recall_and_precision_against_all_pairs(table_of):
    rows = copies(1) + [(i + 1000, t) for i, t in copies(2)]
    want, got = set(brute(rows)), {tuple(r) for r in near_duplicates(table_of(rows)).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_a_full_filter_finds_the_same(table_of, monkeypatch):
    rows = copies(3)
    got = sorted(map(tuple, near_duplicates(table_of(rows)).collect()))
    monkeypatch.setattr(neardup, "bloom_of", lambda nodes: np.full(neardup.BLOOM_BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, near_duplicates(table_of(rows)).collect())) == got


def test_the_filter_has_all_its_nodes(spark):
    nodes = np.random.default_rng(1).integers(-(2**63), 2**63, 20_000)
    field = neardup.bloom_of(spark.createDataFrame([(int(n),) for n in nodes[:10_000]], "node bigint"))
    hits = neardup._bloom_hits(field, nodes)
    assert hits[:10_000].all() and hits[10_000:].mean() < 0.01


def test_texts_of_one_template_stay_apart(table_of):
    """600 documents that share a template, similar by 0.43: candidates of each other, but no copies."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        rows.append((i, " ".join(f"t{k}" for k in range(60)) + " " + " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(40))))
    assert near_duplicates(table_of(rows)).collect() == []
    values, b = shingles(pa.array([t for _, t in rows[:2]]))
    both = len(np.intersect1d(values[: b[1]], values[b[1] :]))
    assert 0.4 < both / (len(values) - both) < 0.46


def test_prefix_pairs_are_all_that_can_be_similar(spark):
    rng = np.random.default_rng(7)
    common = rng.choice(1000, 30, replace=False)
    sets = [np.unique(np.concatenate((common[: rng.integers(0, 31)], rng.integers(0, 60, rng.integers(1, 40))))).astype(np.uint32) for _ in range(60)]
    # a passage that many have, beside more of their own
    sets += [np.unique(np.concatenate((common, rng.integers(10**6, 10**9, 30)))).astype(np.uint32) for _ in range(200)]
    nodes = spark.createDataFrame([(i, i % 50 if i < 60 else i, x.tobytes()) for i, x in enumerate(sets)], "node bigint, root bigint, shingles binary")
    got = {(r.a, r.b) for r in prefix_pairs(nodes, SIMILARITY).collect()}
    root = [i % 50 if i < 60 else i for i in range(260)]
    similar = {(i, j) for j in range(260) for i in range(j) if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j])) >= SIMILARITY * len(np.union1d(sets[i], sets[j]))}
    assert similar <= got and not any(a >= 60 for a, b in got)


def test_similarities():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50, n).astype(np.uint32)) for n in (1, 5, 30, 60, 5, 1)]
    pairs = [(a, b) for a in sets for b in sets]
    found = similarities(*(pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1)))
    assert np.allclose(found, [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs])


def test_keys_combine_the_bands_of_two_collections():
    sig = np.random.default_rng(4).integers(0, 2**32, (6, neardup.HASHES), dtype=np.uint32)
    half = neardup.BAND * neardup.WIDTH
    sig[1, : neardup.WIDTH] = sig[0, : neardup.WIDTH]  # a band of the first collection only
    sig[2, half : half + neardup.WIDTH] = sig[0, half : half + neardup.WIDTH]  # of the second only
    sig[3, : neardup.WIDTH], sig[3, -neardup.WIDTH :] = sig[0, : neardup.WIDTH], sig[0, -neardup.WIDTH :]  # of both
    keys = table_keys(sig)
    assert keys.shape == (6, 100) and len(np.unique(keys)) == 599 and (keys[0] == keys[3]).sum() == 1


def test_all_pairs_of_buckets_count(spark):
    """Any similar pair of a bucket is connected, also members that the least node is not similar to."""
    rng = np.random.default_rng(6)
    for _ in range(2):
        base = [rng.choice(400, 40, replace=False) for _ in range(5)]
        sets = []
        for _ in range(40):
            x = base[rng.integers(5)].copy()
            at = rng.choice(40, rng.integers(0, 14), replace=False)
            x[at] = rng.integers(400, 800, len(at))
            sets.append(np.unique(x).astype(np.uint32))
        buckets = {tuple(sorted(rng.choice(40, rng.integers(2, 20), replace=False).tolist())) for _ in range(6)}
        rows = [(min(b), m, None, None) for b in buckets for m in b if m != min(b)]
        rows += [(None, None, k, np.array(b, np.int64).tobytes()) for k, b in enumerate(buckets) if len(b) > 2]
        met = spark.createDataFrame(rows, neardup.MET)
        table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node bigint, shingles binary")
        alike = [[len(np.intersect1d(x, y)) >= SIMILARITY * len(np.union1d(x, y)) for y in sets] for x in sets]

        def rooted(groups):
            root = list(range(40))
            for _ in range(40):
                for g in groups:
                    for x in g:
                        for y in g:
                            if alike[x][y]:
                                root[x] = root[y] = min(root[x], root[y])
            return root

        least, most = rooted(buckets), rooted([range(40)])
        found = {r.node: r.root for r in verified_groups(met, table, SIMILARITY).collect()}
        found = [found.get(i, i) for i in range(40)]
        # what the pairs of buckets connect, and nothing that similar pairs don't
        assert all(found[i] == found[j] for i in range(40) for j in range(40) if least[i] == least[j])
        assert all(most[i] == most[found[i]] and found[i] <= i for i in range(40))


def test_many_copies_that_differ(table_of):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(4):
            text[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(text)))
    assert {tuple(r) for r in near_duplicates(table_of(rows)).collect()} == {(i, 0) for i in range(1, 300)}
    assert [r.doc_id for r in drop_near_duplicates(table_of(rows)).collect()] == [0]


def test_odd_tables(odd, empty, odd_rows):
    assert sorted(map(tuple, near_duplicates(odd).collect()), key=repr) == brute(odd_rows) == [(5, 5), (8, 7), (None, 5)]
    kept = drop_near_duplicates(odd)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r.doc_id), r.text is None) for r in kept.collect()) == sorted(
        [("1", True), ("2", False), ("3", False), ("5", False), ("6", False), ("7", False), ("None", True), ("9", False), ("10", False)]
    )
    assert near_duplicates(empty).collect() == [] == drop_near_duplicates(empty).collect()


def test_components(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(70)} | {(k, k + 1) for k in range(200, 260)}
    found = {r.node: r.root for r in components(spark.createDataFrame(sorted(edges), "a bigint, b bigint")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == root
