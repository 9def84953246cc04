from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm.common import decode_ascending, encode_ascending
from emberlog.llm.substrings import repeated_passages
from emberlog.llm import windows
from emberlog.llm.suffixes import expanded, interval_tree, longest, maximal_repeats
from emberlog.llm.textarrays import Words, slices, window_hashes


def corpus(seed, docs=50):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))] for _ in range(6)]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = list(rng.choice(base))
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = rng.choice("xyzab")
            words += part
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out


def brute_intervals(docs, n):
    texts = [(i, (t or "").split()) for i, t in docs]
    seen = Counter(tuple(w[p : p + n]) for _, w in texts for p in range(len(w) - n + 1))
    out = []
    for i, w in texts:
        spans = []
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n])
        out += [(i, a, b, b - a) for a, b in spans]
    return out


def brute_repeats(docs, least):
    """All maximal repeats, by extending every repeated word sequence one word at a time."""
    texts = [(t or "").split() for _, t in docs]
    level = defaultdict(list)
    for d, w in enumerate(texts):
        for p in range(len(w) - least + 1):
            level[tuple(w[p : p + least])].append((d, p))
    found = {}
    while level := {k: v for k, v in level.items() if len(v) > 1}:
        longer = defaultdict(list)
        for k, places in level.items():
            n = len(k)
            rights = {texts[d][p + n] if p + n < len(texts[d]) else ("end", d) for d, p in places}
            lefts = {texts[d][p - 1] if p else ("begin", d) for d, p in places}
            for d, p in places:
                if p + n < len(texts[d]):
                    longer[(*k, texts[d][p + n])].append((d, p))
            if len(rights) > 1 and len(lefts) > 1:
                found[k] = sorted((docs[d][0], p) for d, p in places)
        level = longer
    return found


def listed(repeats, docs):
    words = {i: (t or "").split() for i, t in docs}
    groups = defaultdict(list)
    for r in expanded(repeats).collect():
        groups[r.head, r.first, r.last, r.n_words].append((r.doc_id, r.start_word))
    found = {}
    for (_, _, _, n), places in groups.items():
        doc, at = places[0]
        key = tuple(words[doc][at : at + n])
        assert key not in found
        found[key] = sorted(places)
    return found


def test_words_and_windows_are_exact():
    texts = ["a bb  a bb", None, "", " a", "bb\x0ba bb a", "é a"]
    w = Words.of(pa.array(texts))
    h = w.hashes()
    flat = [x for t in texts for x in (t or "").split()]
    assert w.counts.tolist() == [4, 0, 0, 1, 4, 2]
    assert {a == b for a, b in zip(h[:, None] == h[None], np.array(flat)[:, None] == np.array(flat)[None]) for a, b in zip(a, b)} == {True}
    hashes, at = window_hashes(h, w.first, 2)
    assert at.tolist() == [0, 1, 2, 5, 6, 7, 9]
    assert len(set(hashes.tolist())) == len({tuple(flat[i : i + 2]) for i in at})
    assert [*slices(pa.array(texts, pa.string()), 4)][-1][1] == len(texts)


def test_ascending_codec():
    values, bounds = np.array([0, 3, 600, 5, 127, 255, 2**21, 2**21 + 2**40]), np.array([0, 3, 3, 8])
    packed = encode_ascending(values, bounds).to_pylist()
    found, counts = decode_ascending(packed)
    assert found.tolist() == values.tolist() and counts.tolist() == [3, 0, 5]
    assert [x.tolist() for x in decode_ascending([b"", b""])] == [[], [0, 0]]
    # a byte or two a value, however far they reach
    assert len(encode_ascending(np.arange(0, 10**9, 10_000), np.array([0, 10**5]))[0].as_py()) < 2 * 10**5 + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(table_of, seed):
    docs = corpus(seed)
    assert sorted(map(tuple, repeated_passages(table_of(docs).repartition(3), 5).collect())) == sorted(brute_intervals(docs, 5))


def test_passages_of_odd_tables(odd, empty, odd_rows):
    found = sorted(map(tuple, repeated_passages(odd).collect()), key=repr)
    assert found == sorted(brute_intervals(odd_rows, 50), key=repr)
    assert {(r[0], r[3]) for r in found} == {(None, 160), (5, 160), (7, 40_000), (8, 40_000)}
    assert len(found) == 5
    assert repeated_passages(empty).collect() == [] == maximal_repeats(empty).collect()


@pytest.mark.parametrize(("tasks", "parts"), [(5000, 1), (3, 7)])
def test_many_tasks_and_parts(table_of, monkeypatch, tasks, parts):
    """Any number of tasks and of parts in them finds the same, and what is sent doesn't grow with it."""
    docs = corpus(7, 400)
    monkeypatch.setattr(windows, "BUNDLE_BYTES", 2000)
    monkeypatch.setattr(windows, "SORTED", 300)
    monkeypatch.setattr(windows, "parts_for", lambda df, each: 16)
    monkeypatch.setattr(windows, "shares", lambda spark: (1, parts))
    assert sorted(map(tuple, repeated_passages(table_of(docs).repartition(2), 5).collect())) == sorted(brute_intervals(docs, 5))
    w = Words.of(pa.array([t for _, t in docs] * 40))
    hashes, at = window_hashes(w.hashes(), w.first, 5)
    task = np.sort(np.random.default_rng(1).integers(0, tasks, len(at)))
    cuts = np.concatenate(([0], np.cumsum(np.bincount(task, minlength=tasks))))
    at = np.concatenate([np.sort(x) for x in np.split(np.random.default_rng(2).permutation(at), cuts[1:-1])])
    assert sum(len(x) for x in encode_ascending(at, cuts).to_pylist()) <= 3 * len(at)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repeats_equal_brute_force(table_of, seed):
    docs = corpus(seed)
    found = maximal_repeats(table_of(docs).repartition(3), 4)
    want = brute_repeats(docs, 4)
    assert listed(found, docs) == want
    # n_words: the longest repeat that begins at the place
    best = {}
    for key, places in want.items():
        for p in places:
            best[p] = max(best.get(p, 0), len(key))
    assert {(r.doc_id, r.start_word): r.n_words for r in found.collect()} == best and found.count() == len(best)


def test_a_passage_of_many_documents_is_few_leaves(table_of, monkeypatch):
    """A passage in each twentieth document and its copies with four continuations: a leader sorts the
    distinct continuations, not the occurrences."""
    from emberlog.llm import suffixes

    rng, passage = random.Random(9), [f"p{k}" for k in range(12)]
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    docs = []
    for i in range(2000):
        mine = [word() for _ in range(8)]
        if i % 20 == 0:
            mine[4:4] = passage + [f"q{i % 80}{k}" for k in range(5)]
        docs.append((i, " ".join(mine)))
    sizes, kept = [], suffixes.written

    def seen(df, name):
        df = kept(df, name)
        if name == "leaves":
            sizes.extend(r["count"] for r in df.groupBy("leader").count().collect())
        return df

    monkeypatch.setattr(suffixes, "written", seen)
    found = maximal_repeats(table_of(docs), 6)
    assert listed(found, docs) == brute_repeats(docs, 6) and max(sizes) <= 4
    assert {r.doc_id for r in found.collect()} == set(range(0, 2000, 20))


def test_repeats_of_odd_tables(odd):
    groups = defaultdict(list)
    for r in expanded(maximal_repeats(odd)).collect():
        groups[r.head, r.first, r.last, r.n_words].append(str(r.doc_id))
    found = {(k[3], tuple(sorted(v))) for k, v in groups.items()}
    assert (40_000, ("7", "8")) in found and (160, ("5", "5", "None")) in found


def test_interval_tree():
    # banana: suffixes a, ana, anana, banana, na, nana
    assert set(interval_tree([1, 3, 0, 0, 2], [ord(c) for c in "nnb$aa"])) >= {(0, 2, 1), (1, 2, 3)}
    assert (4, 5, 2) not in interval_tree([1, 3, 0, 0, 2], [ord(c) for c in "nnb$aa"])


def test_longest():
    assert longest([(1, 2, 9), (0, 3, 5), (5, 6, 4)], 7) == [5, 9, 9, 5, 0, 4, 4]
