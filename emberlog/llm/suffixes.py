"""Operator 5, suffix-array dedup: all maximal repeats, from common-prefix interval trees.

A repeat of at least WINDOW words is found by its first window, so suffixes that could share such
a prefix are those whose first windows are equal. Three reductions, none of which loses a repeat,
make the suffix arrays small:

1. Only windows that occur more than once can begin or continue a repeat (``windows``).
2. Repeated windows that always follow each other are one symbol, a *chain*; suffixes are
   compared as sequences of chains, which ends where the text stops repeating.
3. A repeat that all its occurrences extend to the left alike isn't maximal, so only suffixes
   at chains whose left neighbours differ (*heads*) are sorted.

Each head has a leader, the least of the runs that hold it. Runs go once to each of their leaders,
from the first head on (a *tail*). Tails that are the same symbol for symbol are one leaf, however
many texts have them, and their occurrences take no part in the sorting: a passage that a share of all
documents has is as many leaves as there are continuations of it. Each leader builds one enhanced
suffix array for all its heads, and its ranks are joined to the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_bounds, parts_for, pick, table, written
from .substrings import WINDOW
from .textarrays import STEP, U, mix
from .windows import Bundle, repeated_windows, shares

_SUFFIX = U(0xB5C18A6E4F9D2E35)
_BACK = U(pow(int(_SUFFIX), -1, 2**64))
RUNS = "run bigint, doc_id bigint, start bigint, chains array<bigint>, lens array<int>"
GROUP = "struct<last: int, n_words: bigint>"
PLACED = f"leader bigint, tail bigint, places array<struct<head: bigint, words: bigint, rank: int, n_words: bigint, groups: array<{GROUP}>>>"
_PLACES = pa.list_(
    pa.struct(
        [("head", pa.int64()), ("words", pa.int64()), ("rank", pa.int32()), ("n_words", pa.int64()), ("groups", pa.list_(pa.struct([("last", pa.int32()), ("n_words", pa.int64())])))]
    )
)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _runs(group: pa.Table) -> pa.Table:
    """The runs of repeated windows of a bundle's texts, as sequences of chains."""
    s = Bundle(group)
    n = len(s.at)
    if not n:
        return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))], ["run", "doc_id", "start", "chains", "lens"])
    apart = np.ones(n, bool)
    apart[1:] = (s.doc[1:] != s.doc[:-1]) | (s.at[1:] != s.at[:-1] + 1)
    cut = apart.copy()
    cut[1:] |= s.sums[:-1] * U(STEP) != s.sums[1:]
    chain = np.flatnonzero(cut)
    lens = np.diff(np.append(chain, n)).astype(np.int32)
    run = np.flatnonzero(apart)
    bounds = np.append(np.searchsorted(chain, run), len(chain))
    names = mix(s.name.view(U) + s.at[run].astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)
    doc = s.doc[run]
    ids = pa.array(s.ids[doc], mask=~s.valid[doc])
    return pa.table([pa.array(names), ids, pa.array(s.pos[run]), _lists(s.sums[chain].view(np.int64), bounds), _lists(lens, bounds)], ["run", "doc_id", "start", "chains", "lens"])


TAILS = "leader bigint, tail bigint, run bigint, doc_id bigint, start bigint, left bigint, chains array<bigint>, lens array<int>, heads array<int>"


#: Runs that are looked at together, and symbols of tails that are handed over together.
TOGETHER, HANDED = 200, 200_000
_TAILS = pa.schema([*((n, pa.int64()) for n in ("leader", "tail", "run", "doc_id", "start", "left")), ("chains", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("heads", pa.list_(pa.int32()))])


def _tails_of(r: dict) -> Iterator[tuple]:
    chains, lens = np.array(r["chains"], np.int64), np.array(r["lens"], np.int32)
    ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
    # hashes of all suffixes at once: sums of places' worths, scaled to begin at each place
    power = np.cumprod(np.full(len(chains), _SUFFIX, U)) * _BACK
    sums = np.cumsum((mix(chains.view(U)) * power)[::-1])[::-1]
    back = np.cumprod(np.full(len(chains), _BACK, U)) * _SUFFIX
    hashes = mix(sums * back + np.arange(len(chains), 0, -1, dtype=U)).view(np.int64)
    by: dict[int, list[int]] = {}
    for h in r["heads"]:
        by.setdefault(h["leader"], []).append(h["k"])
    for leader, at in by.items():
        at.sort()
        k = at[0]
        # without a repeated window before it, an occurrence's left neighbour is like no other's
        left = int(chains[k - 1]) if k else r["run"]
        yield leader, int(hashes[k]), r["run"], r["doc_id"], r["start"] + int(ends[k]), left, chains[k:], lens[k:], np.array(at, np.int32) - np.int32(k)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run and each of its leaders: the run from the first head of that leader on."""
    rows, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, TOGETHER):
            for r in batch.slice(i, TOGETHER).to_pylist():
                for row in _tails_of(r):
                    rows.append(row)
                    size += len(row[6])
                    if size >= HANDED:
                        yield _tail_batch(rows)
                        rows, size = [], 0
    if rows:
        yield _tail_batch(rows)


def _tail_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    lists = [_lists(np.concatenate(c), np.concatenate(([0], np.cumsum([len(x) for x in c])))) for c in columns[6:]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), *lists], schema=_TAILS)


def rank_levels(symbols: np.ndarray, remaining: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols (prefix doubling); the last are those
    of the suffix array. ``remaining``: symbols from each position to its sequence's end."""
    _, rank = np.unique(symbols, return_inverse=True)
    levels, width = [rank.astype(np.int64)], 1
    longest = int(remaining.max(initial=0))
    while width < longest:
        rank = levels[-1]
        after = np.zeros(len(rank), np.int64)
        has = remaining > width
        after[has] = rank[np.flatnonzero(has) + width] + 1
        _, new = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        levels.append(new.astype(np.int64))
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], remaining: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that suffixes ``a`` and ``b`` have in common at their beginnings, pair by pair."""
    found = np.zeros(len(a), np.int64)
    limit = np.minimum(remaining[a], remaining[b])
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(found + (1 << k) <= limit)
        same = fits[levels[k][a[fits] + found[fits]] == levels[k][b[fits] + found[fits]]]
        found[same] += 1 << k
    return found


def interval_tree(lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, length) of the maximal repeats among sorted suffixes.

    ``lcp[i]``: what suffixes i and i + 1 have in common; ``left[i]``: the symbol before suffix i.
    A scan with a stack yields each interval of suffixes with a common prefix that no suffix next
    to it shares; those whose suffixes have one left symbol only aren't maximal.
    """
    out, stack = [], []  # of [length, first, left symbol or None if they differ]
    for i in range(len(left)):
        height = lcp[i] if i < len(lcp) else -1
        first, symbol = i, left[i]
        while stack and stack[-1][0] > height:
            length, begin, other = stack.pop()
            symbol = other if other == symbol else None
            if symbol is None:
                out.append((begin, i, length))
            first = begin
        if stack and stack[-1][0] == height:
            if stack[-1][2] != symbol:
                stack[-1][2] = None
        elif height >= 0:
            stack.append([height, first, symbol])
    return out


def longest(tree: list[tuple[int, int, int]], count: int) -> list[int]:
    """Of each of ``count`` suffixes, the length of the longest repeat that it belongs to (0 if none)."""
    found, open_, at = [0] * count, [], 0
    for first, last, length in tree:  # inner ones come before outer ones
        open_.extend(range(at, last + 1))
        at = max(at, last + 1)
        while open_ and open_[-1] >= first:
            found[open_.pop()] = length
    return found


def _trees(words: int):
    """Over the distinct tails of a leader: their ranks in the suffix arrays of its heads, the longest
    repeat at each, and the groups that begin at each rank."""

    def run(group: pa.Table) -> pa.Table:
        chains, lens, heads = (group[c].combine_chunks() for c in ("chains", "lens", "heads"))
        symbols, sizes = chains.values.to_numpy(), lens.values.to_numpy().astype(np.int64)
        bounds = chains.offsets.to_numpy().astype(np.int64)
        symbols, sizes, bounds = symbols[bounds[0] : bounds[-1]], sizes[bounds[0] : bounds[-1]], bounds - bounds[0]
        count = np.diff(bounds)
        owner = np.repeat(np.arange(len(count)), count)
        remaining = bounds[1:][owner] - np.arange(len(symbols))
        levels = rank_levels(symbols, remaining)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        head_bounds = heads.offsets.to_numpy().astype(np.int64)
        at = heads.values.to_numpy()[head_bounds[0] : head_bounds[-1]] + np.repeat(bounds[:-1], np.diff(head_bounds))
        at = at[np.lexsort((at, levels[-1][at], symbols[at]))]
        # a tail that occurs more than once is two leaves, which have all of it in common
        many = (group["n"].to_numpy() > 1)[owner[at]]
        leaf = np.repeat(np.arange(len(at)), 1 + many)
        pos, second = at[leaf], np.concatenate(([False], leaf[1:] == leaf[:-1]))
        common = np.where(second[1:], remaining[pos[:-1]], common_prefixes(levels, remaining, pos[:-1], pos[1:]))
        length = upto[pos[:-1] + common] - upto[pos[:-1]] + words - 1
        begins = pos == bounds[:-1][owner[pos]]
        edge = np.where(second, group["high"].to_numpy()[owner[pos]], group["low"].to_numpy()[owner[pos]])
        left = np.where(begins, edge, symbols[np.maximum(pos - 1, 0)])
        found, cuts = group_bounds(symbols[pos])
        places: list[list[dict]] = [[] for _ in count]
        for k, symbol in enumerate(found):
            a, b = int(cuts[k]), int(cuts[k + 1])
            tree = interval_tree(length[a : b - 1].tolist(), left[a:b].tolist())
            if not tree:
                continue
            base, ends = int(leaf[a]), longest(tree, b - a)
            groups: dict[int, list[dict]] = {}
            for first, last, n in tree:
                groups.setdefault(int(leaf[a + first]), []).append({"last": int(leaf[a + last]) - base, "n_words": n})
            for i in range(a, b):
                if not second[i] and ends[i - a]:
                    p, o = int(pos[i]), int(owner[pos[i]])
                    places[o].append({"head": int(symbol), "words": int(upto[p] - upto[bounds[o]]), "rank": int(leaf[i]) - base, "n_words": ends[i - a], "groups": groups.get(int(leaf[i]), [])})
        return pa.table([group["leader"], group["tail"], pa.array(places, _PLACES)], names=["leader", "tail", "places"])

    return run


def maximal_repeats(docs: DataFrame, words: int = WINDOW) -> DataFrame:
    """All maximal repeats of at least ``words`` words, with all their occurrences:
    head, rank, doc_id, start_word, n_words, groups.

    A row is an occurrence of a beginning (``head``): the text of ``doc_id`` from word ``start_word``
    on, its ``rank`` in the suffix array of that beginning, and the words of the longest maximal
    repeat that begins there. Occurrences that continue alike as far as anything repeats share a
    rank. ``groups`` are the maximal repeats whose ranks begin with the row's: the occurrences of
    the head with ranks from ``rank`` to ``last`` have ``n_words`` words in common, and no others
    have. They are listed at one of the rows with that rank (the other rows' lists are empty), so nested repeats share
    rows, and the result is linear in the occurrences (``expanded`` gives each group its own). The
    words after a repeat differ between its occurrences, and so do those before it; a text's begin
    and end differ from all.

    Null and empty texts have no words; very long texts are treated like others; null doc_ids stay
    null; rows that are repeated are copies of each other, each with its occurrences (ties in rank);
    a text can repeat itself. An empty table gives an empty result; other columns are ignored. Words
    are runs of other than ASCII white space. Windows are compared by 64-bit hashes.
    """
    runs = written(repeated_windows(docs, words, sums=True).groupBy("bundle").applyInArrow(_runs, RUNS), "runs")
    each = runs.select("run", F.posexplode("chains").alias("k", "chain"), "chains").select("run", "k", "chain", F.expr("get(chains, k - 1)").alias("left"))
    found = each.groupBy("chain").agg(F.count("*").alias("n"), F.count("left").alias("lefts"), F.min("left").alias("low"), F.max("left").alias("high"), F.min("run").alias("leader"))
    heads = written(found.where("lefts < n OR low <> high").select("chain", "leader"), "heads")
    placed = each.select("run", "k", "chain").join(heads, "chain").groupBy("run").agg(F.collect_list(F.struct("leader", "k")).alias("heads"))
    tails = written(runs.join(placed, "run").select("run", "doc_id", "start", "chains", "lens", "heads").mapInArrow(_tails, TAILS), "tails")
    leaves = tails.groupBy("leader", "tail").agg(
        *(F.first(c).alias(c) for c in ("chains", "lens", "heads")), F.count("*").alias("n"), F.min("left").alias("low"), F.max("left").alias("high"), F.min("run").alias("lister")
    )
    leaves = written(leaves, "leaves")
    # sorting a leaf costs far more than its bytes say, so tasks aren't merged by their bytes
    tasks = parts_for(pick(docs, "doc_id", "text"), shares(docs.sparkSession)[0])
    ranked = leaves.drop("lister").repartition(tasks, "leader").groupBy("leader").applyInArrow(_trees(words), PLACED)
    ranked = ranked.join(leaves.select("leader", "tail", "lister"), ["leader", "tail"])
    rows = tails.select("leader", "tail", "run", "doc_id", "start").join(ranked, ["leader", "tail"])
    rows = rows.select("doc_id", "start", (F.col("run") == F.col("lister")).alias("lists"), F.explode("places").alias("p"))
    groups = F.when(F.col("lists"), F.col("p.groups")).otherwise(F.array().cast(f"array<{GROUP}>"))
    return rows.select("p.head", "p.rank", "doc_id", (F.col("start") + F.col("p.words")).alias("start_word"), "p.n_words", groups.alias("groups"))


def expanded(repeats: DataFrame) -> DataFrame:
    """A row for each maximal repeat and each of its occurrences: head, first, last, n_words, doc_id, start_word.
    Nested repeats list the same places again: the rows can be more than linear."""
    groups = repeats.select("head", F.col("rank").alias("first"), F.explode("groups").alias("g")).select("head", "first", "g.last", "g.n_words")
    return groups.join(repeats.select("head", "rank", "doc_id", "start_word"), "head").where("rank BETWEEN first AND last").drop("rank")


def op5_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(table(spark, sf_dir, "documents"))
