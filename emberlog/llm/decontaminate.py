"""Operator 1, benchmark decontamination: windows of templates, and consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_like, pick, table, written
from .textarrays import PLAIN_BETWEEN, PLAIN_BYTE, U, Words, buffers, mix, slices, window_hashes

#: Tokens of a window, and those of them at least that are no slots.
WINDOW, LITERALS = 8, 5
#: Shortest item that is looked for. Items shorter than a window are one window.
SHORTEST = 4
#: An item leaked if windows of one alignment cover so many of its tokens, or half of them.
COVERED = 13
#: Most window hashes of the benchmark that are sent to executors to filter with; beyond it all
#: windows of the documents are shuffled to the join.
FILTERED = 1 << 20

LITERAL, NUMBER, NAME, UNIT = range(4)
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz lb lbs pound pounds "
    "ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month "
    "months year years cent cents dollar dollars usd euro euros eur gbp percent degree degrees celsius fahrenheit kph mph watt watts kw kwh "
    "volt volts amp amps joule joules meter meters metre metres kilometer kilometers kilometre kilometres"
).split()
_DIGIT = np.array([chr(b).isdigit() and b < 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.unique(Words.of(pa.array(words), PLAIN_BETWEEN).hashes(PLAIN_BYTE))


_NUMBERS, _UNITS = _hashes_of(NUMBERS), _hashes_of(UNITS)
_SLOT = np.array([0, 0x1B873593A5A5A5A5, 0x38B34AE5C3C3C3C3, 0x6D2B79F59E9E9E9E], U)


class Template:
    """Tokens of texts with typed slots: numbers, names (title case) and units. Adjacent numbers,
    or names, are one slot."""

    def __init__(self, texts: pa.Array):
        raw, offsets = buffers(texts)
        between = PLAIN_BETWEEN[raw]
        digit = _DIGIT[raw]
        # separators of digits are part of a number
        inside = (raw == 44) | (raw == 46)
        if len(raw) > 2:
            inside[1:-1] &= digit[:-2] & digit[2:]
            inside[[0, -1]] = False
            cut = offsets[(offsets > 0) & (offsets < len(raw))]
            inside[cut] = inside[cut - 1] = False
        else:
            inside[:] = False
        self.words = Words(np.where(between & ~inside, np.uint8(32), raw), offsets)
        w = self.words
        self.raw = raw
        plain = Words.hashes(w, PLAIN_BYTE)
        numeric = np.concatenate(([0], np.cumsum(~(digit | inside))))
        upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
        first = raw[w.start] if len(raw) else np.zeros(0, np.uint8)
        second = raw[np.minimum(w.start + 1, max(len(raw) - 1, 0))] if len(raw) else first
        wide = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        capitals = upper[w.end] - upper[w.start]
        kind = np.zeros(len(plain), np.int8)
        kind[(w.end - w.start > 1) & ((_UPPER[first] & (capitals == 1)) | (wide & (capitals == 0)))] = NAME
        kind[np.isin(plain, _UNITS)] = UNIT
        kind[(numeric[w.end] == numeric[w.start]) | np.isin(plain, _NUMBERS)] = NUMBER
        same = np.zeros(len(kind), bool)
        same[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))
        same[w.first[:-1][w.first[:-1] < len(kind)]] = False
        self.plain, self.literal_first = plain, w.first
        self.kept = np.flatnonzero(~same)
        self.kind = kind[self.kept]
        self.typed = np.where(self.kind > 0, _SLOT[self.kind], plain[self.kept])
        self.first = np.searchsorted(self.kept, w.first)

    def windows(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(channel, hashes, at, text): of templates (0), and of plain words (1)."""
        hashes, at = window_hashes(self.typed, self.first, n)
        yield 0, mix(hashes + U(2 * n)), at, np.searchsorted(self.first, at, "right") - 1
        hashes, at = window_hashes(self.plain, self.literal_first, n)
        yield 1, mix(hashes + U(2 * n + 1)), at, np.searchsorted(self.literal_first, at, "right") - 1

    def slots(self, at: int, n: int) -> list[str]:
        """The words of each slot of a template window, in order, with its type."""
        found = []
        for k in np.flatnonzero(self.kind[at : at + n]) + at:
            stop = self.kept[k + 1] if k + 1 < len(self.kept) else len(self.words.start)
            stop = min(stop, self.literal_first[np.searchsorted(self.literal_first, self.kept[k], "right")])
            words = range(self.kept[k], stop)
            text = b" ".join(self.raw[self.words.start[i] : self.words.end[i]].tobytes() for i in words)
            found.append(f"{self.kind[k]}{text.decode('utf-8', 'replace').lower()}")
        return found


HITS = "hash bigint, channel int, n int, key bigint, row bigint, pos int, slots array<string>, places array<int>"


def _hits(lengths: list[int], filtered, own_length: bool):
    """Windows of (key, row, text) rows, those in ``filtered`` only unless that is None. With
    ``own_length`` (items) a text has windows of WINDOW tokens, or one of its own shorter length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if filtered is not None:
            known = filtered.value
            bits = max(16, int(len(known) * 64).bit_length())
            field = np.zeros(1 << bits, bool)
            field[known >> U(64 - bits)] = True
        for batch in batches:
            for a, b in slices(batch.column(2)):
                rows = batch.slice(a, b - a)
                t = Template(rows.column(2))
                keys, ids = rows.column(0), rows.column(1)
                for n in lengths:
                    for channel, hashes, at, text in t.windows(n):
                        first = t.first if channel == 0 else t.literal_first
                        keep = np.arange(len(hashes))
                        if own_length and n < WINDOW:
                            keep = keep[np.diff(first)[text] == n]
                        if filtered is not None:
                            keep = keep[field[hashes[keep] >> U(64 - bits)]]
                            spot = np.minimum(np.searchsorted(known, hashes[keep]), max(len(known) - 1, 0))
                            keep = keep[known[spot] == hashes[keep]] if len(known) else keep[:0]
                        if not len(keep):
                            continue
                        k = pa.array(text[keep])
                        slots = [t.slots(int(x), n) if channel == 0 else [] for x in at[keep]]
                        # the slots' positions in the text
                        places = [(np.flatnonzero(t.kind[x : x + n]) + x - f).tolist() if channel == 0 else [] for x, f in zip(at[keep], first[text[keep]])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes[keep].view(np.int64)), pa.array(np.full(len(keep), channel, np.int32)), pa.array(np.full(len(keep), n, np.int32)),
                             keys.take(k), ids.take(k), pa.array((at[keep] - first[text[keep]]).astype(np.int32)), pa.array(slots, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))],
                            ["hash", "channel", "n", "key", "row", "pos", "slots", "places"],
                        )

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = Template(batch.column(2))
        literal = np.concatenate(([0], np.cumsum(t.kind == 0)))[t.first]
        sizes = [pa.array(np.diff(x).astype(np.int32)) for x in (t.first, t.literal_first, literal)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes], ["key", "row", "typed", "plain", "literals"])


def _one_to_one(pairs: set[tuple[str, str]]) -> bool:
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _ends(longer: str, shorter: str, last: bool) -> bool:
    """Whether a slot's words end with those of another, or (``last``) begin with them."""
    return longer == shorter or (longer.startswith(shorter + " ") if last else longer.endswith(" " + shorter[1:]) and longer[0] == shorter[0])


def _changed(slots: dict[int, tuple[str, str]], size: int) -> int | None:
    """How many values of an item are replaced by another, if the replacements are consistent. The
    item's first and last slot may have absorbed words of the document before and after it."""
    edges = [(p == size - 1, *slots[p]) for p in (0, size - 1) if p in slots and slots[p][0][0] in f"{NUMBER}{NAME}"]
    pairs = {v for p, v in slots.items() if p not in (0, size - 1) or slots[p][0][0] not in f"{NUMBER}{NAME}"}
    if not _one_to_one(pairs):
        return None
    known = dict(pairs)
    for last, a, b in edges:
        if a not in known:
            # the value itself, or all words; with the same value at both edges, the words they share
            other = [d for end, c, d in edges if c == a and end != last]
            words = b[1:].split(" ")
            parts = [b[0] + " ".join(words[:k] if last else words[-k:]) for k in range(len(words), 0, -1)]
            known[a] = next((x for x in (a, *parts) if _ends(b, x, last) and all(_ends(d, x, not last) for d in other) and x not in known.values()), None)
        if known[a] is None or not _ends(b, known[a], last):
            return None
    return sum(a != b for a, b in known.items())


def _best(found: list[dict], typed: int, plain: int, literals: int, least: int = LITERALS) -> tuple[int, int, int] | None:
    """(covered, item_tokens, slots_changed) of the best alignment by which an item leaked: by
    windows with ``least`` literals alone if there is one, else by all windows."""
    strict, loose = [], []
    for x in found:
        channel, size = x["channel"], (typed, plain)[x["channel"]]
        enough = lambda n: n >= COVERED or 2 * n >= size
        tokens, rich = set(), set()
        slots = {s["p"]: (s["a"], s["b"]) for s in x["pairs"]}
        for pos, n in ((y["_pos"], y["n"]) for y in x["spans"]):
            span = range(pos, pos + n)
            tokens.update(span)
            if sum(p not in slots for p in span) >= min(least, n - 1):
                rich.update(span)
        pairs = {v for p, v in slots.items() if p in rich}
        if enough(len(rich)) and _one_to_one(pairs):
            n = len(rich)
            strict.append((n / size, channel, n, -sum(a != b for a, b in pairs), size))
        loose.append((channel, size, x["offset"], tokens, slots))
    if strict:
        _, _, n, changed, size = max(strict)
        return n, size, -changed
    ranked = []
    for channel, size in ((0, typed), (1, plain)):
        for tokens, slots in _joined([x for x in loose if x[0] == channel], size):
            n, changed = len(tokens), _changed(slots, size)
            # too few literals are no evidence, unless the item has no more
            if changed is not None and (n >= COVERED or 2 * n >= size) and (channel or n - len(slots) >= max(1, min(least, literals))):
                ranked.append((n / size, channel, n, -changed, size))
    if ranked:
        _, _, n, changed, size = max(ranked)
        return n, size, -changed
    return None


def _joined(found: list[tuple], size: int) -> Iterator[tuple[set[int], dict[int, tuple[str, str]]]]:
    """Tokens and slots of each alignment alone, and with those whose offsets lie less than WINDOW
    from their neighbour's and less than the item's tokens apart in all, while slots stay consistent."""
    found = sorted(found, key=lambda x: x[2])
    for _, _, _, tokens, slots in found:
        yield tokens, slots
    to = 0
    for at in range(len(found)):
        seen, to = to, max(to, at + 1)
        while to < len(found) and found[to][2] - found[to - 1][2] < WINDOW and found[to][2] - found[at][2] < size:
            to += 1
        if to > seen and to - at > 1:
            tokens, slots = set(), {}
            for _, _, _, more, others in sorted(found[at:to], key=lambda x: -len(x[3])):
                # a token that two alignments cover has one place: that of the longer
                added = {p: v for p, v in others.items() if p not in tokens}
                if more - tokens and _changed(slots | added, size) is not None:
                    tokens, slots = tokens | more, slots | added
            yield tokens, slots


LEAKS = "doc_id bigint, row bigint, item_id bigint, covered int, item_tokens int, slots_changed int"


def _judged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            best = [_best(r["found"], r["typed"], r["plain"], r["literals"], least) for r in rows]
            kept = [(r["key"], r["row"], r["item_id"], *b) for r, b in zip(rows, best) if b]
            columns = list(zip(*kept)) if kept else [[]] * 6
            types = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "row", "item_id", "covered", "item_tokens", "slots_changed"])

    return run


def _keyed(df: DataFrame, key: str) -> DataFrame:
    df = pick(df, key, "text").select(F.col(key).cast("bigint").alias("key"), "text").where("text is not null")
    return df.select("key", F.xxhash64("key", "text").alias("row"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, least: int = LITERALS, filtered_by: int = FILTERED) -> DataFrame:
    """Documents that hold an item of ``benchmark``, re-parameterised or not:
    doc_id, row, item_id, covered, item_tokens, slots_changed.

    Tokens are canonical: case and punctuation don't count, and numbers, names (words in title
    case) and units become typed slots. Windows of WINDOW tokens of the documents are hash-joined
    with those of the items, as templates and as plain words. Windows of a document and an item with
    one distance between their positions are an alignment. A template alignment counts only if its
    slots are consistent: each value of the item is replaced by one value everywhere, and different
    ones by different ones. An item leaked if an alignment covers COVERED of its tokens, or half of
    them; ``slots_changed`` counts the slots with another value. Adjacent names or numbers are one
    slot, also across punctuation: where the item begins or ends with a slot, words of the document
    around it don't count, if no alignment is found with them.

    Template windows with ``least`` (LITERALS) words at least that are no slots decide first, as in the
    SQL. An item that isn't found by them is looked for by all windows, of which an alignment must cover
    ``least`` literals (or all of an item that has fewer): fewer are no evidence. Alignments of near
    offsets, as words put in or left out of a copy make them, count together there. The SQL doesn't list
    these leaks.

    Items of fewer than WINDOW tokens are one window. Items of fewer than ``shortest`` (SHORTEST) tokens
    are not looked for, as a few common words are in many clean documents; the shortest item of the
    given benchmarks has 14. With ``shortest=1`` none is left out. The hashes of the items' windows
    filter the documents' if they are ``filtered_by`` (FILTERED: 8 MB) at most; beyond that, all windows
    take part in a shuffled join, with the same result.

    Null and empty texts match nothing; very long texts are compared whole; null doc_ids and item_ids
    stay null. Rows that are repeated are found once; copies of an item under several ids are each
    found. Of an item's alignments the one that covers the largest share counts, then the one by plain
    words, the longer and the one with fewer slots changed. Empty tables give an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    items, texts = _keyed(benchmark, "item_id").distinct(), _keyed(docs, "doc_id")
    sizes = items.mapInArrow(_lengths, "key bigint, row bigint, typed int, plain int, literals int")
    lengths = list(range(shortest, WINDOW + 1))
    wanted = written(items.mapInArrow(_hits(lengths, None, True), HITS), "item-windows")
    # lengths that no item has need no windows
    lengths = sorted(r.n for r in wanted.select("n").distinct().collect())
    filtered = None
    if wanted.count() <= filtered_by:
        hashes = [b.column(0).to_numpy() for b in wanted.select("hash").distinct().toArrow().to_batches()]
        filtered = spark.sparkContext.broadcast(np.sort(np.concatenate([*hashes, np.zeros(0, np.int64)]).view(U)))
    found = texts.mapInArrow(_hits(lengths, filtered, False), HITS)
    w = wanted.select("hash", "channel", "n", F.col("key").alias("item_id"), F.col("row").alias("_item"), F.col("pos").alias("_pos"), F.col("slots").alias("_slots"), F.col("places").alias("_places"))
    pairs = found.drop("places").join(w, ["hash", "channel", "n"]).withColumn("offset", F.col("pos") - F.col("_pos"))
    aligned = pairs.groupBy("key", "row", "item_id", "_item", "channel", "offset").agg(
        F.collect_set(F.struct("_pos", "n")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("_places").alias("p"), F.col("_slots").alias("a"), F.col("slots").alias("b"))))).alias("pairs"),
    )
    whole = aligned.groupBy("key", "row", "item_id", "_item").agg(F.collect_list(F.struct("channel", "offset", "spans", "pairs")).alias("found"))
    s = sizes.select(F.col("row").alias("_item"), "typed", "plain", "literals").distinct()
    return whole.join(s, "_item").select("key", "row", "item_id", "typed", "plain", "literals", "found").mapInArrow(_judged(least), LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item of ``benchmark``. Columns other than those
    of ``documents`` are dropped; documents with a null or empty text stay; of repeated rows all stay or
    none; an empty table stays empty."""
    docs = documents_like(docs)
    gone = written(leaks(docs, benchmark).select("row").distinct(), "leaks")
    same = F.xxhash64(F.col("doc_id").cast("bigint"), "text") == F.col("row")
    return docs.join(gone, same, "left_anti")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


_WORD = r"(?:[A-Za-z\x{80}-\x{10FFFF}]|[0-9]+(?:[.,][0-9]+)*)+"


def _side(t: str, name: str, key: str) -> str:
    """Tables of one side: t2 has its words, t5 its template tokens, tw its windows of all lengths."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    window = """SELECT {channel} AS channel, {n} AS n, id, h, k AS pos, s FROM (SELECT id, h, k, string_agg(tok, ' ') OVER f AS s, count(*) OVER f AS c,
      sum(literal) OVER f AS l FROM {rows} WINDOW f AS (PARTITION BY id, h ORDER BY k ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)) WHERE c = {n} AND l >= {least}"""
    windows = " UNION ALL ".join(
        window.format(channel=c, n=n, last=n - 1, least=(min(LITERALS, n - 1), n)[c], rows=(f"{t}5", f"{t}2")[c]) for n in range(SHORTEST, WINDOW + 1) for c in (0, 1)
    )
    return f"""{t}1 AS (SELECT DISTINCT {key} AS id, md5(text) AS h, regexp_extract_all(text, '{_WORD}') AS w FROM {name} WHERE text IS NOT NULL),
{t}2 AS (SELECT id, h, k, lower(x) AS tok, 1 AS literal, CASE WHEN regexp_full_match(x, '[0-9.,]+') OR lower(x) IN ({listed(NUMBERS)}) THEN {NUMBER}
  WHEN lower(x) IN ({listed(UNITS)}) THEN {UNIT} WHEN strlen(x) > 1 AND regexp_full_match(x, '[A-Z\u00c0-\u00de][^A-Z]*') THEN {NAME} ELSE {LITERAL} END AS kind
  FROM (SELECT id, h, unnest(w) AS x, unnest(range(len(w))) AS k FROM {t}1)),
{t}3 AS (SELECT *, CASE WHEN kind IN ({NUMBER}, {NAME}) AND kind = lag(kind) OVER (PARTITION BY id, h ORDER BY k) THEN 0 ELSE 1 END AS begins FROM {t}2),
{t}4 AS (SELECT *, sum(begins) OVER (PARTITION BY id, h ORDER BY k) - 1 AS slot FROM {t}3),
{t}5 AS (SELECT id, h, slot AS k, min(kind) AS kind, CASE WHEN min(kind) = {LITERAL} THEN min(tok) ELSE '<' || min(kind) || '>' END AS tok,
  CASE WHEN min(kind) = {LITERAL} THEN 1 ELSE 0 END AS literal, string_agg(tok, ' ' ORDER BY k) AS words FROM {t}4 GROUP BY id, h, slot),
{t}w AS ({windows})"""


ORACLE = f"""WITH {_side("d", "documents", "doc_id")}, {_side("b", "benchmark", "item_id")},
sizes AS (SELECT 0 AS channel, id, h, count(*) AS size FROM b5 GROUP BY id, h UNION ALL SELECT 1, id, h, count(*) FROM b2 GROUP BY id, h),
wanted AS (SELECT bw.*, size FROM bw JOIN sizes USING (channel, id, h) WHERE n = {WINDOW} OR size = n),
pairs AS (SELECT DISTINCT channel, d.id AS doc_id, d.h AS dh, i.id AS item_id, i.h AS ih, size, d.pos - i.pos AS shift, unnest(range(i.pos::BIGINT, i.pos::BIGINT + n)) AS p
  FROM dw AS d JOIN wanted AS i USING (channel, n, s)),
slots AS (SELECT p.*, bt.words AS a, dt.words AS b FROM pairs AS p
  LEFT JOIN b5 AS bt ON channel = 0 AND bt.literal = 0 AND bt.id = item_id AND bt.h = ih AND bt.k = p
  LEFT JOIN d5 AS dt ON channel = 0 AND dt.literal = 0 AND dt.id = doc_id AND dt.h = dh AND dt.k = p + shift),
aligned AS (SELECT channel, doc_id, dh, item_id, ih, size, shift, count(DISTINCT p) AS covered, count(DISTINCT a) AS na, count(DISTINCT b) AS nb,
  count(DISTINCT a || chr(1) || b) AS n, count(DISTINCT CASE WHEN a <> b THEN a || chr(1) || b END) AS changed FROM slots GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dh, item_id ORDER BY covered / size DESC, channel DESC, covered DESC, changed) AS r
  FROM aligned WHERE na = n AND nb = n AND (covered >= {COVERED} OR 2 * covered >= size))
SELECT doc_id, item_id, covered::INTEGER AS covered, size::INTEGER AS item_tokens, changed::INTEGER AS slots_changed FROM ranked WHERE r = 1
"""
