"""Operator 7, URL filters: sort-merge range join of reversed-host keys with nested rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, pick, table

#: Rules (rule_id, pattern, action). A pattern is a host suffix of whole labels, or a host and a
#: path prefix; the innermost rule that covers a URL decides.
RULES = (
    (1, "adult-x.example.com", "block"),
    (2, "adult-x.example.net", "block"),
    (3, "adult-x.example.org", "block"),
    (4, "spam-farm.example.com", "block"),
    (5, "spam-farm.example.net", "block"),
    (6, "spam-farm.example.org", "block"),
    (7, "cheap-pills.example.com", "block"),
    (8, "cheap-pills.example.net", "block"),
    (9, "cheap-pills.example.org", "block"),
    (10, "ads-track.example.com", "block"),
    (11, "ads-track.example.net", "block"),
    (12, "ads-track.example.org", "block"),
    (13, "casino-win.example.com", "block"),
    (14, "casino-win.example.net", "block"),
    (15, "casino-win.example.org", "block"),
    (16, "free-bets.example.com", "block"),
    (17, "free-bets.example.net", "block"),
    (18, "free-bets.example.org", "block"),
    (19, "example.net", "allow"),
    (20, "free-bets.example.net/en/1", "allow"),
    (21, "free-bets.example.net/en/19", "block"),
    (22, "adult", "block"),
)
RULE_SCHEMA = "rule_id bigint, pattern string, action string"
#: Bytes of the URL column per part, and keys sampled for each part's bounds.
PART_BYTES, SAMPLED = 32 << 20, 64

_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?([^#]*)"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
#: A host of two labels at least, at the begin of a URL without a scheme.
_BARE = r"^[^\s/?#:@.]+(?:\.[^\s/?#:@.]+)+\.*(?::[0-9]+)?(?:[/?#]|$)"


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(F.lower(F.regexp_replace(host, r"\.+$", "")), r"\.")), ","), F.lit(","))


def canonical_key(url: Column) -> Column:
    """'https://User@M.Example.net:80/a?b#c' -> 'net,example,m,)/a?b'; null if it isn't a URL with a host.
    White space around it doesn't count; 'm.example.net/a' and '//m.example.net/a' are URLs too."""
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    bare = F.when(url.startswith("//"), F.concat(F.lit("any:"), url)).when(url.rlike(_BARE), F.concat(F.lit("any://"), url)).otherwise(url)
    url = F.when(url.rlike(_SCHEME), url).otherwise(bare)
    host, rest = F.regexp_extract(url, _PARTS, 1), F.regexp_extract(url, _PARTS, 2)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(_reversed(host), F.lit(")"), path))


def rule_prefix(pattern: Column) -> Column:
    """The keys that a rule covers are those that begin with this: 'example.net' -> 'net,example,',
    'm.example.net/en' -> 'net,example,m,)/en'."""
    host = F.regexp_extract(pattern, "^([^/]*)", 1)
    path = F.substring(pattern, F.length(host) + 1, F.length(pattern))
    return F.when(host != "", F.when(path == "", _reversed(host)).otherwise(F.concat(_reversed(host), F.lit(")"), path)))


def _placed(cuts: list[bytes], last_part: bool):
    """Adds the part of each row's key; for a rule, one row for each part that its interval meets."""
    bounds = np.array(cuts, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_pylist()
            low = np.searchsorted(bounds, np.array(keys, object), "right") if cuts else np.zeros(len(keys), np.int64)
            if last_part:
                ends = np.array([k + b"\xff" for k in keys], object)
                high = np.searchsorted(bounds, ends, "left") if cuts else low
                row = np.repeat(np.arange(len(keys)), high - low + 1)
                part = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
                batch = batch.take(pa.array(row))
            else:
                part = low
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", *batch.schema.names])

    return run


SWEPT = "page_id bigint, url string, key string, rule_ids array<bigint>, action string"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps rows in order of (part, key, rules first), keeping the rules that are active at each key."""
    part, active = None, []
    for batch in batches:
        rows, found, actions = [], [], []
        columns = [batch.column(n).to_pylist() for n in ("part", "key", "is_url", "rule_id", "action")]
        for i, (at, key, is_url, rule, action) in enumerate(zip(*columns)):
            if at != part:
                part, active = at, []
            while active and not key.startswith(active[-1][0]):
                active.pop()
            if is_url:
                rows.append(i)
                found.append([x[1] for x in active])
                actions.append(active[-1][2] if active else None)
            else:
                active.append((key, rule, action))
        kept = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [kept.column("page_id"), kept.column("url"), kept.column("key").cast(pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(actions, pa.string())],
            ["page_id", "url", "key", "rule_ids", "action"],
        )


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every page with the rules that cover its URL, outermost first, and whether it is kept:
    page_id, url, key, rule_ids, action, kept.

    Keys are canonical (scheme, user, port and fragment dropped; host lower-case, its labels
    reversed), so each rule covers one interval of keys, and intervals nest or are disjoint. Keys
    and rules are cut into parts at sampled keys, each part is sorted, and one sweep keeps the
    stack of active rules. A rule goes to every part that its interval meets, so parts are
    complete however the sample falls; neither side is broadcast or collected. The innermost
    rule's action decides; of rules with one prefix the one with the largest rule_id is innermost.
    A missing scheme and white space around a URL don't matter (the SQL takes URLs as they are).
    Percent escapes are compared as they are written, and any port is dropped. Each part is a task of
    its own; the keys sampled for their bounds (SAMPLED for each part) are all that the driver gets.
    URLs that are null, empty or have no host have a null key, no rules, and are kept; very long URLs
    are compared whole; rules whose pattern is null or has no host cover nothing; repeated rows are each
    listed. Without pages the result is empty; without rules every page is kept. ``rules`` has
    RULE_SCHEMA. Other columns are ignored.
    """
    pages = pick(pages, "page_id", "url").select(F.col("page_id").cast("bigint").alias("page_id"), "url").withColumn("key", canonical_key(F.col("url")))
    spark, parts = pages.sparkSession, parts_for(pages, PART_BYTES, projected=True)
    keyed = pages.where("key is not null").withColumn("key", F.col("key").cast("binary"))
    size = int(str(keyed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    share = min(1.0, parts * SAMPLED * 100 / max(size, 1))
    sample = sorted({bytes(r.key) for r in keyed.select("key").sample(share, 7).toLocalIterator()})
    cuts = [sample[i * len(sample) // parts] for i in range(1, parts)] if len(sample) >= parts else sample
    urls = keyed.selectExpr("page_id", "url", "key", "true AS is_url", "cast(null AS bigint) AS rule_id", "cast(null AS string) AS action")
    prefixes = pick(rules, "rule_id", "pattern", "action").withColumn("key", rule_prefix(F.col("pattern")).cast("binary")).where("key is not null")
    marks = prefixes.selectExpr("cast(null AS bigint) AS page_id", "cast(null AS string) AS url", "key", "false AS is_url", "cast(rule_id AS bigint) AS rule_id", "action")
    schema = "part int, page_id bigint, url string, key binary, is_url boolean, rule_id bigint, action string"
    placed = urls.mapInArrow(_placed(cuts, False), schema).unionByName(marks.mapInArrow(_placed(cuts, True), schema))
    swept = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "is_url", F.asc_nulls_first("rule_id")).mapInArrow(_swept, SWEPT)
    without = pages.where("key is null").selectExpr("page_id", "url", "key", "array() AS rule_ids", "cast(null AS string) AS action")
    without = without.withColumn("rule_ids", F.col("rule_ids").cast("array<bigint>"))
    return swept.unionByName(without).withColumn("kept", ~F.col("action").eqNullSafe("block"))


def op7_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE_SCHEMA))
    # as text, a list of rules compares alike in any engine
    return found.withColumn("rule_ids", F.array_join(F.col("rule_ids").cast("array<string>"), ">"))


_HOST = "lower(regexp_replace(regexp_extract({0}, '{1}', 1), '\\.+$', ''))"
_KEY = "array_to_string(list_reverse(string_split({0}, '.')), ',') || ','"
ORACLE = f"""
WITH r AS (SELECT rule_id, action, host, substr(pattern, length(host) + 1) AS path FROM
  (SELECT *, regexp_extract(pattern, '^([^/]*)', 1) AS host FROM (VALUES {", ".join(map(str, RULES))}) AS v(rule_id, pattern, action))),
p AS (SELECT rule_id, action, {_KEY.format("host")} || CASE WHEN path = '' THEN '' ELSE ')' || path END AS prefix FROM r),
u AS (SELECT page_id, url, {_HOST.format("url", _PARTS)} AS host, regexp_extract(url, '{_PARTS}', 2) AS rest FROM pages),
k AS (SELECT page_id, url, CASE WHEN host <> '' THEN {_KEY.format("host")} || ')' || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END END AS key FROM u),
j AS (SELECT page_id, url, key, string_agg(rule_id::VARCHAR, '>' ORDER BY length(prefix), rule_id) AS rule_ids,
  arg_max(action, length(prefix) * 1000 + rule_id) AS action FROM k LEFT JOIN p ON starts_with(key, prefix) GROUP BY ALL)
SELECT page_id, url, key, coalesce(rule_ids, '') AS rule_ids, action, coalesce(action <> 'block', true) AS kept FROM j
"""
