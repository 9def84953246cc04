"""Operator 8, substring dedup: removal intervals of passages that repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .windows import Bundle, repeated_windows

#: Words of a window: passages of at least so many words that repeat are found.
WINDOW = 50


def _intervals(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        s = Bundle(group)
        if not len(s.at):
            return schema.empty_table()
        begin = np.flatnonzero(np.concatenate(([True], (s.doc[1:] != s.doc[:-1]) | (s.pos[1:] > s.pos[:-1] + words))))
        last = np.append(begin[1:], len(s.at)) - 1
        start, end, doc = s.pos[begin], s.pos[last] + words, s.doc[begin]
        return pa.table([pa.array(s.ids[doc], mask=~s.valid[doc]), start, end, end - start], schema=schema)

    return run


def repeated_passages(docs: DataFrame, words: int = WINDOW) -> DataFrame:
    """Maximal intervals of words, [start_word, end_word), covered by windows of ``words`` words
    that occur more than once in ``docs``, in one text or several.

    Every window of every text, however long, is hashed (Rabin-Karp, 64 bits) and counted;
    overlapping or touching repeated windows of a text merge. Each interval of each copy is listed:
    the caller decides which copy stays. A null text, like an empty one, has no words; a null doc_id
    stays null; rows that are the same are copies of each other, and each is listed: there are no
    ties to break. Words are runs of other than ASCII white space. An empty table gives an empty
    result; other columns are ignored.
    """
    return repeated_windows(docs, words).groupBy("bundle").applyInArrow(_intervals(words), "doc_id bigint, start_word bigint, end_word bigint, n_words bigint")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS i, len(a) AS n FROM w),
s AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM g),
h AS (SELECT doc_id, i, md5(s) AS h FROM s WHERE i + {WINDOW} <= n),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS b FROM r),
k AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + {WINDOW})::BIGINT AS end_word, (max(i) + {WINDOW} - min(i))::BIGINT AS n_words FROM k GROUP BY doc_id, k
"""
