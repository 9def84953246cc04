"""Registered queries against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import shutil

import duckdb
import pytest

import corpus_pipeline
from emberlog.llm import quality
from emberlog.llm.common import documents_like
from emberlog.llm.queries import ORACLES, QUERIES
from emberlog.llm.tokens import count_tokens

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_equals_its_stages_one_by_one(spark):
    """run() against the stages' brute-force counterparts: DuckDB, all pairs, and plain search."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rows = {r[0]: r[1] for r in con.sql("SELECT doc_id, text FROM (" + quality.oracle() + ")").fetchall()}
    from test_neardup import brute

    gone = {i for i, _ in brute(sorted(rows.items()))}
    rows = {i: t for i, t in rows.items() if i not in gone}
    flat = lambda s: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in s.lower()).split()) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in flat(t) for x in items)}
    from emberlog.llm.secrets import _found, redact, trained

    ids = sorted(rows)
    rows = {i: redact(rows[i], s) for i, s in zip(ids, _found([rows[i] for i in ids], trained()))}
    found = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    assert found == {i: count_tokens(t) for i, t in rows.items()}


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_of_odd_and_empty_tables(spark, odd, empty, odd_rows):
    """What each stage makes of nulls, empty and long texts, ties, repeated rows and clashing columns."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scans", "packing"]
    every = [str(i) for i, _ in odd_rows]
    want = {
        # texts without words go, and so does the long text without a sentence mark
        "quality_rules": ["5", "5", "6", "9", "10", "None"],
        "near_dedup": ["1", "2", "3", "5", "6", "7", "9", "10", "None"],
        "decontamination": every,
        "secret_scans": every,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == COLUMNS, name
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(want[name]), name
        assert all((r.lang, r.source) == ("en", "s") for r in rows), name
        none = stage(spark, empty, DATA)
        assert none.columns == COLUMNS and none.collect() == [], name
    packed = corpus_pipeline.packing(spark, odd, DATA)
    total = {}
    for r in packed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total[5] == 2 * count_tokens(odd_rows[4][1]) and total[7] == count_tokens(odd_rows[7][1]) and {1, 2}.isdisjoint(total)
    assert corpus_pipeline.packing(spark, empty, DATA).collect() == []


def test_nulls_in_all_columns(spark, table_of):
    rows = [(None,) * 10, (1, None, None, None, None, None, None, None, None, None), (2, "Plain words of a text that ends here.", None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, table_of([]).schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = [r.doc_id for r in stage(spark, docs, DATA).collect()]
        assert sorted(map(str, kept)) == (["2"] if name == "quality_rules" else ["1", "2", "None"]), name
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, DATA).collect()} == {2}


@pytest.mark.parametrize("given", ["odd", "empty"])
def test_pipeline_of_odd_and_empty_tables(spark, request, tmp_path, odd_rows, given):
    documents_like(request.getfixturevalue(given)).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{DATA}/benchmark.parquet", tmp_path)
    found = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    text = {i: t for i, t in odd_rows}
    assert found == ({i: count_tokens(text[i]) for i in (5, 6, 9, 10)} if given == "odd" else {})


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_of_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    # token blocks have their frequency table even so
    assert rows == [] or name == "op10_rans_blocks" and [r.kind for r in rows] == ["table"]
