"""The pipeline against its stages done plainly, and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from cloudloom.llm import oracles, quality, queries
from tests_llm_plain import plain_contaminated, plain_groups

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("predicted = 1").collect()}
    good = [(r.doc_id, r.text) for r in docs if r.doc_id in judged]
    kept = [d for d, _, _, k in plain_groups(good, corpus_pipeline.NEAR_PERCENT) if k]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in good if d in set(kept) and not plain_contaminated(t, bench)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean) and all(r.round_trip for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, SF), con.sql(oracles.ORACLES[name])
    names, rows = list(rel.columns), rel.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rows)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def test_stages_at_the_edges(spark, weird, nothing):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, empty tables."""
    clash = weird.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "cast(null as long) as n_chars", "'x' as score", "1 as n_words", "2 as id", "3 as found", "4 as n_entities", "5 as digest")
    empty = clash.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        got = stage(spark, clash, SF)
        if name != "byte-level BPE":
            assert got.columns == corpus_pipeline.COLUMNS, name
        rows = got.collect()
        if name in ("benchmark decontamination", "PII", "byte-level BPE"):
            assert len(rows) == weird.count(), name
        if name == "byte-level BPE":
            assert all(r.round_trip for r in rows)


def test_scopes_leave_nothing(spark):
    from pathlib import Path

    from cloudloom.llm import storage

    df = spark.range(5)
    with storage.scope(spark) as kept:
        gone = storage.settle(df, "gone")
        kept.append(storage.settle(df, "kept"))
    there = lambda t: Path(t._scratch.removeprefix("file://")).exists()
    assert not there(gone) and there(kept[0]) and kept[0].count() == 5
