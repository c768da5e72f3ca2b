"""The registered queries of the subpackage on the smallest tables, and the pipeline."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from attestor.llm import exact_dedup, mixing, near_dedup, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(spark, tables, name):
    got = queries.queries()[name](spark, SF)
    expected = tables.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert Counter(map(tuple, got.select(expected.columns).collect())) == Counter(expected.fetchall())


@pytest.mark.parametrize("name", [q for q in queries.queries() if q not in queries.oracle_sql()])
def test_one_row_a_document(spark, tables, name):
    got = queries.queries()[name](spark, SF).select("doc_id").collect()
    ids = tables.sql("SELECT doc_id FROM documents").fetchall()
    assert Counter(r.doc_id for r in got) == Counter(i for i, in ids)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, verdicts = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "source_mix", "encoded"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge_quality(docs, quality.train_quality(docs, labels))
    verdicts["quality_rules"] = {r.doc_id: int(r.kept) for r in judged.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "exact_copies":
            verdicts[name] = {r.doc_id: int(r.kept) for r in exact_dedup.exact_groups(docs).collect()}
        elif name == "near_copies":
            verdicts[name] = {r.doc_id: int(r.kept) for r in near_dedup.near_groups(docs).collect()}
        elif name == "source_mix":
            verdicts[name] = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        assert Counter(r.doc_id for r in docs.collect()) == +Counter(verdicts[name]), name
    kept = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == kept and len(kept) > 50
