"""The corpus pipeline, stage by stage, against plain versions."""

import corpus_pipeline
import duckdb
import pytest
from test_groups import brute_components, brute_fingerprint

import __spark_entry__


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        if name == "pack":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and all(before[d] == r for d, r in after.items())
        if name == "near_duplicates":
            items = [(d, brute_fingerprint(r.text)) for d, r in sorted(before.items())]
            assert set(after) == set(brute_components(items))
        docs, before = out, after


def test_run_is_the_stages_in_a_row(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 50 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


@pytest.mark.parametrize("name", ["op4_rule_cascade", "op13_prefix_free_phrases"])
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    found = __spark_entry__.queries()[name](spark, sf)
    assert sorted(found.columns) == sorted(columns)
    got = found.select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
