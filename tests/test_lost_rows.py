"""Inputs that once lost rows: nulls in keys and scores, wide match rules, long lists."""

import os

import pytest
from pyspark.sql import functions as F

from sievecrest.operators import dedup as D
from sievecrest.operators import metrics as M
from sievecrest.operators import neighbours as N
from sievecrest.operators import ordering as O
from sievecrest.operators import splits as SP
from sievecrest.plans import audits as A
from sievecrest.session import cut_lineage, drop_scratch, scratch_path
from sievecrest.sources import writers as WR


def test_group_split_keeps_null_groups_and_labels(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 3, F.col("id") % 2).alias("y"), F.when(F.col("id") % 5 != 0, F.col("id") % 20).alias("g"))
    got = SP.stratified_group_split(df, "y", "g", 0.3, 1)
    assert got.count() == 100 and got.where("role IS NULL").count() == 0
    assert got.groupBy("y", "g").agg(F.count_distinct("role").alias("n")).where("n > 1").count() == 0


def hashes(spark, rows):
    full = [(i, 0, d, p, 0, digest, [1.0, -1.0, 1.0]) for i, d, p, digest in rows]
    return spark.createDataFrame(full, "idx bigint, ahash bigint, dhash bigint, phash bigint, chash bigint, digest string, feature array<double>")


def test_rows_without_a_digest_stay(spark):
    df = hashes(spark, [(i, (i * 0x9E3779B97F4A7C15) % 2**62, (i * 0xC2B2AE3D27D4EB4F) % 2**62, None if i % 5 == 0 else f"d{i}") for i in range(50)])
    assert D.deduplicate(df).count() == 50


def test_a_strict_rule_wider_than_the_loose_one_loses_no_pair(spark):
    nine = sum(1 << b for b in range(0, 63, 7))  # nine bits, one in each of nine slices
    df = hashes(spark, [(1, 0, 1, "a"), (2, nine, 1, "b")])
    got = D.hash_pairs(df, df, strict=9, loose=8).collect()
    assert [(r.later_idx, r.earlier_idx) for r in got] == [(2, 1)]


def test_null_scores_are_no_thresholds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (None, 1), (None, 1)], "s double, y int")
    best = M.best_threshold(df, "s", "y").first()
    assert (best.threshold, best.best_f1) == (0.5, 1.0) and M.unscored_rows(df, "s").first().unscored == 2


def test_null_vectors_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.1])], "sample_id int, embedding array<double>")
    assert {(r.query_id, r.ref_id) for r in N.cosine_knn(df, df, 5).collect()} == {(a, b) for a in (1, 3) for b in (1, 3)}
    assert {r.query_id for r in N.approx_knn(df, df, 5, 0.9).collect()} == {1, 3}


def test_rule_ids_are_complete_and_ordered(spark):
    df = spark.range(1000).select("id", (1000 - F.col("id")).alias("verifier_rank"))
    got = A.rule_ids(df, {"all": F.lit(True), "none": F.lit(False), "even": F.col("id") % 2 == 0})
    rows = got.orderBy("rule", "place").collect()
    assert [(r.place, r.id) for r in rows if r.rule == "all"] == [(i + 1, 999 - i) for i in range(1000)]
    assert [(r.place, r.id) for r in rows if r.rule == "even"] == [(i + 1, 998 - 2 * i) for i in range(500)]


def test_a_summary_of_two_rows_is_an_error(spark, tmp_path):
    WR.write_summary(spark.range(1), str(tmp_path / "one"))
    assert spark.read.json(str(tmp_path / "one")).count() == 1
    with pytest.raises(ValueError):
        WR.write_summary(spark.range(2), str(tmp_path / "two"))


def test_histogram_has_every_bin_and_the_edges_of_its_definition(spark):
    df = spark.createDataFrame([(0.58,), (0.0,), (1.0,), (0.02,)], "v double")
    got = {r.bin: r["count"] for r in M.histogram(df, "v").collect()}
    assert len(got) == 50 and {b for b, n in got.items() if n} == {29, 0, 49, 1}


def test_range_layouts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 500)
    df = cut_lineage(spark.range(20_000).select("id", F.when(F.col("id") % 10 != 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 20_011).alias("v")))
    laid = O.range_layout(df, [F.col("g"), F.col("v")])
    assert laid.groupBy("_part").count().agg(F.max("count")).first()[0] <= 2 * 500
    got = O.running_totals(df.withColumn("one", F.lit(1)), "v", ["one"], ["g"], descending=False)
    want = {r.id: r.n for r in df.selectExpr("id", "row_number() OVER (PARTITION BY g ORDER BY v) AS n").collect()}
    assert {r.id: r.cum_one for r in got.collect()} == want


def test_scratch_is_below_the_shared_folder_and_can_be_dropped(spark):
    path = scratch_path(spark, "kept")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and drop_scratch(spark) > 0 and not os.path.exists(local)
