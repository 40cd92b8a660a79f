"""Split invariants: disjoint, complete, balanced, deterministic."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievecrest.operators import splits as S
from sievecrest.operators.ordering import seeded_row_number


def frame(spark, n=500):
    return spark.createDataFrame([(i, int(i % 5 == 0), f"g{i % 17}") for i in range(n)], "id int, label int, g string")


def test_seeded_row_number_is_md5_order(spark):
    df = frame(spark)
    got = [r["id"] for r in seeded_row_number(df, "id", 3).orderBy("rn").collect()]
    assert got == sorted(range(500), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())


def test_split_sizes_and_single_row_class(spark):
    df = frame(spark).union(spark.createDataFrame([(999, 7, "z")], "id int, label int, g string"))
    out = S.stratified_split(df, "id", "label", 0.25, 1)
    got = {(r["label"], r["role"]): r["n"] for r in out.groupBy("label", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, "val"): 100, (0, "train"): 300, (1, "val"): 25, (1, "train"): 75, (7, "train"): 1}


def test_ratio_is_checked(spark):
    with pytest.raises(ValueError):
        S.stratified_split(frame(spark), "id", "label", 1.0, 1)


def test_kfold_sizes_differ_by_one_and_roles_cover(spark):
    folds = S.stratified_kfold(frame(spark, 503), "id", "label", 5, 9)
    sizes = {}
    for r in folds.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in sizes.values())
    roles = S.fold_roles(folds, 5)
    assert roles.count() == 503 * 5
    assert roles.where("role = 'val'").select("id").distinct().count() == 503


def test_group_split_keeps_groups_whole_even_above_target(spark):
    rows = [(i, 0, "huge") for i in range(90)] + [(100 + i, 0, f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, label int, g string")
    out = S.stratified_group_split(df, "label", "g", 0.2, 4)
    assert out.groupBy("g").agg(F.count_distinct("role").alias("r")).where("r > 1").count() == 0
    assert out.where("role = 'val'").count() >= 20
    single = spark.createDataFrame([(1, 0, "a"), (2, 0, "a")], "id int, label int, g string")
    with pytest.raises(Exception, match="two groups"):
        S.stratified_group_split(single, "label", "g", 0.5, 1, strict=True).collect()


def test_rebalance_both_ways(spark):
    df = frame(spark)  # 400 negatives, 100 positives
    low = S.rebalance_to_ratio(df, "id", "label", 2.0, 1)
    assert (low.where("label = 0").count(), low.where("label = 1").count()) == (200, 100)
    high = S.rebalance_to_ratio(df, "id", "label", 8.0, 1)
    assert (high.where("label = 0").count(), high.where("label = 1").count()) == (400, 50)


def test_takes_are_bounded_and_unique(spark):
    df = frame(spark).withColumn("s", (F.col("id") * 37 % 501) / 501)
    df = df.withColumn("c", F.col("id") % 9).withColumn("f", (F.col("id") % 9) / 9)
    out = S.stratified_take(df, "id", "label", "s", 60)
    assert out.count() == 60 and out.select("id").distinct().count() == 60
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}[1] >= 30
    spread = S.cluster_stratified_take(df, "id", "label", "s", "c", "f", 60)
    assert spread.count() == 60 and spread.select("id").distinct().count() == 60
    assert S.stratified_take(df, "id", "label", "s", 10_000).count() == 500


def test_parse_folds():
    assert S.parse_folds("", 3) == [1, 2, 3]
    assert S.parse_folds("3, 1,3", 3) == [1, 3]
    with pytest.raises(ValueError):
        S.parse_folds("4", 3)


def test_large_top_per_group_uses_salts_and_stays_exact(spark):
    from sievecrest.operators.ordering import running_max, top_per_group

    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 6007).alias("s"))
    got = top_per_group(df, ["g"], [F.col("s").desc(), F.col("id").asc()], 1500, "id").toPandas()
    for g, part in df.toPandas().groupby("g"):
        want = part.sort_values(["s", "id"], ascending=[False, True])["id"].head(1500).tolist()
        assert got[got.g == g].sort_values("rank")["id"].tolist() == want
    seen = running_max(df, "id", "s", ["g"]).toPandas().sort_values("id")
    for _, part in seen.groupby("g"):
        want = part["s"].cummax().shift()
        assert part["best_before"].iloc[1:].tolist() == want.iloc[1:].tolist() and part["best_before"].isna().iloc[0]


def test_argument_checks(spark):
    from sievecrest.operators import checks as C

    with pytest.raises(ValueError, match="missing required"):
        C.require_columns(frame(spark), ["id", "nope"])
    with pytest.raises(ValueError):
        C.require_range("x", 1.0, 0.0, 1.0, open_ends=True)
    with pytest.raises(Exception, match="bad label"):
        C.fail_unless(frame(spark), F.col("label") == 0, "bad label").collect()
