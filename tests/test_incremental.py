"""Incremental scoring: one evaluation a batch, ids kept in the state store, batches that can run again."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from sievecrest.streaming import incremental as X


def arrive(spark, src, low, high):
    spark.range(low, high).withColumn("v", F.col("id") % 3).coalesce(1).write.mode("append").parquet(src)


def rows_of(df):
    return sorted((r.id, r.p, r.status, r.batch) for r in df.collect())


def test_scores_once_keeps_ids_and_replays(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    arrive(spark, src, 0, 10)
    arrive(spark, src, 5, 12)
    schema = spark.read.parquet(src).schema
    calls, rated = [], spark.sparkContext.accumulator(0)

    def model(x):
        rated.add(1)
        return x / 10

    rate = F.udf(model, "double").asNondeterministic()

    def score(df):
        calls.append(1)
        return df.where("v > 0").withColumn("p", rate("v")).select("id", "p")

    def run():
        return rows_of(X.score_new_files(spark, src, schema, out, ck, score))

    first = run()
    assert [r[0] for r in first] == list(range(12)) and [r[0] for r in first if r[2] == "empty"] == [0, 3, 6, 9]
    assert len(calls) == 1 and rated.value == 8
    assert run() == first and len(calls) == 1  # nothing new, nothing done

    # The first batch's output is gone: the next batch needs none of it, and its ids stay known.
    shutil.rmtree(f"{out}/batch=0")
    arrive(spark, src, 8, 15)
    second = run()
    assert [r[0] for r in second] == [12, 13, 14] and {r[3] for r in second} == {1}
    assert len(calls) == 2 and rated.value == 8 + 2

    # A batch whose commit is lost runs again and gives the same rows.
    for name in glob.glob(f"{ck}/commits/1") + glob.glob(f"{ck}/commits/.1.*"):
        os.remove(name)
    assert run() == second and len(calls) == 3

    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != X.ROCKSDB
