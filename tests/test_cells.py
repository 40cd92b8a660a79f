"""The versioned store of score cells against rescans of all rows."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from sievecrest.operators import metrics as M
from sievecrest.operators.cells import CellStore

BY = ["run", "dataset"]


def rows_of(spark, runs, seed=3, n=120):
    rnd = random.Random(seed)
    out = []
    for run in runs:
        for _ in range(n):
            score = rnd.choice([None, 0.0, 0.5, 1.0, *[i / 16 for i in range(1, 16)]])
            out.append((run, rnd.choice(["x", "y"]), score, rnd.choice([0, 1, 1, None])))
    return spark.createDataFrame(out, "run string, dataset string, prob double, label int")


def same(a, b):
    key = lambda r: tuple("" if v is None else str(v) for v in r[:2])
    left, right = sorted(a.collect(), key=key), sorted(b.select(*a.columns).collect(), key=key)
    assert len(left) == len(right)
    for l, r in zip(left, right):
        for u, v in zip(l, r):
            assert u == (pytest.approx(v) if isinstance(v, float) else v)


@pytest.fixture
def store(spark, tmp_path):
    return CellStore(spark, str(tmp_path / "cells"), BY)


def add(store, rows, batch):
    return store.add(rows, "prob", "label", batch)


def test_figures_equal_a_rescan(spark, store):
    old, new = rows_of(spark, ["a", "b"]), rows_of(spark, ["c", "b"], seed=4)
    assert (add(store, old, "first"), add(store, new, "second")) == (1, 2)
    for version, rows in ((1, old), (None, old.unionByName(new))):
        same(M.eval_summary(rows, "prob", "label", BY), store.summary(version))
        same(M.best_threshold(rows, "prob", "label", BY), store.best_threshold(version))
        same(M.best_threshold(rows, "prob", "label", BY, start=0.0), store.best_threshold(version, start=0.0))
        same(M.exact_percentiles(rows, "prob", [0.1, 0.5, 0.9], BY), store.percentiles([0.1, 0.5, 0.9], version))
        same(M.distribution_report(rows, "prob", BY), store.distribution(version))
        same(M.unscored_rows(rows, "prob", BY), store.unscored(version))


def test_no_groups_and_null_groups(spark, tmp_path):
    rows = rows_of(spark, ["a", None])
    whole = CellStore(spark, str(tmp_path / "whole"))
    whole.add(rows, "prob", "label", "all")
    same(M.distribution_report(rows, "prob"), whole.distribution())
    same(M.best_threshold(rows, "prob", "label"), whole.best_threshold())
    split = CellStore(spark, str(tmp_path / "split"), ["run"])
    split.add(rows, "prob", "label", "all")
    assert {r.run: r.n for r in split.cells().groupBy("run").agg(F.sum("n").alias("n")).collect()} == {
        r.run: r.n for r in rows.where("prob is not null").groupBy("run").agg(F.count("*").alias("n")).collect()
    }


def test_adding_reads_no_earlier_part_and_repeats_are_skipped(spark, store, tmp_path):
    first, second = rows_of(spark, ["a"]), rows_of(spark, ["b"], seed=9)
    add(store, first, "a")
    kept = shutil.move(str(tmp_path / "cells/parts/a"), str(tmp_path / "away"))
    assert add(store, second, "b") == 2
    shutil.move(kept, str(tmp_path / "cells/parts/a"))
    before = sorted(map(tuple, store.cells().collect()))
    assert add(store, second, "b") == 2 and add(store, first.limit(0), "a") == 1
    assert sorted(map(tuple, store.cells().collect())) == before
    with pytest.raises(ValueError, match="merged as"):
        store.retract(second, "prob", "label", "b")


def test_a_part_without_a_log_entry_is_written_again(spark, store, tmp_path):
    rows_of(spark, ["junk"]).withColumn("score", F.lit(0.5)).write.parquet(str(tmp_path / "cells/parts/a"))
    assert store.version() == 0 and add(store, rows_of(spark, ["a"]), "a") == 1
    assert {r.run for r in store.cells().select("run").distinct().collect()} == {"a"}


def test_retract_and_compact(spark, store):
    right, wrong = rows_of(spark, ["a"]), rows_of(spark, ["a"], seed=8)
    add(store, right, "a")
    add(store, wrong, "a.wrong")
    store.retract(wrong, "prob", "label", "a.undo")
    same(M.eval_summary(right, "prob", "label", BY), store.summary())
    before = sorted(map(tuple, store.cells(2).collect()))
    assert store.compact() == 4 and store.parts() == ["compact-4"] and len(store.parts(3)) == 3
    same(M.eval_summary(right, "prob", "label", BY), store.summary())
    assert sorted(map(tuple, store.cells(2).collect())) == before
    assert add(store, rows_of(spark, ["b"]), "b") == 5 and store.parts() == ["compact-4", "b"]
    store.retract(wrong, "prob", "label", "again")
    with pytest.raises(Exception, match="had not been added"):
        store.cells().collect()


def test_two_writers_take_two_versions(spark, store):
    add(store, rows_of(spark, ["a"]), "a")
    other = CellStore(spark, store.root, BY)
    assert not other._commit(1, "z", "add")
    read = other.version
    other.version = lambda: 0  # what it saw before the first writer came
    assert other.add(rows_of(spark, ["b"]), "prob", "label", "b") == 2
    assert read() == 2 and store.parts() == ["a", "b"]


def test_names_and_empty_stores(spark, store):
    for name in ("", "../a", "a/b", "compact-1"):
        with pytest.raises(ValueError):
            add(store, rows_of(spark, ["a"]), name)
    with pytest.raises(ValueError, match="nothing was added"):
        store.cells()
    add(store, rows_of(spark, ["a"]).limit(0), "none")
    assert store.cells().count() == 0 and store.summary().count() == 0


def test_a_stream_merges_every_batch_once(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    rows = rows_of(spark, ["a"])
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    assert store.follow(stream, "prob", "label", checkpoint) == 1
    more = rows_of(spark, ["b"], seed=5)
    more.write.mode("append").parquet(source)
    assert store.follow(stream, "prob", "label", checkpoint) == 2
    assert add(store, more, "stream-1") == 2  # the batch comes again
    same(M.eval_summary(rows.unionByName(more), "prob", "label", BY), store.summary())
