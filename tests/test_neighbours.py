"""Exact neighbours against NumPy, over several grid shapes, and the evidence tables."""

import tracemalloc

import numpy as np
import pytest

from sievecrest.operators import neighbours as N

rng = np.random.default_rng(4)
VEC = rng.normal(size=(120, 6))
VEC[50] = VEC[10]  # equal similarities are settled by id


def frames(spark):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(VEC)], "sample_id bigint, embedding array<double>")
    return df.where("sample_id < 30"), df.where("sample_id >= 8")


@pytest.mark.parametrize("cell", [16384, 16, 7])
def test_grid_cells_do_not_change_the_result(spark, cell):
    q, r = frames(spark)
    got = {(e["query_id"], e["rank"]): e["ref_id"] for e in N.cosine_knn(q, r, 5, cell_rows=cell).collect()}
    unit = VEC / np.linalg.norm(VEC, axis=1, keepdims=True)
    for i in range(30):
        sims = np.round(unit[i] @ unit[8:].T, 12)
        order = np.lexsort((np.arange(8, 120), -sims))[:5] + 8
        assert [got[(i, k + 1)] for k in range(5)] == order.tolist()


def test_fewer_references_than_k(spark):
    q, r = frames(spark)
    assert N.cosine_knn(q.where("sample_id < 3"), r.where("sample_id >= 118"), 5).count() == 6


def test_string_ids(spark):
    q, r = frames(spark)
    s = q.selectExpr("concat('q', sample_id) AS sample_id", "embedding")
    t = r.selectExpr("concat('r', sample_id) AS sample_id", "embedding")
    assert N.cosine_knn(s, t, 3).where("rank = 1").count() == 30


def test_evidence_is_null_without_neighbours_of_a_source(spark):
    edges = spark.createDataFrame(
        [(1, 1, 7, 0.9, 1, "train"), (1, 2, 8, 0.8, 0, "train")], "query_id int, rank int, ref_id int, cosine_sim double, ref_label int, ref_source string"
    )
    row = N.neighbour_evidence(edges, ["train", "myval"]).first()
    assert row["myval_top10_pos_frac"] is None and row["train_top10_pos_frac"] == 0.5 and row["top10_myval_pos"] == 0


def test_conflicts_without_labelled_neighbours_are_zero_share(spark):
    edges = spark.createDataFrame(
        [(1, 1, 7, 0.5, None, "test", 1)], "query_id int, rank int, ref_id int, cosine_sim double, ref_label int, ref_source string, query_label int"
    )
    row = N.label_conflicts(edges, ["train"]).first()
    assert row["top10_same_label_frac"] == 0.0 and row["top1_label"] == -1 and row["conflict_score"] == pytest.approx(5.0)


def test_approx_neighbours_are_a_subset_of_exact_ones_above_the_cut(spark):
    q, r = frames(spark)
    exact = {(e["query_id"], e["ref_id"]) for e in N.cosine_knn(q, r, 112).where("cosine_sim >= 0.79").collect()}
    near = {(e["query_id"], e["ref_id"]) for e in N.approx_knn(q, r, 112, 0.8).collect()}
    assert near and near <= exact


def test_copies_in_the_approximate_join(spark):
    """A third of the references are one vector: results equal exact ones and rank by id."""
    df = spark.createDataFrame(
        [(i, [1.0, 0.0] if i % 3 == 0 else [float(i % 7 + 1), float(i % 5)]) for i in range(90)], "sample_id bigint, embedding array<double>"
    )
    near = {(e["query_id"], e["rank"]): e["ref_id"] for e in N.approx_knn(df, df, 4, 0.9999).collect()}
    exact = {(e["query_id"], e["rank"]): e["ref_id"] for e in N.cosine_knn(df, df, 4).collect()}
    assert [near[(0, k)] for k in range(1, 5)] == [exact[(0, k)] for k in range(1, 5)] == [0, 3, 5, 6]


def clustered(seed, n=1500, dims=24, spread=0.12):
    """A third of the vectors crowd round one centre, all distinct; the rest are far apart or near pairs."""
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, dims))
    x[: n // 3] = rnd.standard_normal(dims) + spread * rnd.standard_normal((n // 3, dims))
    x[-n // 6 :] = x[-n // 3 : -n // 6] + 0.05 * rnd.standard_normal((n // 6, dims))
    return x


def as_rows(spark, x, kind="bigint"):
    ids = [i if kind == "bigint" else f"v{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"sample_id {kind}, embedding array<double>")


@pytest.mark.parametrize("cell_rows", [60, 4096])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hot_buckets_lose_no_neighbours(spark, cell_rows, kind):
    x = clustered(3)
    df = as_rows(spark, x, kind).repartition(5)
    exact = N.cosine_knn(df, df, 8).where("cosine_sim >= 0.9").cache()
    near = N.approx_knn(df, df, 8, 0.9, cell_rows=cell_rows).cache()
    report = N.neighbour_recall(near, exact).first()
    assert report.expected > 4000 and report.recall >= 0.98
    counted = near.groupBy("query_id").count()
    assert counted.where("count > 8").isEmpty() and counted.count() == len(x)
    # Where an answer is complete it is the exact one, ranks and similarities included.
    both = near.join(exact, ["query_id", "rank", "ref_id"])
    assert both.count() >= 0.97 * report.expected
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    number = {r.sample_id: i for i, r in enumerate(df.orderBy("sample_id").collect())}
    for e in near.limit(300).collect():
        assert e.cosine_sim == pytest.approx(unit[number[e.query_id]] @ unit[number[e.ref_id]], abs=1e-11)


def test_cells_stay_small_and_cover_each_pair_once(spark):
    """A hot bucket becomes cells of bounded size; rows of several hot buckets are compared once."""
    rnd = np.random.default_rng(1)
    left = spark.createDataFrame([(i, [[7, 9][int(i % 4 == 0)], 5]) for i in range(900)], "l bigint, _keys array<bigint>")
    right = spark.createDataFrame([(i, [int(rnd.choice([7, 9])), 5 if i < 400 else 6]) for i in range(500)], "r bigint, _keys array<bigint>")
    hot = spark.createDataFrame([(0, 7, 1), (0, 9, 2), (1, 5, 3)], "_no int, _key bigint, _hot bigint")
    l, r, blocks = N.hot_grid(left, right, hot, 50)
    cells = l.groupBy(*N._CELL).count().union(r.groupBy(*N._CELL).count())
    assert cells.agg({"count": "max"}).first()[0] < 110
    met = l.join(r, list(N._CELL)).select("l", "r")
    want = left.selectExpr("l", "posexplode(_keys) AS (no, key)").join(right.selectExpr("r", "posexplode(_keys) AS (no, key)"), ["no", "key"])
    want = want.select("l", "r").distinct()
    assert met.count() == met.distinct().count() and want.join(met, ["l", "r"], "left_anti").isEmpty()
    assert blocks.count() == 4


def test_top_k_of_a_block_keeps_ties_by_position():
    q = np.array([[1.0, 0.0]])
    r = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.6, 0.8], [1.0, 0.0]])
    got = N._block_top_k(q, r, 2, 0.5)
    assert got[1].tolist() == [1, 2] and N._block_top_k(q, r, 9, 0.5)[1].tolist() == [1, 2, 4, 3]
    assert len(N._block_top_k(q, r[:1], 1, 0.5)[0]) == 0


def test_approximate_neighbours_of_nothing(spark):
    df = as_rows(spark, clustered(1, 12))
    assert N.approx_knn(df, df.limit(0), 3, 0.9).count() == 0
    assert N.approx_knn(df.limit(0), df, 3, 0.9).count() == 0


def test_buckets_move_rows_once_a_tile_not_once_a_table(spark, monkeypatch):
    """Rows enter no shuffle of their own a table while a grid moves fewer copies; hot buckets add none."""
    x = clustered(5, 600)
    df = as_rows(spark, x)
    monkeypatch.setattr(N, "_laid_cells", lambda *_: pytest.fail("buckets laid out table by table"))
    near, exact = N.approx_knn(df, df, 8, 0.9, cell_rows=20), N.cosine_knn(df, df, 8).where("cosine_sim >= 0.9")
    assert N.neighbour_recall(near, exact).first().recall >= 0.98
    cells = N._grid_cells(df.selectExpr("sample_id AS l", "embedding AS u"), df.selectExpr("sample_id AS r", "embedding AS u"), 2, 3)
    assert cells.count() == 600 * 3 + 600 * 2


def test_a_cell_holds_few_similarities_at_a_time(monkeypatch):
    """Blocks shrink with the references, so a cell's memory does not grow with the product of its sides."""
    sizes = []
    partition = np.partition
    monkeypatch.setattr(N.np, "partition", lambda a, *args, **named: sizes.append(a.size) or partition(a, *args, **named))
    x = np.random.default_rng(2).standard_normal((9000, 4))
    q, r, _ = N._block_top_k(x[:1500], x, 3, -np.inf)
    assert max(sizes) <= N.BLOCK_PAIRS and np.bincount(q).tolist() == [3] * 1500 and (r[::3] == np.argmax(x[:1500] @ x.T, axis=1)).all()


def test_a_crowd_of_copies_is_not_listed_pair_by_pair():
    """Each query ties with all references: the first ``k`` by position remain, in the memory of a block without ties."""
    x = np.random.default_rng(4).standard_normal((3, 8))
    refs = np.repeat(x / np.linalg.norm(x, axis=1, keepdims=True), [9, 20000, 7], axis=0)
    tracemalloc.start()
    try:
        q, r, sim = N._block_top_k(np.repeat(refs[9:10], 200, axis=0), refs, 5, -np.inf)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert r.tolist() == list(range(9, 14)) * 200 and q.tolist() == np.repeat(np.arange(200), 5).tolist() and set(sim) == {1.0}
    assert peak < 3 * 200 * len(refs) * 8
    assert N._block_top_k(refs[:1], refs, 20020, -np.inf)[1].tolist()[:9] == list(range(9)) and len(N._block_top_k(refs[:1], refs, N.ALL, 0.999)[0]) >= 9
