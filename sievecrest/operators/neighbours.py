"""Exact and approximate cosine neighbours, and the evidence tables built on neighbour edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecrest.functions.vectors import dot, l2_normalise, norm
from sievecrest.operators.ordering import top_per_group
from sievecrest.session import cut_lineage

CELL_ROWS = 32768
TILE_ROWS = 65536
BLOCK_PAIRS = 1 << 22
MAX_TASKS = 20000
BUCKET_ROWS = 4096
TASK_PAIRS = 500_000_000
ALL = 1 << 62


def _grid(n_queries: int, n_refs: int, cell_rows: int, parallelism: int) -> tuple[int, int]:
    """Rows and columns of the comparison grid.

    A grid cell never holds more than about ``cell_rows`` queries and references, and small inputs
    are still cut into enough cells to use the cores, the longer side first, down to a size where a
    task is worth starting.
    """
    rows = max(1, math.ceil(n_queries / cell_rows))
    cols = max(1, math.ceil(n_refs / cell_rows))
    while rows * cols < parallelism and max(n_queries / rows, n_refs / cols) > 2048:
        if n_refs / cols >= n_queries / rows:
            cols += 1
        else:
            rows += 1
    return rows, cols


def _grid_cells(left: DataFrame, right: DataFrame, rows: int, cols: int) -> DataFrame:
    """Rows (l, u) and (r, u) dealt by the hash of their ids to a grid, one partition a cell: (cell columns, l, r, u)."""

    def side(df: DataFrame, name: str, other: DataFrame) -> DataFrame:
        no_other = F.lit(None).cast(other.schema["r" if name == "l" else "l"].dataType)
        ids = [F.col("l"), no_other.alias("r")] if name == "l" else [no_other.alias("l"), F.col("r")]
        own, n, across = ("_c1", rows, cols) if name == "l" else ("_c2", cols, rows)
        dealt = df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n))).withColumn(
            "_c2" if name == "l" else "_c1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))
        )
        none = F.lit(0).cast("long")
        return dealt.select("_c1", "_c2", none.alias("_c3"), none.alias("_c4"), *ids, "u")

    cells = side(left, "l", right).unionByName(side(right, "r", left))
    return cells.repartitionById(rows * cols, (F.col("_c1") * cols + F.col("_c2")).cast("int"))


def cosine_knn(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    id_col: str = "sample_id",
    vector: str = "embedding",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Exact top-``k`` references of every query: (query_id, rank, ref_id, cosine_sim).

    Queries and references are hashed to the rows and columns of a grid and each grid cell is one
    block product in NumPy that emits only its own top ``k`` per query; a limit-aware window merges
    the cells. Rows without a vector have no neighbours and are none; vectors of another
    length than most are an error of the caller. Cells hash on the id, so a hot label, source or copy group spreads
    over all of them. A task holds the vectors of one cell, at most about ``cell_rows`` a side, and
    ``BLOCK_PAIRS`` similarities at a time; no pair list is ever produced.
    Equal similarities (to 12 digits) rank by reference id.
    """
    spark = queries.sparkSession
    queries, refs = queries.where(F.col(vector).isNotNull()), refs.where(F.col(vector).isNotNull())
    rows, cols = _grid(queries.count(), refs.count(), cell_rows, spark.sparkContext.defaultParallelism)
    q = queries.select(F.col(id_col).alias("l"), l2_normalise(F.col(vector)).alias("u"))
    r = refs.select(F.col(id_col).alias("r"), l2_normalise(F.col(vector)).alias("u"))
    parts = cell_neighbours(_grid_cells(q, r, rows, cols), lambda a, b: _block_top_k(a, b, k, -math.inf))
    best = Window.partitionBy("l").orderBy(F.col("cosine_sim").desc(), F.col("r"))
    ranked = parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("l").alias("query_id"), "rank", F.col("r").alias("ref_id"), "cosine_sim")


def sign_tables(n_refs: int, min_sim: float, miss: float = 0.01) -> tuple[int, int]:
    """Bits a table and tables, so that random vectors rarely meet and a pair at ``min_sim`` is missed with ``miss``.

    Two vectors at angle a agree in the sign of a random projection with probability 1 - a / pi. Bits
    grow with the number of references, about 64 random ones to a bucket.
    """
    bits = min(48, max(8, math.ceil(math.log2(max(1, n_refs) / 64))))
    together = (1.0 - math.acos(min_sim) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1.0 - together))))


def _sign_keys(dims: int, bits: int, tables: int, seed: int):
    planes = np.random.default_rng(seed).standard_normal((dims, bits * tables))
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def keys(vectors: pd.Series) -> pd.Series:
        above = np.stack(vectors.to_numpy()) @ planes > 0
        return pd.Series(list(above.reshape(-1, tables, bits) @ weights))

    return keys


_CELL = ("_c1", "_c2", "_c3", "_c4")


def _bucket_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_no, _key, nl, nr) of the buckets that both sides enter."""

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.posexplode("_keys").alias("_no", "_key")).groupBy("_no", "_key").agg(F.count(F.lit(1)).alias(name))

    return sizes(left, "nl").join(sizes(right, "nr"), ["_no", "_key"])


def _hot_homes(rows: DataFrame, hot: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, _home): rows of hot buckets under the least of their hot buckets, and (_hot, _home): homes met in each."""
    member = rows.select(name, F.posexplode("_keys").alias("_no", "_key")).join(hot, ["_no", "_key"]).select(name, "_hot")
    homes = member.groupBy(name).agg(F.min("_hot").alias("_home"))
    met = member.join(homes, name).select("_hot", "_home").distinct()
    return cut_lineage(homes), cut_lineage(met)


def hot_grid(left: DataFrame, right: DataFrame, hot: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells for the rows of hot buckets: left and right ids with their cell, and the blocks cut into cells.

    Every row lives in one home, the least of the hot buckets it lies in, so the homes of a side are
    disjoint. Two homes are compared when some hot bucket holds rows of both: all pairs of all hot
    buckets lie in such blocks, and each pair in one block only, in however many tables it meets. A
    block is cut into a grid of cells of about ``cell_rows`` rows a side.
    """
    l_home, l_met = _hot_homes(left, hot, "l")
    r_home, r_met = _hot_homes(right, hot, "r")
    blocks = l_met.withColumnRenamed("_home", "_hl").join(r_met.withColumnRenamed("_home", "_hr"), "_hot").select("_hl", "_hr").distinct()
    count = F.count(F.lit(1))
    n_l = l_home.groupBy(F.col("_home").alias("_hl")).agg(count.alias("nl"))
    n_r = r_home.groupBy(F.col("_home").alias("_hr")).agg(count.alias("nr"))
    side = F.lit(cell_rows)
    blocks = cut_lineage(
        blocks.join(n_l, "_hl").join(n_r, "_hr")
        .withColumn("_rows", F.ceil(F.col("nl") / side)).withColumn("_cols", F.ceil(F.col("nr") / side))
    )
    spread_l = l_home.withColumnRenamed("_home", "_hl").join(blocks, "_hl").select(
        "l", F.col("_hl").alias("_c1"), F.col("_hr").alias("_c2"), F.pmod(F.xxhash64("l"), F.col("_rows")).alias("_c3"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1)).alias("_c4"),
    )
    spread_r = r_home.withColumnRenamed("_home", "_hr").join(blocks, "_hr").select(
        "r", F.col("_hl").alias("_c1"), F.col("_hr").alias("_c2"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)).alias("_c3"), F.pmod(F.xxhash64("r"), F.col("_cols")).alias("_c4"),
    )
    return spread_l, spread_r, blocks


def _block_top_k(queries: np.ndarray, refs: np.ndarray, k: int, min_sim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, similarity): up to ``k`` references of every query at ``min_sim`` or above.

    Equal similarities (to 12 digits) rank by position; ``refs`` come in the order of their ids. A query
    that ties with a crowd of copies is cut to its first ``k`` before pairs are listed.
    """
    found = []
    step = max(1, BLOCK_PAIRS // len(refs))
    for start in range(0, len(queries), step):
        sims = queries[start : start + step] @ refs.T
        least = np.full((len(sims), 1), min_sim)
        if len(refs) > k:
            np.maximum(least, np.partition(sims, len(refs) - k, axis=1)[:, len(refs) - k, None], out=least)
        near = sims >= least - 2e-12
        for crowded in np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k):
            at = np.flatnonzero(near[crowded])
            first = np.argsort(-np.round(sims[crowded, at], 12), kind="stable")[:k]
            near[crowded] = False
            near[crowded, at[first]] = True
        q, r = np.nonzero(near)
        sim = np.round(sims[q, r], 12)
        real = sim >= min_sim
        q, r, sim = q[real], r[real], sim[real]
        order = np.lexsort((r, -sim, q))
        q, r, sim = q[order], r[order], sim[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((q[nth < k] + start, r[nth < k], sim[nth < k]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy()
    return flat.reshape(len(vectors), len(flat) // len(vectors))


def _laid_cells(cells: DataFrame, tasks: int) -> DataFrame:
    return cells.repartition(tasks, *[F.col(c) for c in _CELL])


def cell_neighbours(cells: DataFrame, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(l, r, cosine_sim): what ``near`` finds inside every cell, as positions and similarities.

    ``cells`` has the four cell columns, l (null for a right row), r (null for a left row) and u, and
    the rows of a cell in one partition. One cell at a time is held, as two matrices; right rows come
    in the order of their ids.
    """
    laid = cells.sortWithinPartitions(*[F.col(c) for c in _CELL], F.col("l").isNull(), "r")

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        n = len(table) - table.column("l").null_count
        if not 0 < n < len(table):
            return None
        vectors = table.column("u").chunk(0)
        q, r, sim = near(_matrix(vectors.slice(0, n)), _matrix(vectors.slice(n)))
        ids = [table.column("l").chunk(0).take(pa.array(q)), table.column("r").chunk(0).take(pa.array(r + n))]
        return pa.RecordBatch.from_arrays([*ids, pa.array(sim)], ["l", "r", "cosine_sim"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(keys[a].tolist()) if b > a else last
                if held and key != last and (out := joined(held)) is not None:
                    yield out
                held = held + [batch.slice(a, b - a)] if key == last else [batch.slice(a, b - a)]
                last = key
        if held and (out := joined(held)) is not None:
            yield out

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    return laid.mapInArrow(work, f"l {types['l']}, r {types['r']}, cosine_sim double")


def bucket_neighbours(
    left: DataFrame, right: DataFrame, k: int, min_sim: float, seed: int = 11, cell_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(l, r, cosine_sim): up to ``k`` references r of each (l, u) row among the (r, u) rows that share a bucket.

    Rows go the way that moves fewer of their copies. While a grid of tiles of ``TILE_ROWS`` rows a side
    takes no more copies than the tables, buckets are formed inside the tiles (``tile_neighbours``).
    For more rows, and where all pairs are wanted, they are formed by a shuffle of every table:
    a bucket of at most ``cell_rows`` rows a side is one cell; its rows are moved once a table. Larger
    buckets are hot: their rows leave the tables and are compared in the grid of ``hot_grid``, once
    whatever the number of tables. No cell compares more than about ``cell_rows`` squared pairs, a task
    about ``TASK_PAIRS``, and none emits more than ``k`` pairs a query; no pair list is made.
    """
    spark = left.sparkSession
    first = right.select(F.size("u").alias("n")).first() or left.select(F.size("u").alias("n")).first()
    dims, n_refs = first["n"] if first else 1, right.count()
    bits, tables = sign_tables(n_refs, min_sim)
    rows, cols = _grid(left.count(), n_refs, TILE_ROWS, spark.sparkContext.defaultParallelism)
    if k < ALL and rows + cols <= 2 * tables:
        return tile_neighbours(left, right, k, min_sim, rows, cols, *sign_tables(n_refs // cols, min_sim), dims, seed)
    keys = _sign_keys(dims, bits, tables, seed)
    left, right = (cut_lineage(df.select(name, "u", keys("u").alias("_keys"))) for df, name in ((left, "l"), (right, "r")))
    buckets = cut_lineage(_bucket_sizes(left, right))
    is_hot = F.greatest("nl", "nr") > cell_rows
    hot = cut_lineage(buckets.where(is_hot).select("_no", "_key", F.monotonically_increasing_id().alias("_hot")))
    spread_l, spread_r, blocks = hot_grid(left, right, hot, cell_rows)

    def cells(rows: DataFrame, name: str, other: DataFrame, spread: DataFrame) -> DataFrame:
        no_other = F.lit(None).cast(other.schema["r" if name == "l" else "l"].dataType)
        ids = [F.col("l"), no_other.alias("r")] if name == "l" else [no_other.alias("l"), F.col("r")]
        cold = rows.select(name, "u", F.posexplode("_keys").alias("_no", "_key")).join(hot, ["_no", "_key"], "left_anti").select(
            F.lit(-1).cast("long").alias("_c1"), F.col("_no").cast("long").alias("_c2"), F.col("_key").alias("_c3"),
            F.lit(0).cast("long").alias("_c4"), *ids, "u",
        )
        return cold.unionByName(spread.join(rows, name).select(*_CELL, *ids, "u"))

    both = cells(left, "l", right, spread_l).unionByName(cells(right, "r", left, spread_r))
    pairs = F.sum(F.col("nl") * F.col("nr")).alias("n")
    work = (buckets.where(~is_hot).agg(pairs).first()["n"] or 0) + (blocks.agg(pairs).first()["n"] or 0)
    tasks = min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, math.ceil(work / TASK_PAIRS)))
    near = cell_neighbours(_laid_cells(both, tasks), lambda a, b: _block_top_k(a, b, k, min_sim))
    # A pair that met in several tables was compared in each; digits may differ with the block.
    return near.groupBy("l", "r").agg(F.max("cosine_sim").alias("cosine_sim"))


def _best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` references of every query among ``found``, each pair once."""
    q, r, sim = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((-sim, r, q))
    q, r, sim = q[order], r[order], sim[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
    q, r, sim = q[new], r[new], sim[new]
    order = np.lexsort((r, -sim, q))
    q, r, sim = q[order], r[order], sim[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], r[kept], sim[kept]


def _tile_top_k(
    queries: np.ndarray, refs: np.ndarray, k: int, min_sim: float, planes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` references of every query among those that share a bucket with it in some table of ``planes``.

    ``planes`` is tables x dims x bits. Where the buckets hold as many pairs as the tile, as in a large
    group of near vectors, the tile is compared once instead.
    """
    weights = 1 << np.arange(planes.shape[2], dtype=np.int64)
    size = 1 << planes.shape[2]
    keys = [tuple(((v @ p > 0) @ weights).astype(np.int32) for v in (queries, refs)) for p in planes]
    counts = [tuple(np.bincount(part, minlength=size) for part in pair) for pair in keys]
    if sum(int(a @ b) for a, b in counts) >= len(queries) * len(refs):
        return _block_top_k(queries, refs, k, min_sim)
    none = np.empty(0, np.int64)
    found, held = [(none, none, np.empty(0))], 0
    for (q_keys, r_keys), (n_q, n_r) in zip(keys, counts):
        q_order, r_order = np.argsort(q_keys, kind="stable"), np.argsort(r_keys, kind="stable")
        q_end, r_end = np.cumsum(n_q), np.cumsum(n_r)
        for key in np.flatnonzero((n_q > 0) & (n_r > 0)):
            at_q, at_r = q_order[q_end[key] - n_q[key] : q_end[key]], r_order[r_end[key] - n_r[key] : r_end[key]]
            a, b = queries[at_q], refs[at_r]
            if len(a) * len(b) <= BLOCK_PAIRS and (a @ b.T).max() < min_sim - 2e-12:
                continue
            q, r, sim = _block_top_k(a, b, k, min_sim)
            found.append((at_q[q], at_r[r], sim))
            held += len(q)
        if held > BLOCK_PAIRS:
            found = [_best_of(found, k)]
            held = 0
    return _best_of(found, k)


def tile_neighbours(
    left: DataFrame, right: DataFrame, k: int, min_sim: float, rows: int, cols: int, bits: int, tables: int, dims: int, seed: int
) -> DataFrame:
    """(l, r, cosine_sim) as ``bucket_neighbours``, with the buckets of all tables formed inside the tiles of a grid.

    A left row is moved once a column and a right row once a row of the grid, whatever the number of
    tables and of rows in a bucket.
    """
    planes = np.random.default_rng(seed).standard_normal((tables, dims, bits))
    return cell_neighbours(_grid_cells(left, right, rows, cols), lambda a, b: _tile_top_k(a, b, k, min_sim, planes))


def sign_candidates(left: DataFrame, right: DataFrame, min_sim: float, seed: int = 11) -> DataFrame:
    """(l, r): all pairs of (l, u) and (r, u) rows at ``min_sim`` or above that share a bucket in some table."""
    return bucket_neighbours(left, right, ALL, min_sim, seed).select("l", "r")


def approx_knn(
    queries: DataFrame, refs: DataFrame, k: int, min_sim: float, id_col: str = "sample_id", vector: str = "embedding", seed: int = 11,
    cell_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Neighbours at or above a similarity through sign bits of random projections; reported similarities are exact.

    Copies are settled before candidates are formed. Equal references tie and rank by id, so a vector
    needs only its ``k`` smallest ids; equal queries share one answer. Buckets therefore hold each
    distinct vector once and a group of copies never multiplies with another; a bucket of many distinct
    near vectors is compared in bounded cells (``bucket_neighbours``). Rows without a vector have no
    neighbours.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("query_id"), l2_normalise(F.col(vector)).alias("u"))
    r = refs.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("ref_id"), l2_normalise(F.col(vector)).alias("u"))
    q_first = cut_lineage(q.groupBy("u").agg(F.min("query_id").alias("l")))
    r_ids = cut_lineage(top_per_group(r, ["u"], [F.col("ref_id").asc()], k, "ref_id", "_copy"))
    r_first = r_ids.where(F.col("_copy") == 1).select(F.col("ref_id").alias("r"), "u")
    pairs = bucket_neighbours(q_first, r_first, k, min_sim, seed, cell_rows)
    pairs = top_per_group(pairs, ["l"], [F.col("cosine_sim").desc(), F.col("r").asc()], k, "r", "_near").drop("_near")
    copies = r_ids.join(r_first, "u").select("r", "ref_id")
    best = top_per_group(pairs.join(copies, "r"), ["l"], [F.col("cosine_sim").desc(), F.col("ref_id").asc()], k, "ref_id", "rank")
    owners = q.join(q_first, "u").select("query_id", "l")
    return owners.join(best, "l").select("query_id", "rank", "ref_id", "cosine_sim")


def neighbour_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (expected, found, recall): how many of the exact neighbour pairs an approximate search returned."""
    pair = ["query_id", "ref_id"]
    met = exact.select(*pair).join(found.select(*pair).distinct().withColumn("_hit", F.lit(1)), pair, "left")
    return met.agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found")).withColumn(
        "recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected"))
    )


def with_ref_columns(edges: DataFrame, refs: DataFrame, cols: Sequence[str], id_col: str = "sample_id") -> DataFrame:
    """Attach ``ref_*`` columns to neighbour edges."""
    meta = refs.select(F.col(id_col).alias("ref_id"), *[F.col(c).alias(f"ref_{c}") for c in cols])
    return edges.join(meta, "ref_id")


def centroid_similarity(df: DataFrame, anchors: DataFrame, id_col: str = "sample_id", vector: str = "embedding") -> DataFrame:
    """Cosine of each row to the normalised mean of the (already normalised) anchor vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    centre = anchors.agg(vector_to_array(mean)).scalar()
    out = df.withColumn("_c", centre)
    sim = dot(F.col(vector), F.col("_c")) / (
        F.greatest(norm(F.col(vector)), F.lit(1e-8)) * F.greatest(norm(F.col("_c")), F.lit(1e-8))
    )
    return out.withColumn("centroid_cos", sim).drop("_c")


def test_likeness(edges: DataFrame, k: int) -> DataFrame:
    """Mean and maximum of the top-k similarities to the anchors."""
    return edges.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.avg("cosine_sim").alias("topk_mean"), F.max("cosine_sim").alias("topk_max")
    )


def _share(flag: Column, value: Column) -> Column:
    return F.avg(F.when(flag, value))


def neighbour_evidence(edges: DataFrame, sources: Sequence[str], cuts: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per query: nearest reference, positive shares in the top ranks overall and per source, counts.

    One grouped pass; a share is NULL when no neighbour of that source is inside the cut.
    """
    rank, label, source = F.col("rank"), F.col("ref_label"), F.col("ref_source")
    positive = (label == 1).cast("double")
    aggs = [
        F.max(F.when(rank == 1, F.col("cosine_sim"))).alias("top1_sim"),
        F.max(F.when(rank == 1, source)).alias("top1_source"),
        F.max(F.when(rank == 1, label)).alias("top1_label"),
    ]
    aggs += [_share(rank <= c, positive).alias(f"top{c}_pos_frac") for c in cuts]
    for s in sources:
        mine = (rank <= 10) & (source == s)
        aggs += [
            _share(mine, positive).alias(f"{s}_top10_pos_frac"),
            F.count_if(mine & (label == 0)).alias(f"top10_{s}_neg"),
            F.count_if(mine & (label == 1)).alias(f"top10_{s}_pos"),
        ]
    aggs += [_share(rank <= c, F.col("cosine_sim")).alias(f"mean_top{c}_sim") for c in cuts if c <= 10]
    return edges.groupBy("query_id").agg(*aggs)


def label_conflicts(edges: DataFrame, sources: Sequence[str], test_source: str = "test") -> DataFrame:
    """Per labelled query: share of same-label neighbours among *labelled* ones, test share, conflict.

    ``edges`` has query_label, ref_label (NULL when unknown) and ref_source. Labelled neighbours are
    re-ranked within the query, which holds at most k edges.
    """
    known = F.col("ref_label").isNotNull()
    seq = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = edges.withColumn("_kr", F.when(known, F.sum(known.cast("int")).over(seq)))
    same = (F.col("ref_label") == F.col("query_label")).cast("double")
    rank = F.col("rank")

    def same_share(n: int | None) -> Column:
        inside = known if n is None else known & (F.col("_kr") <= n)
        return F.coalesce(F.avg(F.when(inside, same)), F.lit(0.0))

    is_test = (F.col("ref_source") == test_source).cast("double")
    out = ranked.groupBy("query_id").agg(
        F.max("query_label").alias("query_label"),
        F.max(F.when(rank == 1, F.col("cosine_sim"))).alias("top1_sim"),
        F.max(F.when(rank == 1, F.col("ref_source"))).alias("top1_source"),
        F.max(F.when(rank == 1, F.coalesce("ref_label", F.lit(-1)))).alias("top1_label"),
        same_share(3).alias("top3_same_label_frac"),
        same_share(5).alias("top5_same_label_frac"),
        F.avg(F.when(rank <= 5, is_test)).alias("top5_test_frac"),
        same_share(None).alias("top10_same_label_frac"),
        F.avg(is_test).alias("top10_test_frac"),
        *[F.count_if(F.col("ref_source") == s).alias(f"top10_source_{s}") for s in sources],
        F.count_if(F.col("ref_label") == 1).alias("top10_source_pos"),
        F.count_if(F.col("ref_label") == 0).alias("top10_source_neg"),
        F.avg("cosine_sim").alias("_mean_sim"),
    )
    from sievecrest.functions.risk import conflict_score

    return out.withColumn("conflict_score", conflict_score(F.col("top10_same_label_frac"), F.col("_mean_sim"))).drop("_mean_sim")


def contact_index(edges: DataFrame, k: int, cols: Sequence[str] = ("ref_label", "ref_source")) -> DataFrame:
    """First ``k`` neighbours' columns joined by commas in rank order."""
    few = edges.where(F.col("rank") <= k)
    packed = F.array_sort(F.collect_list(F.struct("rank", *[F.col(c).cast("string").alias(c) for c in cols])))

    def listing(c: str) -> Column:
        return F.array_join(F.col(f"_n.{c}"), ",").alias(c.replace("ref_", "top_neighbor_") + "s")

    return few.groupBy("query_id").agg(packed.alias("_n")).select("query_id", *[listing(c) for c in cols])
