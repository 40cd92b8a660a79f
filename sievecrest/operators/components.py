"""Connected components of an edge table, and the in-order pass that lets the first of each group win.

An item stays unless an earlier item that stays is linked to it. Read naively that is one decision
after another; here components cut it into independent pieces, each settled in one ordered pass, and
a component too large for that is settled in rounds in which whole chains collapse by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.session import cut_lineage

COMPONENT_EDGES = 1 << 18


def _least_neighbour(edges: DataFrame, node: str, other: str, name: str) -> DataFrame:
    return edges.groupBy(node).agg(F.min(other).alias(name))


def _star_round(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, after linking every node's larger, then smaller neighbours to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both, "u", "v", "m").select("u", F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = _least_neighbour(large, "u", "v", "m")
    small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """((node, root) of every node with an edge, rounds): ``root`` is the component's least node.

    Star contraction: rounds grow with the logarithm of the longest path.
    """
    pair = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    stars = cut_lineage(edges.where(F.col(a) != F.col(b)).select(*pair).distinct())
    rounds = 0
    while True:
        # Done when every node has one parent and no parent has a parent.
        several = stars.groupBy("u").count().where("count > 1").select("u")
        inner = stars.select(F.col("v").alias("u")).join(stars.select("u"), "u", "left_semi")
        if several.unionByName(inner).isEmpty():
            break
        stars = cut_lineage(_star_round(stars))
        rounds += 1
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), rounds


def ordered_pass(pieces: DataFrame) -> DataFrame:
    """(idx,): later items to drop, from edges (root, later, earlier) whose components fit a task.

    A component's edges pass in the order of their later item, so the earlier ones are all decided; only
    the dropped items of the component at hand are remembered.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = later = None
        dropped: set = set()
        for batch in batches:
            out = []
            for r, item, earlier in zip(*(c.to_pylist() for c in batch.columns)):
                if r != root:
                    root, later, dropped = r, None, set()
                if item != later:
                    later, open_ = item, True
                if open_ and earlier not in dropped:
                    dropped.add(item)
                    out.append(item)
                    open_ = False
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(1).type)], ["idx"])

    kind = pieces.schema["later"].dataType.simpleString()
    laid = pieces.select("root", "later", "earlier").repartition("root").sortWithinPartitions("root", "later", "earlier")
    return laid.mapInArrow(work, f"idx {kind}")


def collapse_chains(live: DataFrame) -> tuple[DataFrame, int]:
    """Edges (later, earlier, flipped) with every single-parent item replaced by the head of its chain, and the rounds.

    An item with one open edge stays exactly when its parent does not (or does, if the edge is flipped):
    it can stand for its parent with that sign. Pointers to parents double until they reach heads.
    """
    chain = live.groupBy("later").agg(F.count(F.lit(1)).alias("n"), F.min("earlier").alias("head"), F.max("flipped").alias("f"))
    links = cut_lineage(chain.where("n = 1").select(F.col("later").alias("node"), "head", (~F.col("f")).alias("opposite")))
    rounds = 0
    while True:
        onward = links.select(F.col("node").alias("head"), F.col("head").alias("_next"), F.col("opposite").alias("_turn"))
        if links.join(onward, "head", "left_semi").isEmpty():
            break
        turn = F.col("opposite") != F.coalesce("_turn", F.lit(False))
        links = cut_lineage(links.join(onward, "head", "left").select("node", F.coalesce("_next", "head").alias("head"), turn.alias("opposite")))
        rounds += 1
    to_head = links.select(F.col("node").alias("earlier"), "head", "opposite")
    flip = F.col("flipped") != F.coalesce("opposite", F.lit(False))
    return live.join(to_head, "earlier", "left").select("later", F.coalesce("head", "earlier").alias("earlier"), flip.alias("flipped")).distinct(), rounds


def settle_large(edges: DataFrame) -> tuple[DataFrame, int]:
    """((idx,) of later items to drop, rounds) for edges (later, earlier) of components of any size.

    Each round settles all items whose earlier ones are settled and then collapses chains. Edges carry a
    sign: a flipped one drops its later item when the earlier one is dropped.
    """
    live = cut_lineage(edges.select("later", "earlier").distinct().withColumn("flipped", F.lit(False)))
    gone = live.select(F.col("later").alias("earlier")).limit(0)
    every, rounds = None, 0
    while not live.isEmpty():
        waiting = live.select(F.col("later").alias("earlier")).distinct()
        heads = live.select("earlier").distinct().join(waiting, "earlier", "left_anti")
        state = heads.join(gone.withColumn("_gone", F.lit(True)), "earlier", "left").select("earlier", F.coalesce("_gone", F.lit(False)).alias("_gone"))
        judged = cut_lineage(live.join(state, "earlier", "left"))
        hit = judged.where(F.col("_gone") == F.col("flipped")).select("later")
        both = judged.groupBy("later", "earlier").agg(F.count_distinct("flipped").alias("n")).where("n = 2").select("later")
        gone = cut_lineage(hit.unionByName(both).distinct().withColumnRenamed("later", "earlier"))
        every = gone if every is None else every.unionByName(gone)
        rest = judged.where(F.col("_gone").isNull()).select("later", "earlier", "flipped")
        open_ = cut_lineage(rest.join(gone.withColumnRenamed("earlier", "later"), "later", "left_anti"))
        live, more = collapse_chains(open_)
        live = cut_lineage(live)
        rounds += 1 + more
    dropped = gone if every is None else every
    return dropped.select(F.col("earlier").alias("idx")), rounds


def first_wins(edges: DataFrame, component_edges: int = COMPONENT_EDGES) -> tuple[DataFrame, int]:
    """((idx,) to drop, rounds): items linked to an earlier item that stays. ``edges`` are (later, earlier).

    Components of up to ``component_edges`` edges take one ordered pass each, all at once; larger ones
    take the rounds of ``settle_large``. Both give what one decision after another would.
    """
    pairs = cut_lineage(edges.select("later", "earlier").distinct())
    roots, rounds = component_roots(pairs, "later", "earlier")
    placed = cut_lineage(pairs.join(roots.withColumnRenamed("node", "earlier"), "earlier").select("root", "later", "earlier"))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > component_edges).select("root")
    dropped = ordered_pass(placed.join(large, "root", "left_anti"))
    rest, more = settle_large(placed.join(large, "root", "left_semi"))
    return cut_lineage(dropped.unionByName(rest)), rounds + 1 + more
