"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots. Only the bytes of each slot are summed, and a small
versioned table says which shard holds a slot: the first version fills shards with the largest slots
first, later versions move whole slots from overfull shards to the least filled one. Rows never move
between slots, so a new version costs an edit of ``n_slots`` rows, whatever the corpus holds.

Everything is DataFrame work. A map has ``n_slots`` rows by definition, so folding it in one row is
bounded. Rows equal in key, size and checksum are counted before they are shuffled, and cut into
units of at most ``UNIT`` copies, so a record repeated over a third of the table spreads over slots.

Nulls and ties: a null key is a key like any other; a null text counts as no bytes; an empty table
gives a map of empty slots and no rows; equal rows get different places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
UNIT = 1024


def record_units(df: DataFrame, id_col: str, text_col: str, n_slots: int = N_SLOTS) -> DataFrame:
    """(id, size, crc, unit, copies, vslot): equal records counted and cut into units, each in its slot."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    records = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    counted = records.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - 1) / UNIT)
    units = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("unit"))
    return units.select(
        "id",
        "size",
        "crc",
        "unit",
        F.least(F.lit(UNIT).cast("long"), F.col("n") - F.col("unit") * UNIT).alias("copies"),
        F.pmod(F.xxhash64("id", "size", "crc", "unit"), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_stats(units: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the slots in use."""
    return units.groupBy("vslot").agg(
        F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")
    )


def _all_slots(spark: SparkSession, stats: DataFrame, n_slots: int) -> DataFrame:
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return slots.join(stats, "vslot", "left").na.fill(0, ["bytes", "rows"])


def _fold(slots: Column, loads: Column, step) -> Column:
    """Shard of each slot, in the order of ``slots``, by a fold that carries the load of every shard."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def put(state: Column, slot: Column) -> Column:
        shard = step(state["loads"], slot)
        weight = slot["bytes"] + 1
        moved = F.transform(state["loads"], lambda load, i: load + F.when(i == shard, weight).otherwise(F.lit(0)))
        return F.struct(moved.alias("loads"), F.concat(state["shards"], F.array(shard)).alias("shards"))

    return F.aggregate(slots, start, put, lambda state: state["shards"])


def _lightest(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _spread(folded: DataFrame, version: int) -> DataFrame:
    pair = F.explode(F.arrays_zip("slots", "shards")).alias("p")
    return folded.select(pair).select(
        F.col("p.slots.vslot").alias("vslot"),
        F.col("p.shards").alias("shard"),
        F.col("p.slots.bytes").alias("bytes"),
        F.col("p.slots.rows").alias("rows"),
        F.lit(version).alias("version"),
    )


def plan_map(spark: SparkSession, stats: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: largest slot first, each to the shard with the fewest bytes so far.

    A slot weighs its bytes plus one, so empty slots spread as well and later records do too.
    """
    slots = F.sort_array(F.collect_list(F.struct("bytes", "vslot", "rows")), asc=False).alias("slots")
    packed = _all_slots(spark, stats, n_slots).agg(slots)
    zero = F.array_repeat(F.lit(0).cast("long"), n_shards)
    return _spread(packed.select("slots", _fold(F.col("slots"), zero, lambda loads, s: _lightest(loads)).alias("shards")), 1)


def edit_map(spark: SparkSession, current: DataFrame, stats: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The next version for new byte counts or another number of shards.

    Slots are looked at from the largest to the smallest. One moves, to the shard with the fewest
    bytes, only if its shard is gone or stays at or above the even share without it.
    """
    version = F.max("version").alias("version")
    held = current.select("vslot", "shard", "version")
    slots = F.sort_array(F.collect_list(F.struct("bytes", "vslot", "rows", "shard")), asc=False).alias("slots")
    packed = _all_slots(spark, stats, n_slots).join(held, "vslot").agg(slots, version)
    weights = F.transform("slots", lambda s: s["bytes"] + 1)
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)
    begin = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.aggregate(
            F.filter("slots", lambda s: s["shard"] == i), F.lit(0).cast("long"), lambda a, s: a + s["bytes"] + 1
        ),
    )
    ready = packed.select("slots", "version", begin.alias("begin"), (total / n_shards).alias("share"))

    def put(state: Column, slot: Column) -> Column:
        weight = slot["bytes"] + 1
        gone = slot["shard"] >= n_shards
        own = F.get(state["loads"], slot["shard"])
        to = _lightest(state["loads"])
        moves = gone | ((own - weight >= F.col("share")) & (F.array_min(state["loads"]) + weight < own))
        shard = F.when(moves, to).otherwise(slot["shard"])
        loads = F.transform(
            state["loads"],
            lambda load, i: load
            + F.when(moves & (i == to), weight).otherwise(F.lit(0))
            - F.when(moves & (i == slot["shard"]), weight).otherwise(F.lit(0)),
        )
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(shard)).alias("shards"))

    start = F.struct(F.col("begin").alias("loads"), F.array().cast("array<int>").alias("shards"))
    shards = F.aggregate("slots", start, put, lambda state: state["shards"])
    edited = _spread(ready.select("slots", shards.alias("shards"), "version"), 0).drop("version")
    return edited.withColumn("version", ready.select(F.col("version") + 1).scalar())


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version below ``path``; earlier ones stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        return stored.where(F.col("version") == stored.agg(F.max("version")).scalar())
    return stored.where(F.col("version") == version)


def place_rows(units: DataFrame, slot_map: DataFrame) -> DataFrame:
    """One row per record: its virtual slot, shard and place in the shard, gapless from 0.

    The place is the rows of the shard's earlier slots (a sum over the map) plus the place inside the
    slot, so no task ever orders a whole shard.
    """
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = slot_map.select("vslot", "shard", "version", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("id", "size", "crc", "unit").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(first, "vslot")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return placed.select("*", copy).withColumn("place", F.col("first") + F.col("before") + F.col("copy"))
