"""Incremental work on newly arriving files, and running moments over a stream of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecrest.operators.images import channel_sums
from sievecrest.session import cut_lineage


def unseen(inputs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Inputs without any output row, marker rows included; keys match exactly."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def with_markers(inputs: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Results, and one ``empty`` marker row for every input that produced none."""
    found = results.withColumn("status", F.lit("result"))
    none = inputs.join(results.select(key), key, "left_anti").select(key).withColumn("status", F.lit("empty"))
    return found.unionByName(none, allowMissingColumns=True)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_provider(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """State store of the streams started inside the block; the session's own stands again after it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if provider:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _arriving(spark: SparkSession, folder: str, schema: T.StructType, pattern: str) -> DataFrame:
    """Stream of the Parquet files below ``folder`` whose name, or whose table folder's name, matches ``pattern``.

    The path is a glob in any case: as a plain path a single file would be taken for a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{pattern}}}")


def score_new_files(
    spark: SparkSession, folder: str, schema: T.StructType, output: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
    key: str = "id", pattern: str = "*.parquet", provider: str | None = ROCKSDB,
) -> DataFrame:
    """Score what arrived since the last call and return all output rows.

    The checkpoint remembers finished files and, in its state store, one entry for each id ever seen; an
    id that comes again, in the same batch or a later one, is skipped, and no earlier output is read.
    Output and checkpoint belong together. A batch's inputs and scores are written once each to the
    shared scratch folder, so ``score`` runs once a batch; ids without a result leave a marker row. A
    batch replaces its own ``batch=N`` folder, so one that is run again after a failure gives the same
    rows. RocksDB keeps the ids of a store on disk; ``provider=None`` keeps the session's choice.
    """
    arrived = _arriving(spark, folder, schema, pattern)

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch)
        scored = cut_lineage(score(fresh))
        with_markers(fresh, scored, key).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = arrived.dropDuplicates([key]).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    with _state_provider(spark, provider):
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(output)


def running_channel_sums(
    spark: SparkSession, folder: str, schema: T.StructType, output: str, checkpoint: str,
    to_pixels: Callable[[DataFrame], DataFrame], channels: dict[str, str], pattern: str = "*.parquet",
) -> DataFrame:
    """Image and pixel counts with sums and sums of squares over everything seen so far.

    A streaming aggregate in complete mode: its state is one row. Each batch replaces the snapshot
    of its number; the newest one is returned.
    """
    sums = channel_sums(to_pixels(_arriving(spark, folder, schema, pattern)), channels)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    run = (
        sums.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    snapshots = spark.read.parquet(output)
    newest = snapshots.agg(F.max("batch")).scalar()
    return snapshots.where(F.col("batch") == newest).drop("batch")
