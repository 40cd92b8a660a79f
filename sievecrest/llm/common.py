"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The six ASCII white-space bytes; words are runs of anything else.
SPACE_CHARS = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns, so extra ones never meet an operator's own."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's rows per Arrow batch: whole texts may be long, and a batch is held in memory."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, BATCH_ROWS)
    return df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows per Arrow batch of the jobs that run inside the block; the session's own number stands again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; a null text is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def segments(docs: list[bytes], limit: int, overlap: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (document index, bytes) of about ``limit`` bytes; longer documents come in overlapping parts.

    Every window of ``overlap + 1`` bytes of a document lies in exactly one part.
    """
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, doc in enumerate(docs):
        at = 0
        while True:
            part = doc[at : at + limit + overlap]
            held.append((i, part))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
            at += limit
            if at + overlap >= len(doc):
                break
    if held:
        yield held


def text_buffers(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """First columns and texts (second column, null as empty) of successive rows of about ``limit`` characters."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            keys.append(batch.column(0).slice(i, 1))
            texts.append(text or "")
            size += len(texts[-1])
            if size >= limit:
                yield pa.concat_arrays(keys), texts
                keys, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts
