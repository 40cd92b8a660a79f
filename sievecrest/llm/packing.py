"""Best-fit packing planned on the histogram of lengths.

No length exceeds ``SEQUENCE``, so the histogram has at most ``SEQUENCE`` rows whatever the corpus
holds, and best fit runs over its counts instead of over documents: lengths from long to short, each
into the sequences with the least room that still takes it. Sequences with equal room are one group
with a first number and a count; placing pieces cuts a group in at most three, so the plan stays
small. It says for every length which ranks go to which sequences at which offset. Pieces then rank
themselves inside their length and take the place planned for that rank.

Ranks are the pieces of earlier buckets of the length plus the place inside the bucket, so a length
that a third of all pieces share is ordered in many tasks.

Nulls and ties: a null text is an empty one, a sequence of the end token alone; equal rows are
separate pieces; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches
from sievecrest.session import cut_lineage

SEQUENCE = 2048
END_ID = 0
BUCKET_ROWS = 100_000
PART_CHARS = 1 << 20
_BREAK = re.compile(r"(?<=\S)(?= \S)")


def text_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts cut only before a single space between two visible characters, where no token crosses."""
    at = 0
    while len(text) - at > size:
        found = _BREAK.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def cut_pieces(total: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than a sequence."""
    head = total % SEQUENCE
    starts = ([0] if head else []) + list(range(head, total, SEQUENCE))
    return [(s, head if s == 0 and head else SEQUENCE) for s in starts]


def piece_table(df: DataFrame, id_col: str, text_col: str, tokenizer) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every piece.

    ``tokenizer()`` is called on the executors and gives a function from a text to an array of ids.
    """
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([*(encode(p) for p in text_parts(text or "")), [END_ID]]).astype("<u4")
                for k, (start, length) in enumerate(cut_pieces(len(ids))):
                    at.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[:, 0].astype(np.int32))]
                + [pa.array(columns[:, c]) for c in (1, 2, 3)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(pieces, schema)


def plan_sequences(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Ranks of a length count from 0. Rank r of a row lies in sequence first + (r - first rank) // pieces
    at offset + (r - first rank) % pieces * length.
    """
    open_groups: dict[int, list[tuple[int, int]]] = {}  # room -> groups of (first sequence, count)
    rooms: list[int] = []  # rooms in use, ascending; few, as they are below ``size``
    plan, sequences = [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_groups:
                open_groups[room] = []
                rooms.append(room)
                rooms.sort()
            open_groups[room].append((first, count))

    for length in sorted((l for l, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in rooms if r >= length), None)
            if room is None:
                each = size // length
                first, count = sequences, -(-left // each)
                sequences += count
                room = size
            else:
                first, count = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room]
                    rooms.remove(room)
                each = room // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, size - room))
                add(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and full < count:
                plan.append((length, rank, rank + left, first + full, left, size - room))
                add(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            add(room, first + full, count - full)
    return plan


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Give every piece its sequence and offset. ``pieces`` must be a written table: it is read twice."""
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = cut_lineage(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(sorted(plan_sequences(histogram, size)), np.int64).reshape(-1, 6)
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(inside)).join(shifts, ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("place") - 1).alias("rank")
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Segments in order of (length, first rank): the last one that does not start later holds the rank.
        width = int(plan[:, 2].max(initial=0)) + 1
        keys = plan[:, 0] * width + plan[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            _, first_rank, _, first, each, offset = plan[np.searchsorted(keys, length * width + rank, "right") - 1].T
            nth = rank - first_rank
            found = [first + nth // each, offset + nth % each * length]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *[pa.array(c) for c in found]], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:5])
    return ranked.mapInArrow(take, f"{kept}, sequence_id long, offset long")


def pack_documents(df: DataFrame, id_col: str, text_col: str, tokenizer, size: int = SEQUENCE) -> DataFrame:
    """Tokenise, cut and pack a table of texts."""
    return pack_pieces(cut_lineage(piece_table(df, id_col, text_col, tokenizer)), size)
