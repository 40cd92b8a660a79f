"""SimHash near-duplicates through anchor points of a covering code.

The 64 bits are cut into ``parts``; two fingerprints within ``THRESHOLD`` bits agree to within
``THRESHOLD // parts`` bits in at least one part. In a part the anchors are the words of a covering
code: a perfect Hamming code (every word has one anchor within radius 1, its home) on the first bits,
the remaining bits as they are. A fingerprint goes to its home anchor and to every anchor within
covering radius plus the part's threshold; with a perfect code those are the homes of all words
within the threshold. So for each pair some anchor is the home of one and holds a copy of the other,
and comparing homes with copies at each anchor finds every pair.

Equal fingerprints are one point. Anchors with many copies are cut into a grid of home blocks and
copy blocks. A cell reports links that join what is not yet joined in it (at most one a copy), never
all pairs, and the links are closed into components by rounds of star contraction whose state is
written to the shared checkpoint folder.

``parts_for`` takes fewer, longer parts for more fingerprints: that changes how selective anchors
are, not the result.

Nulls and ties: a null text has no shingle and fingerprint 0, which links like any other; a null id
counts as larger than every other; equal texts and repeated rows share a component; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches, text_bytes
from sievecrest.session import cut_lineage

THRESHOLD = 4
SHINGLE = 4
SEED = 42
CELL = 1 << 15
CHUNK = 1 << 16
COMPARE = 1 << 22


def simhash(text: bytes) -> int:
    """Fingerprint of one text: a bit is set if over half of its shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        if len(words) < SHINGLE:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*[words[at + j : to + j] for j in range(SHINGLE)]))
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def add_fingerprints(df: DataFrame, keep: list[str], path: list[str]) -> DataFrame:
    """``keep`` columns and ``fp``, the 64 bits as a long. ``path`` leads to the text: a column, or a field inside one."""
    rows = small_batches(df).select(*keep, *(path[:1] if path[0] not in keep else []))
    schema = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(path[0])
            for name in path[1:]:
                text = text.field(name)
            fps = pa.array(_signed([simhash(t) for t in text_bytes(text)]), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], [*keep, "fp"])

    return rows.mapInArrow(tag, f"{schema}, fp long")


class Anchors:
    """Anchor code of one part of ``width`` bits and its home and copy sets."""

    def __init__(self, low: int, width: int, threshold: int):
        self.low, self.width, self.threshold = low, width, threshold
        self.code = 1
        while 2 * self.code + 1 <= width:
            self.code = 2 * self.code + 1  # the longest perfect Hamming code that fits

    def cut(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)

    def home(self, words: np.ndarray) -> np.ndarray:
        """The only anchor within the covering radius: flip the bit that the syndrome names."""
        syndrome = np.zeros(words.shape, np.uint64)
        for i in range(self.code):
            syndrome ^= ((words >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
        flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome, 1) - np.uint64(1), np.uint64(0))
        return words ^ flip

    def copies(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of every anchor within covering radius plus threshold, each once."""
        errors = [0]
        for k in range(1, self.threshold + 1):
            errors += [sum(1 << i for i in c) for c in combinations(range(self.width), k)]
        near = np.sort(self.home(words[:, None] ^ np.array(errors, np.uint64)[None, :]), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, _ = np.nonzero(first)
        return row, near[first]


def part_codes(parts: int, threshold: int = THRESHOLD) -> list[Anchors]:
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [Anchors(a, b - a, threshold // parts) for a, b in zip(edges, edges[1:])]


def parts_for(points: int) -> int:
    """Three parts (17-bit anchors, 14 copies each) up to 2^27 fingerprints, two (27-bit anchors) above."""
    return 3 if points < 1 << 27 else 2


def spread_points(points: DataFrame, parts: int) -> DataFrame:
    """(key, fp, home): every fingerprint at its anchors of every part."""
    codes = part_codes(parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                for p, code in enumerate(codes):
                    words = code.cut(some)
                    row, anchor = code.copies(words)
                    key = (np.uint64(p) << np.uint64(60)) | anchor
                    home = anchor == code.home(words)[row]
                    columns = [key.view(np.int64), some[row].view(np.int64), home]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "home"])

    return points.select("fp").mapInArrow(spread, "key long, fp long, home boolean")


class Forest:
    """Disjoint sets over positions of an array, joined many at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, members: np.ndarray) -> tuple[int, np.ndarray]:
        """Join all members; the root they now share and the roots that went under it."""
        roots = members
        while True:
            up = self.parent[roots]
            if np.array_equal(up, roots):
                break
            roots = up
        roots = np.unique(roots)
        self.parent[members] = roots[0]
        self.parent[roots] = roots[0]
        return roots[0], roots[1:]


def cell_links(homes: np.ndarray, copies: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``threshold`` between homes and copies, at most one a point."""
    points = np.unique(np.concatenate([homes, copies]))
    forest, left, right = Forest(len(points)), [], []
    home_at = np.searchsorted(points, homes)
    step = max(1, COMPARE // max(1, len(points)))
    for at in range(0, len(homes), step):
        some = homes[at : at + step]
        near = np.bitwise_count(some[:, None] ^ points[None, :]) <= threshold
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            members = np.flatnonzero(near[i])
            root, under = forest.join(np.append(members, home_at[at + i]))
            left += [points[root]] * len(under)
            right += points[under].tolist()
    return np.array(left, np.uint64), np.array(right, np.uint64)


def anchor_links(points: DataFrame, parts: int, cell: int = CELL) -> DataFrame:
    """(u, v): links between distinct fingerprints whose closure is that of all pairs within the threshold."""
    spread = spread_points(points, parts)
    hot = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    hot = cut_lineage(hot.select("key", F.ceil(F.col("n") / cell).cast("int").alias("blocks")))
    cut = spread.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A copy stands in its copy block against every home block; a home in its home block against every copy block.
    against = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    gridded = cut.select("key", "fp", "home", own.alias("own"), against)
    as_copy = F.struct(F.col("other").alias("h"), F.col("own").alias("c"), F.lit(False).alias("home"))
    as_home = F.struct(F.col("own").alias("h"), F.col("other").alias("c"), F.lit(True).alias("home"))
    roles = F.explode(F.when(F.col("home"), F.array(as_copy, as_home)).otherwise(F.array(as_copy))).alias("r")
    cells = gridded.select("key", "fp", roles).select("key", "r.h", "r.c", "fp", "r.home")
    dealt = cells.repartition("key", "h", "c").sortWithinPartitions("key", "h", "c")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fps, home in _runs(batches):
            if not home.any():
                continue
            u, v = cell_links(fps[home], fps[~home])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(links, "u long, v long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Cells of a partition sorted by cell, over batch borders."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
        fps = batch.column(3).to_numpy().view(np.uint64)
        home = batch.column(4).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(fps)]])
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(cell[a])
            if last is not None and key != last:
                yield last, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            last = key
            held.append((fps[a:b], home[a:b]))
    if held:
        yield last, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def close_links(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every linked node, by alternating star contraction."""
    edges = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # Large star: larger neighbours go to the least node around.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("e")
        )
        edges = cut_lineage(small.select("e.u", F.col("e.w").alias("v")).where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def group_fingerprints(tagged: DataFrame, first: str) -> DataFrame:
    """(fp, first): for every distinct fingerprint the least ``first`` value of its component."""
    points = cut_lineage(tagged.groupBy("fp").agg(F.min(first).alias("first")))
    roots = close_links(cut_lineage(anchor_links(points, parts_for(points.count()))))
    rooted = points.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root").select("fp", F.col("least").alias("first"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tagged = cut_lineage(add_fingerprints(rows, ["doc_id"], ["text"]))
    groups = group_fingerprints(tagged, "doc_id")
    named = tagged.join(groups, "fp")
    return named.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def one_per_component(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every component the row with the least id (of rows equal in id, one), with all its columns.

    Rows are numbered and written once with their fingerprints, so the number a row is kept by does
    not change when a task runs again; columns travel inside one struct and cannot clash.
    """
    numbered = df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"))
    tagged = cut_lineage(add_fingerprints(numbered, ["row", "rid"], ["row", text_col]))
    id_of = F.col("row").getField(id_col)
    rows = tagged.select("fp", F.struct(id_of.isNull().alias("none"), id_of.alias("id"), "rid").alias("who"))
    groups = group_fingerprints(rows, "who")
    kept = groups.select(F.col("first.rid").alias("rid")).distinct()
    return tagged.join(kept, "rid", "left_semi").select("row.*")
