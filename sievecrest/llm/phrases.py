"""Phrases that occur more often than their parts suggest, counted by prefix-free parsing.

Texts are cut where their own content says so: at every pair of words whose hash falls into one of
``TRIGGER`` classes, or after ``MOST_WORDS`` words. A chunk runs on within its last piece for as many
words as the longest phrase needs beyond its own end, and says how many of its words it owns; phrases
belong to the chunk that owns their first word, so every occurrence is counted once, overlaps
included. Equal text gives equal chunks wherever it stands: copies and shared passages collapse to one
row of a dictionary with its frequency, and phrases are counted inside distinct chunks, weighted by it.
The dictionary is packed once into blocks of numbered words, which all rounds of counting read. Buffers,
blocks, batches and the row groups of the blocks' files are bounded, whatever the corpus holds.

Phrases grow by a word a round. No phrase is frequent unless both phrases without its first and its
last word are, so a round counts only those whose parts pass a bitmap of the last round's frequent
phrases. A bitmap has at most 2^``MAP_BITS`` bits whatever the corpus holds; where it lets too much
pass, the exact counts afterwards still decide.

Nulls and ties: a null text is an empty one; a null language is ``und``; equal rows count each; of
cuts with equal scores the shortest first part counts, equal ranks are settled by count and then by
phrase in byte order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import BATCH_ROWS, arrow_rows
from sievecrest.operators.ordering import top_per_group
from sievecrest.session import cut_lineage

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
TRIGGER = 32
MOST_WORDS = 128
BUFFER_CHARS = 1 << 22
CHUNK_ROWS = 10_000
BLOCK_ROWS = 1
MAP_BITS = 26
SALTS = 16
UNKNOWN = "und"
_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _words(data: bytes) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each word in order its number, its piece (ended by \\n or \\r) and its text (by \\r)."""
    spaced = data.replace(b"\n", b" \n ").replace(b"\r", b" \r ")
    tokens = pc.split_pattern(pa.array([spaced], pa.binary()), b" ").values.dictionary_encode()
    words, numbers = tokens.dictionary, tokens.indices.to_numpy()
    ends, text_ends, nothing = (numbers == pc.index(words, pa.scalar(w, pa.binary())).as_py() for w in (b"\n", b"\r", b""))
    kept = ~(ends | text_ends | nothing)
    return words, numbers[kept].astype(np.int64), np.cumsum(ends | text_ends)[kept], np.cumsum(text_ends)[kept]


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def parse(texts: list[bytes], longest: int = LONGEST) -> dict[tuple[bytes, int], int]:
    """Chunks of lower-cased texts with the words they own, and how often each stands there.

    A chunk has its words between single spaces and a line break between its pieces.
    """
    words, numbers, piece, text = _words(b"\r".join(t.translate(_BREAKS) for t in texts))
    n = len(numbers)
    out: dict[tuple[bytes, int], int] = {}
    if not n:
        return out
    starts = np.append(True, text[1:] != text[:-1])
    words = words.to_pylist()
    h = _hashes(words, 0)[numbers]
    starts[1:] |= _mixed(h[:-1] * _FACTOR + h[1:]) % np.uint64(TRIGGER) == 0
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(starts, at, 0))
    begin = np.flatnonzero(since % MOST_WORDS == 0)
    end = np.append(begin[1:], n)
    heads = np.append(True, piece[1:] != piece[:-1])
    firsts = np.flatnonzero(heads)
    piece_end = np.append(firsts[1:], n)[np.searchsorted(firsts, end - 1, "right") - 1]
    reach = np.minimum(end + longest - 1, piece_end)
    broken = [b"\n " + w for w in words]
    flat = [broken[i] if f else words[i] for i, f in zip(numbers.tolist(), heads.tolist())]
    for b, e, r in zip(begin.tolist(), end.tolist(), reach.tolist()):
        chunk = b" ".join(flat[b:r])
        key = (chunk[2:] if chunk[:2] == b"\n " else chunk, e - b)
        out[key] = out.get(key, 0) + 1
    return out


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[tuple]]]:
    """Rows (language, text, ...) gathered by language, about ``BUFFER_CHARS`` at a time."""
    held: dict[str, list[tuple]] = {}
    size = 0
    for batch in batches:
        for lang, text, *more in zip(*(c.to_pylist() for c in batch.columns)):
            if text:
                held.setdefault(lang, []).append((text, *more))
                size += len(text)
            if size >= BUFFER_CHARS:
                yield held
                held, size = {}, 0
    if held:
        yield held


def chunk_dictionary(df: DataFrame, text_col: str, lang_col: str, longest: int = LONGEST) -> DataFrame:
    """(lang, chunk, own, n): distinct chunks of every language with their parse frequency."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    rows = df.select(lang.alias("lang"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_language(batches):
            for name, texts in held.items():
                found = parse([t.encode("utf-8", "surrogatepass").lower() for (t,) in texts], longest)
                columns = [
                    pa.array([name] * len(found), pa.string()),
                    pa.array([c for c, _ in found], pa.binary()).cast(pa.string()),
                    pa.array([o for _, o in found], pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "own", "n"])

    parsed = rows.mapInArrow(work, "lang string, chunk string, own int, n long")
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(h) & np.uint64(bits - 1)).astype(np.int64)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 1)


def _grown(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every position, from the words' hashes; the last ones stay short."""
    out = h.copy()
    for j in range(1, size):
        out = out * _FACTOR
        out[: len(h) - j] += h[j:]
    return out


_BLOCK = ["lang", "words", "numbers", "heads", "owned", "weights"]
#: A row group is held whole and a page compressed whole, and by default their sizes are first looked at after 100 rows.
_FEW_BLOCKS = {
    "parquet.block.size": str(1 << 23), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"
}


def chunk_blocks(chunks: DataFrame) -> DataFrame:
    """Distinct chunks of a language packed into blocks that every round of counting reads.

    A block has its distinct words, for each word in order its number (32 bits) and whether a piece
    begins there (8 bits), and for each chunk how many words it owns and has beyond (32 bits each) and
    its frequency (64 bits).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_language(batches):
            for name, rows in held.items():
                words, numbers, piece, row = _words("\r".join(r[0] for r in rows).encode("utf-8", "surrogatepass"))
                own, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
                owned = np.stack([own, np.bincount(row, minlength=len(rows)) - own], 1)
                heads = np.append(True, piece[1:] != piece[:-1])
                parts = (numbers.astype("<u4"), heads.astype("u1"), owned.astype("<u4"), weight.astype("<i8"))
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in parts]
                listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), listed, *blobs], _BLOCK)

    schema = "lang string, words array<string>, numbers binary, heads binary, owned binary, weights binary"
    return chunks.select("lang", "chunk", "own", "n").mapInArrow(work, schema)


def count_phrases(blocks: DataFrame, size: int, parts: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n) of all phrases of ``size`` words whose two shorter parts pass the bitmap ``parts``.

    Counts of a block leave ``CHUNK_ROWS`` at a time, as Spark holds a batch outside its heap.
    """
    shared = None if parts is None else blocks.sparkSession.sparkContext.broadcast(parts)  # at most 2^MAP_BITS bits

    def count(name: str, words: pa.StringArray, numbers: np.ndarray, heads: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        piece = np.cumsum(heads, dtype=np.int32)
        whole = max(0, len(numbers) - size + 1)
        good = weights[:whole] > 0
        good &= piece[:whole] == piece[size - 1 :]
        if shared is not None:
            bitmap = shared.value
            h = _grown(_hashes(words.cast(pa.binary()).to_pylist(), _seed(name))[numbers], size - 1)
            spot = _places(h, len(bitmap) * 8)
            held = (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
            good &= held[:whole] & held[1 : whole + 1]
        at = np.flatnonzero(good)
        code, seen = pd.factorize(numbers[at].astype(np.int64))
        for j in range(1, size):
            code, seen = pd.factorize(code * len(words) + numbers[at + j])
        total = np.zeros(len(seen), np.int64)
        np.add.at(total, code, weights[at])
        first = np.empty(len(seen), np.int64)
        first[code[::-1]] = at[::-1]
        for i in range(0, len(first), CHUNK_ROWS):
            some = first[i : i + CHUNK_ROWS]
            columns = [words.take(pa.array(numbers[some + j])) for j in range(size)]
            phrases = columns[0] if size == 1 else pc.binary_join_element_wise(*columns, " ")
            names = pa.array([name], pa.string()).take(pa.array(np.zeros(len(some), np.int64)))
            yield pa.RecordBatch.from_arrays([names, phrases, pa.array(total[i : i + CHUNK_ROWS])], ["lang", "phrase", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name, words, *blobs = (c[i] for c in batch.columns)
                numbers, heads, owned, n = (np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, ("<u4", "u1", "<u4", "<i8")))
                weights = np.repeat(np.stack([n, np.zeros_like(n)], 1).ravel(), owned)
                yield from count(name.as_py(), words.values, numbers, heads, weights)

    found = blocks.select(*_BLOCK).mapInArrow(work, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_bitmap(phrases: DataFrame, size: int) -> np.ndarray:
    """Bitmap of a written table of phrases of ``size`` words: about 32 bits each, at most 2^``MAP_BITS``."""
    bits = 1 << int(min(MAP_BITS, max(16, np.ceil(np.log2(32 * max(1, phrases.count()))))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for name, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _hashes(phrase.encode("utf-8", "surrogatepass").split(b" "), _seed(name))
                places.append(_places(_grown(h, size)[:1], bits)[0])
            spot = np.array(places, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 5), pa.array(1 << (spot & 31))], ["word", "bit"])

    marked = phrases.select("lang", "phrase").mapInArrow(work, "word long, bit long")
    with arrow_rows(phrases.sparkSession, CHUNK_ROWS):
        held = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^(MAP_BITS - 5) rows
    out = np.zeros(bits // 32, "<u4")
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def score_cuts(candidates: DataFrame) -> DataFrame:
    """``candidates`` with a, n, l and r and their ``score`` floor(1000 * a * n / (l * r)), exact beyond 64 bits."""
    a, n, l, r = (F.col(c).cast("decimal(17,0)") for c in "anlr")
    wide = candidates.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * a * n).withColumn("_down", l * r)
    return wide.withColumn("score", F.expr("_up div _down")).drop("_up", "_down")


def collocations(
    df: DataFrame, text_col: str, lang_col: str, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``longest`` words of every language.

    A phrase of ``a`` >= ``min_count`` occurrences scores by its weakest cut; phrases inside a longer one
    that occurs as often are dropped.
    """
    spark = df.sparkSession
    with arrow_rows(spark, BATCH_ROWS):  # whole texts may be long
        chunks = cut_lineage(chunk_dictionary(df, text_col, lang_col, longest))
    with arrow_rows(spark, CHUNK_ROWS):
        blocks = cut_lineage(chunk_blocks(chunks), _FEW_BLOCKS)
    with arrow_rows(spark, BLOCK_ROWS):
        words = cut_lineage(count_phrases(blocks, 1))
        levels = [cut_lineage(words.where(F.col("n") >= min_count))]
        for size in range(2, longest + 1):
            found = count_phrases(blocks, size, phrase_bitmap(levels[-1], size - 1))
            levels.append(cut_lineage(found.where(F.col("n") >= min_count)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = levels[0].withColumn("size", F.lit(1))
    for size, level in enumerate(levels[1:], 2):
        known = known.unionByName(level.withColumn("size", F.lit(size)))
    several = known.where(F.col("size") > 1).withColumnRenamed("n", "a")
    words_of = F.split("phrase", " ")

    def joined(from_: int, to) -> F.Column:
        return F.array_join(F.slice(words_of, from_, to), " ")

    # Many phrases share a first or last part: spread them, and repeat the counts.
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", joined(1, F.col("k")).alias("_first"),
        F.array_join(F.slice(words_of, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("_rest"),
        F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_salt"),
    )
    counts = known.where(F.col("size") < longest).select(
        "lang", "phrase", "n", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_salt")
    )
    left, right = (counts.select("lang", F.col("phrase").alias(p), F.col("n").alias(c), "_salt") for p, c in (("_first", "l"), ("_rest", "r")))
    parted = cuts.join(left, ["lang", "_first", "_salt"]).join(right, ["lang", "_rest", "_salt"]).join(totals, "lang")
    weakest = score_cuts(parted).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_w"))
    # A longer phrase as frequent passes its count to every phrase between, so one word more is enough.
    size = F.col("size")
    inner = F.array(joined(1, size - 1), F.array_join(F.slice(words_of, 2, size - 1), " "))
    longer = several.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.coalesce("_longer", F.lit(-1)) < F.col("a"))
    rows = kept.select("lang", "phrase", "a", "_w.l", "_w.r", "n", "_w.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = top_per_group(rows, ["lang"], order, top, "phrase", "rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
