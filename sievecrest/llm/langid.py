"""Language identification with bit-sliced Bloom filters over n-grams.

One table of bit masks stands for a Bloom filter per language: bit *l* of a mask belongs to
the filter of language *l*. Looking an n-gram up ANDs the masks at its ``HASHES`` places and returns
every language that contains it at once. Per text, the hits of each language are counted, the hits
its filter's false positives explain are taken off, and the language with most hits left wins.

Training counts the n-grams of every labelled training row with Spark, and every n-gram of a language
enters its filter: a lookup never misses a language. The masks are combined slot by slot in Spark, so
the driver receives one mask a slot. There are ``SLOTS_A_GRAM`` slots for each n-gram of the language
with most of them, ``MAX_SLOTS`` at most, which bounds what is sent out; beyond it the filters fill
further, false positives grow, and the correction takes more off.

As a filter of a corpus, a text stays if the share of its n-grams that are known is at least
``MIN_SCORE`` of the mean share of held-out texts of the language found, so a language with few
labelled rows is held to what those rows teach. A language without held-out texts rejects nothing, and
without any labelled row all texts stay.

Nulls and ties: a null text, or one without a letter, is ``und`` with score 0; rows with a null label
do not train; a text with letters but no known n-gram gets the language with most training rows,
score 0; ties go to the language with more training rows, then to the smaller name; without any
training row every text is ``und``. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import segments, small_batches, text_bytes
from sievecrest.session import cut_lineage

GRAM = 4
SLOTS_A_GRAM = 16
MIN_SLOTS, MAX_SLOTS = 1 << 20, 1 << 22
HASHES = 3
MIN_SCORE = 0.5
PART = 1 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1]


def training_row(id_col: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def plain(text: bytes) -> bytes:
    """Lower-case words of letters with one space around each."""
    return b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_KEEP).split()) + b" "


def gram_codes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and code of every n-gram without two spaces in a row."""
    raw = np.frombuffer(buffer, np.uint8)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    codes = np.zeros(n, np.uint32)
    for i in range(GRAM):
        codes = (codes << np.uint32(8)) | raw[i : i + n]
    space = raw == 32
    double = space[:-1] & space[1:]
    bad = np.zeros(n, bool)
    for i in range(GRAM - 1):
        bad |= double[i : i + n]
    starts = np.flatnonzero(~bad)
    return starts, codes[starts]


@dataclass
class Filters:
    """Languages in order of training rows, and their bit-sliced filters, 64 languages to a plane."""

    names: list[str]
    planes: np.ndarray  # (ceil(languages / 64), slots) uint64
    _rates: np.ndarray | None = None

    @classmethod
    def empty(cls, names: list[str], most_grams: int) -> Filters:
        """Filters for languages of at most ``most_grams`` n-grams each."""
        slots = MIN_SLOTS
        while slots < min(MAX_SLOTS, SLOTS_A_GRAM * most_grams):
            slots *= 2
        return cls(names, np.zeros((max(1, -(-len(names) // 64)), slots), np.uint64))

    @classmethod
    def build(cls, names: list[str], grams: dict[str, np.ndarray]) -> Filters:
        filters = cls.empty(names, max((len(g) for g in grams.values()), default=0))
        for l, name in enumerate(names):
            for place in cls.places(grams.get(name, np.zeros(0, np.uint32)), filters.planes.shape[1]):
                filters.planes[l // 64][place] |= np.uint64(1 << (l % 64))
        return filters

    @staticmethod
    def places(codes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        for m in _MULTIPLIERS[:HASHES]:
            mixed = codes ^ (codes >> np.uint32(15))
            mixed = mixed * np.uint32(m)
            yield (mixed ^ (mixed >> np.uint32(13))) & np.uint32(slots - 1)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """(planes, n): bit l set if the filter of language l holds the n-gram."""
        out = None
        for place in self.places(codes, self.planes.shape[1]):
            found = self.planes[:, place]
            out = found if out is None else out & found
        return out

    def false_rates(self) -> np.ndarray:
        """Share of foreign n-grams each filter takes for its own; worked out once a process, the filters being done."""
        if self._rates is None:
            fill = [((self.planes[l // 64] >> np.uint64(l % 64)) & np.uint64(1)).mean() for l in range(len(self.names))]
            self._rates = np.array(fill) ** HASHES
        return self._rates

    def hits(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language contains."""
        total = np.zeros(len(docs), np.int64)
        found = np.zeros((len(docs), len(self.names)), np.int64)
        for part in segments([plain(d) for d in docs], PART, GRAM - 1):
            # The overlap of a long text's parts would look like a border; a double space marks one.
            owner = np.array([i for i, _ in part])
            ends = np.cumsum([len(b) + 2 for _, b in part])
            starts, codes = gram_codes(b"  ".join(b for _, b in part))
            doc = owner[np.searchsorted(ends, starts, "right")]
            total += np.bincount(doc, minlength=len(docs))
            masks = self.masks(codes)
            for l in range(len(self.names)):
                hit = (masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)
                found[:, l] += np.bincount(doc, weights=hit, minlength=len(docs)).astype(np.int64)
        return total, found

    def decide(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        letters = [bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, found = self.hits(texts)
        rate = self.false_rates()
        real = np.clip((found - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0, None)
        best = real.argmax(axis=1)
        score = np.clip(real[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def train_filters(df: DataFrame, text_col: str, lang_col: str) -> Filters:
    """Filters of all n-grams of every row with a language; what comes back is one mask a slot."""
    rows = small_batches(df).where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                by.setdefault(lang, []).append(plain(text))
            for lang, docs in by.items():
                # One row with code -1 carries the number of rows, so that a language without n-grams is known.
                yield _counted(lang, np.array([-1]), np.array([len(docs)]))
                for part in segments(docs, PART, GRAM - 1):
                    codes, n = np.unique(gram_codes(b"  ".join(b for _, b in part))[1], return_counts=True)
                    yield _counted(lang, codes.astype(np.int64), n)

    counted = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    is_gram = F.col("code") >= 0
    languages = counted.groupBy("lang").agg(F.max(F.when(~is_gram, F.col("n"))).alias("docs"), F.count_if(is_gram).alias("grams"))
    found = sorted(languages.collect(), key=lambda r: (-r["docs"], r["lang"]))
    filters = Filters.empty([r["lang"] for r in found], max((r["grams"] for r in found), default=0))
    number, slots = {name: l for l, name in enumerate(filters.names)}, filters.planes.shape[1]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l = np.array([number[name] for name in batch.column(0).to_pylist()], np.int64)
            bit = (np.uint64(1) << (l % 64).astype(np.uint64)).view(np.int64)
            for place in Filters.places(batch.column(1).to_numpy().astype(np.uint32), slots):
                columns = [pa.array(c) for c in (l // 64 * slots + place, bit)]
                yield pa.RecordBatch.from_arrays(columns, ["place", "bits"])

    marks = counted.where(is_gram).select("lang", "code").mapInArrow(mark, "place long, bits long")
    masks = marks.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    filters.planes.ravel()[masks.column(0).to_numpy()] = masks.column(1).to_numpy().view(np.uint64)
    return filters


def _counted(lang: str, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(codes), np.int32)), pa.array([lang])).dictionary_decode()
    return pa.RecordBatch.from_arrays([names, pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])


def predict_languages(df: DataFrame, filters: Filters, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone."""
    shared = df.sparkSession.sparkContext.broadcast(filters)
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.decide(text_bytes(batch.column(1)))
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")


def language_levels(df: DataFrame, filters: Filters, text_col: str, lang_col: str) -> dict[str, float]:
    """Mean score of labelled rows (not those that trained) whose language is found, a language."""
    rows = df.where(F.col(lang_col).isNotNull())
    found = predict_languages(rows, filters, lang_col, text_col).where(F.col("doc_id").cast("string") == F.col("lang_pred"))
    return {r["lang_pred"]: r["level"] for r in found.groupBy("lang_pred").agg(F.avg("score").alias("level")).collect()}


def keep_identified(
    df: DataFrame, filters: Filters, text_col: str, min_score: float = MIN_SCORE, levels: dict[str, float] | None = None
) -> DataFrame:
    """The rows whose text is in a learned language: at least ``min_score`` of its n-grams are known in it.

    With ``levels``, ``min_score`` of the level of its language. Without any learned language all rows stay.
    """
    if not filters.names:
        return df
    shared = df.sparkSession.sparkContext.broadcast(filters)
    at = df.columns.index(text_col)
    limit = {name: min_score * (1.0 if levels is None else levels.get(name, 0.0)) for name in filters.names}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.decide(text_bytes(batch.column(at)))
            kept = [lang != UNKNOWN and score >= limit[lang] for lang, score in zip(langs, scores)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return small_batches(df).mapInArrow(keep, df.schema)
