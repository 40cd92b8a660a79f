"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Offsets in bytes where tokens of both vocabularies end cut a text into groups. Every interval between
two neighbouring token ends, of either vocabulary, lies in one token of each: that pair is a link.

Most links join tokens of the same bytes. A map from A's ids to B's ids of equal bytes is computed
once; pairs that follow it are counted in vectors as long as the vocabulary, one a task, and summed
by id. Only pairs outside the map are keyed by both ids and shuffled. A pair counts once a document
however often and in whatever group it stands there.

Texts are encoded once. Tokens of neither vocabulary run over a single space between two visible
characters, so a text is a sequence of chunks cut there; each distinct chunk of a buffer is encoded
and aligned once. What a document links is written beside its groups (a table in the shared
folder); counting and scoring read that table. The most frequent pairs outside the map, at most
``head`` of them, are looked up in each task; all others are joined by key, where no key is hot.

Nulls and ties: a null or empty text, and a text that either vocabulary does not give back byte for
byte, has no tokens and zeros everywhere; equal rows are documents of their own; all best pairs of
an id count as best; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches
from sievecrest.llm.packing import text_parts
from sievecrest.llm.wordbpe import byte_characters
from sievecrest.session import cut_lineage

BUFFER_CHARS = 1 << 22
PART_CHARS = 1 << 20
HEAD = 1 << 18
_BREAK = re.compile(r"(?<=\S)(?= \S)")
_ODD = 1 << 32  # a pair's key is A's id times this plus B's id

#: A vocabulary for the aligner: the bytes of every id, and a function from chunks that begin with
#: their space to lists of ids.
Vocabulary = tuple[list[bytes], Callable[[list[str]], list[list[int]]]]


def byte_level_vocabulary(path: str, pattern: str) -> Callable[[], Vocabulary]:
    """A byte-level vocabulary file of the ``tokenizers`` library; special strings are plain text.

    Where ids follow the order of the merges, as they must here, they are the ranks that ``tiktoken``
    takes, which encodes short chunks several times faster; ``pattern`` is the file's word pattern.
    """

    def load() -> Vocabulary:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, step = spec["model"]["vocab"], spec["pre_tokenizer"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step.get("use_regex", True):
            raise ValueError("expected plain byte-level words and ids in the order of the merges")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        tokens = [b""] * (max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        own = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(chunks: list[str]) -> list[list[int]]:
            return list(map(own.encode_ordinary, chunks))

        return tokens, encode

    return load


def piece_vocabulary(path: str) -> Callable[[], Vocabulary]:
    """A ``sentencepiece`` model that adds the leading space itself."""

    def load() -> Vocabulary:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that run over a space cannot be aligned chunk by chunk")
        tokens = [
            b"" if own.is_control(i) or own.is_unknown(i)
            else bytes([int(p[3:5], 16)]) if own.is_byte(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

        def encode(chunks: list[str]) -> list[list[int]]:
            return own.encode([c[1:] for c in chunks], num_threads=1)

        return tokens, encode

    return load


class Aligner:
    """Aligns chunks; what it finds for one is the groups as text and the links as keys."""

    def __init__(self, first: Vocabulary, second: Vocabulary):
        (self.a_bytes, self.encode_a), (self.b_bytes, self.encode_b) = first, second
        # Of several ids with equal bytes the last counts: single bytes precede the pieces.
        b_of = {token: i for i, token in enumerate(self.b_bytes)}
        self.same = np.array([b_of.get(token, -1) if token else -1 for token in self.a_bytes], np.int64)
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        self.pair_text = [f"{a}|{b}" for a, b in enumerate(self.same.tolist())]

    def align(self, chunks: list[str]):
        """(faithful, n_a, n_b, n_groups, group texts, link keys and their cuts) of the chunks."""
        n = len(chunks)
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        ids_a, ids_b = self.encode_a(chunks), self.encode_b(chunks)
        good = _gives_back(ids_a, self.a_bytes, raw) & _gives_back(ids_b, self.b_bytes, raw)
        if not good.all():
            ids_a, ids_b = ([i if g else [] for i, g in zip(ids, good)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (ids_a, ids_b))
        list_a, list_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        flat_a, flat_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        owner_a = np.repeat(np.arange(n), n_a)
        # B's ends that are A's too, and the two sorted lists merged.
        met = ends_a[np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)] == ends_b if len(ends_a) else np.zeros(0, bool)
        common = ends_b[met]
        ends = np.sort(np.concatenate([ends_a, ends_b[~met]]), kind="stable")
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        keys = flat_a[at_a] * _ODD + flat_b[at_b]
        link_cuts = np.searchsorted(owner_a[at_a], np.arange(n + 1))
        last_a, last_b = np.searchsorted(ends_a, common), np.flatnonzero(met)
        n_groups = np.bincount(owner_a[last_a], minlength=n)
        first_a, first_b = np.append(0, last_a[:-1] + 1)[: len(common)], np.append(0, last_b[:-1] + 1)[: len(common)]
        head = flat_a[last_a]
        mapped = (first_a == last_a) & (first_b == last_b) & (self.same[head] == flat_b[last_b])
        texts = list(map(self.pair_text.__getitem__, head.tolist()))
        odd = np.flatnonzero(~mapped)
        for at, sa, ea, sb, eb in zip(*(x.tolist() for x in (odd, first_a[odd], last_a[odd] + 1, first_b[odd], last_b[odd] + 1))):
            texts[at] = ",".join(map(str, list_a[sa:ea])) + "|" + ",".join(map(str, list_b[sb:eb]))
        cuts = np.append(0, np.cumsum(n_groups)).tolist()
        groups = [(texts[a] if b - a == 1 else ";".join(texts[a:b])).encode() for a, b in zip(cuts, cuts[1:])]
        return good, n_a, n_b, n_groups, groups, keys, link_cuts


def _gives_back(ids: list[list[int]], tokens: list[bytes], raw: list[bytes]) -> np.ndarray:
    """Whether the tokens of each chunk join to its bytes; all at once where nothing is amiss."""
    got = [b"".join(map(tokens.__getitem__, i)) for i in ids]
    return np.ones(len(raw), bool) if got == raw and all(ids) else np.array([bool(i) and g == r for i, g, r in zip(ids, got, raw)], bool)


_ALIGNERS: dict[str, Aligner] = {}


def aligner(name: str, first: Callable[[], Vocabulary], second: Callable[[], Vocabulary]) -> Aligner:
    """The worker's aligner of two vocabularies, made once a name."""
    if name not in _ALIGNERS:
        _ALIGNERS[name] = Aligner(first(), second())
    return _ALIGNERS[name]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[int, str]], int]]:
    """Ids of whole documents with (document, part of its text) of about ``BUFFER_CHARS`` in all."""
    keys, parts, size, docs = [], [], 0, 0
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            keys.append(batch.column(0).slice(i, 1))
            if text:
                parts += [(docs, p) for p in text_parts(" " + text, PART_CHARS)]
                size += len(text)
            docs += 1
            if size >= BUFFER_CHARS or docs >= 1 << 16:
                yield pa.concat_arrays(keys), parts, docs
                keys, parts, size, docs = [], [], 0, 0
    if docs:
        yield pa.concat_arrays(keys), parts, docs


def _tally(owner: np.ndarray, place: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, keys[place]) in order and how often each stands."""
    names, number = np.unique(keys, return_inverse=True)
    packed = np.sort(owner * len(names) + number[place]) if len(place) else place
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])[: len(packed)])
    width = max(1, len(names))
    return packed[first] // width, names[packed[first] % width] if len(first) else first, np.diff(np.append(first, len(packed)))


def align_documents(df: DataFrame, id_col: str, text_col: str, first, second, name: str) -> DataFrame:
    """One row a document: counts, digest of its groups, and its links as distinct ids or keys with occurrences.

    ``same_ids`` are A's ids linked to their equal in B, ``odd_keys`` all other pairs. ``row`` is unique
    in the table written from the result.
    """
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_ALIGNED}"
    schema += ", same_ids array<int>, same_n array<int>, odd_keys array<long>, odd_n array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(name, first, second)
        row = TaskContext.get().partitionId() << 36
        for ids, parts, n_docs in _buffers(batches):
            yield _aligned_rows(own, ids, parts, n_docs, row)
            row += n_docs

    return rows.mapInArrow(work, schema)


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _aligned_rows(own: Aligner, ids: pa.Array, parts: list[tuple[int, str]], n_docs: int, row: int) -> pa.RecordBatch:
    chunk_of: dict[str, int] = {}
    number = chunk_of.setdefault
    chunks_of = [(doc, np.array([number(c, len(chunk_of)) for c in _BREAK.split(part)], np.int64)) for doc, part in parts]
    good, n_a, n_b, n_groups, groups, keys, cuts = own.align(list(chunk_of))
    faithful = np.ones(n_docs, bool)
    for doc, chunks in chunks_of:
        faithful[doc] &= bool(good[chunks].all())
    totals = np.zeros((4, n_docs), np.int64)
    digests: list = [None] * n_docs
    owners, found = [], []
    sizes = np.diff(cuts)
    for doc, chunks in chunks_of:
        if not faithful[doc]:
            continue
        totals[:, doc] += [n_a[chunks].sum(), n_b[chunks].sum(), n_groups[chunks].sum(), sizes[chunks].sum()]
        if digests[doc] is None:
            digests[doc] = hashlib.sha256()
        else:
            digests[doc].update(b";")
        digests[doc].update(b";".join(map(groups.__getitem__, chunks.tolist())))
        owners.append(np.full(len(chunks), doc))
        found.append(chunks)
    chunk_list = np.concatenate(found) if found else np.zeros(0, np.int64)
    owner = np.repeat(np.concatenate(owners) if owners else chunk_list, sizes[chunk_list])
    # Positions in ``keys`` of every chunk's links, one chunk after the other.
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[chunk_list]) - sizes[chunk_list], sizes[chunk_list])
    owner, linked, times = _tally(owner, np.repeat(cuts[:-1][chunk_list], sizes[chunk_list]) + within, keys)
    a, b = linked // _ODD, linked % _ODD
    same = own.same[a] == b if len(a) else np.zeros(0, bool)
    names = ["doc_id", "row", *_COUNTS, "groups_sha256", "same_ids", "same_n", "odd_keys", "odd_n"]
    columns = [
        ids,
        pa.array(np.arange(row, row + n_docs)),
        *[pa.array(t) for t in totals],
        pa.array([d.hexdigest() if d else "" for d in digests], pa.string()),
        _lists(owner[same], a[same], n_docs, pa.int32()),
        _lists(owner[same], times[same], n_docs, pa.int32()),
        _lists(owner[~same], linked[~same], n_docs, pa.int64()),
        _lists(owner[~same], times[~same], n_docs, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def same_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(a, n): documents that link an id of A to its equal, from one vector of the vocabulary's length a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["a", "n"])

    return aligned.select("same_ids").mapInArrow(work, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def odd_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): documents that link a pair outside the identity map."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return aligned.select("odd_keys").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _sums(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """Sum of values, which run along the flattened lists, within each list."""
    total = np.append(0, np.cumsum(values))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return total[offsets[1:]] - total[offsets[:-1]]


def score_links(aligned: DataFrame, size: int, head: int = HEAD) -> DataFrame:
    """Documents with n_best and count_sum. ``aligned`` must be a written table: it is read several times.

    ``size`` is the length of A's vocabulary; vectors of that length, and the ``head`` most frequent odd
    pairs, go to every task.
    """
    spark = aligned.sparkSession
    same = np.zeros(size, np.int64)
    for r in same_counts(aligned, size).collect():  # at most one row an id of the vocabulary
        same[r["a"]] = r["n"]
    odd = cut_lineage(odd_counts(aligned))
    highest = same.copy()
    best = odd.groupBy(F.floor(F.col("key") / F.lit(_ODD)).alias("a")).agg(F.max("n").alias("n"))
    for r in best.collect():
        highest[r["a"]] = max(highest[r["a"]], r["n"])
    top = odd.orderBy(F.col("n").desc(), "key").limit(head).collect() if head else []
    top_keys = np.array(sorted((r["key"], r["n"]) for r in top), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((same, highest, top_keys[:, 0].copy(), top_keys[:, 1].copy()))
    id_type = aligned.schema["doc_id"].dataType.simpleString()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, highest, keys, counts = shared.value
        for batch in batches:
            ids, times = (c.flatten().to_numpy() for c in batch.columns[7:9])
            n, n_odd = same[ids], _look_up(keys, counts, batch.column(9).flatten().to_numpy(), 0)
            odd_times = batch.column(10).flatten().to_numpy()
            top = highest[batch.column(9).flatten().to_numpy() // _ODD]
            good = _sums(batch.column(7), times * (n == highest[ids])) + _sums(batch.column(9), odd_times * (n_odd == top))
            sums = _sums(batch.column(7), times * n) + _sums(batch.column(9), odd_times * n_odd)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(good), pa.array(sums)], [*batch.schema.names[:7], "n_best", "count_sum"]
            )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, keys, counts = shared.value
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            row = np.repeat(batch.column(0).to_numpy(), sizes)
            wanted, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            open_ = _look_up(keys, counts, wanted, 0) == 0
            made = [pa.array(row[open_]), pa.array(wanted[open_]), pa.array(times[open_].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(made, ["row", "key", "times"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, highest, keys, counts = shared.value
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            open_ = _look_up(keys, counts, key, 0) == 0
            made = [pa.array(key[open_]), pa.array(n[open_]), pa.array((n == highest[key // _ODD]).astype(np.int64)[open_])]
            yield pa.RecordBatch.from_arrays(made, ["key", "n", "best"])

    docs = aligned.mapInArrow(known, f"doc_id {id_type}, {_ALIGNED}, n_best long, count_sum long")
    open_links = aligned.select("row", "odd_keys", "odd_n").mapInArrow(rest, "row long, key long, times long")
    counts = odd.mapInArrow(judged, "key long, n long, best long")
    more = open_links.join(counts, "key").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    return docs.join(more, "row", "left").select(
        "doc_id", *_COUNTS,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def align_corpus(
    df: DataFrame, id_col: str, text_col: str, byte_path: str, pattern: str, piece_path: str, head: int = HEAD
) -> DataFrame:
    """Align a table of texts under a byte-level file (A) and a sentencepiece model (B), and score its links."""
    first, second = byte_level_vocabulary(byte_path, pattern), piece_vocabulary(piece_path)
    aligned = cut_lineage(align_documents(df, id_col, text_col, first, second, f"{byte_path}|{piece_path}"))
    return score_links(aligned, len(first()[0]), head)
