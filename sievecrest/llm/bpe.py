"""Byte-level BPE by replaying merges over a corpus of distinct words.

A task gathers the distinct words of many texts and merges them together. An index holds, for each
pair of neighbouring tokens, the positions where it stands; pairs are taken in rank order, each is
merged everywhere at once, and only the two neighbours of each merged position get new pairs, which
join the index. Work follows the merges that happen, not the length of a word times its merges, so
one very long word costs no more than as many short ones.

A word that would get a pair of lower rank than the one at hand while that one still stands further
right is encoded on its own, step by step, as the order inside it would matter.

Texts are cut into chunks before single spaces between visible characters, where no token can cross;
distinct chunks are split by the pattern once. Buffers are bounded by bytes and hold whole texts or,
for long texts, parts cut at such places.

Nulls and ties: a null text is an empty one, without ids; equal rows are encoded alike; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches
from sievecrest.llm.vocab import load_ranks

BUFFER_CHARS = 1 << 23
_BREAK = re.compile(r"(?<=\S)(?= \S)")
_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Ranks of tokens and of all pairs of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i).encode() for i in range(self.size)]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted(
            (ranks[token[:i]] * self.size + ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        )
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([r for _, r in pairs], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def step_by_step(self, word: bytes) -> list[int]:
        """One word alone: always the leftmost pair of least rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


def replay_merges(words: list[bytes], table: MergeTable) -> list[list[int]]:
    """Ids of every word."""
    out: list[list[int]] = [[]] * len(words)
    rest = []
    for i, word in enumerate(words):
        whole = table.ranks.get(word)
        if whole is None:
            rest.append(i)
        else:
            out[i] = [whole]
    if not rest:
        return out
    lengths = np.array([len(words[i]) for i in rest])
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    token = table.of_byte[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)]
    owner = np.repeat(np.arange(len(rest)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    pair = np.full(n, _NONE, np.int32)  # rank of the pair that starts at a position
    alive = np.ones(n, bool)
    odd = np.zeros(len(rest), bool)  # words whose inner order matters
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Rank the pairs that start at these positions and add them to the index."""
        found = table.pair_ranks(token[positions], token[after[positions]])
        pair[positions] = found
        real = found != _NONE
        found, positions = found[real], positions[real]
        order = np.argsort(found, kind="stable")
        found, positions = found[order], positions[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for rank, some in zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(positions, cuts)):
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(some)

    enter(np.flatnonzero(after >= 0))
    while queue:
        rank = heapq.heappop(queue)
        at = np.concatenate(index.pop(rank))
        at = np.sort(at[pair[at] == rank])
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        if not len(at):
            continue
        # In a chain of overlapping pairs take every second, from the left.
        linked = np.zeros(len(at), bool)
        linked[1:] = before[at[1:]] == at[:-1]
        head = np.flatnonzero(~linked)
        nth = np.arange(len(at)) - head[np.cumsum(~linked) - 1]
        at = at[nth % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        token[at] = rank
        alive[gone] = False
        pair[gone] = pair[at] = _NONE
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        touched = np.concatenate([at[beyond >= 0], before[at][before[at] >= 0]])
        if len(touched):
            enter(touched)
            low = touched[pair[touched] < rank]
            odd[owner[low]] = True
    kept = np.flatnonzero(alive)
    cut = np.searchsorted(owner[kept], np.arange(len(rest) + 1)).tolist()
    ids = token[kept].tolist()
    for j, i in enumerate(rest):
        out[i] = ids[cut[j] : cut[j + 1]]
    for j in np.flatnonzero(odd):
        out[rest[j]] = table.step_by_step(words[rest[j]])
    return out


class CorpusEncoder:
    """Encodes lists of texts; each distinct chunk and word of a list is handled once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.table = MergeTable(ranks)
        self.find = regex.compile(pattern).findall

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The chunk numbers of every text, and the ids of every distinct chunk."""
        chunk_of: dict[str, int] = {}
        number = chunk_of.setdefault
        texts_in_chunks = [[number(c, len(chunk_of)) for c in _BREAK.split(t)] if t else [] for t in texts]
        word_of: dict[str, int] = {}
        chunks = [[word_of.setdefault(w, len(word_of)) for w in self.find(c)] for c in chunk_of]
        ids = replay_merges([w.encode("utf-8", "surrogatepass") for w in word_of], self.table)
        return texts_in_chunks, [ids[c[0]] if len(c) == 1 else [i for w in c for i in ids[w]] for c in chunks]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], CorpusEncoder] = {}


def encoder(path: str, pattern: str) -> CorpusEncoder:
    """The worker's encoder for a rank file, loaded once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = CorpusEncoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``BUFFER_CHARS`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids.append(batch.column(0)[i])
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BUFFER_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def encode_documents(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    return _encoded(df, id_col, text_col, path, pattern, "ids array<int>", _ids_column)


def round_trip_digests(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(df, id_col, text_col, path, pattern, schema, _digest_columns)


def _ids_column(coder: CorpusEncoder, texts: list[list[int]], chunks: list[list[int]]) -> list[pa.Array]:
    return [pa.array([[i for c in t for i in chunks[c]] for t in texts], pa.list_(pa.int32()))]


def _digest_columns(coder: CorpusEncoder, texts: list[list[int]], chunks: list[list[int]]) -> list[pa.Array]:
    digits = [b" ".join(map(coder.table.decimals.__getitem__, ids)) for ids in chunks]
    plain = [coder.decode(ids) for ids in chunks]
    sizes = np.array([len(ids) for ids in chunks], np.int64)
    counts = [int(sizes[t].sum()) if t else 0 for t in texts]
    said = [hashlib.sha256(b" ".join(map(digits.__getitem__, t))).hexdigest() for t in texts]
    decoded = [hashlib.sha256(b"".join(map(plain.__getitem__, t))).hexdigest() for t in texts]
    return [pa.array(counts, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, schema: str, columns) -> DataFrame:
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for ids, texts in _buffers(batches):
            made = columns(coder, *coder.encode(texts))
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), *made], names)

    return rows.mapInArrow(work, f"doc_id {id_type}, {schema}")
