"""BPE with word ends by speculation: propose greedily, check neighbours, merge exactly only what fails.

A task gathers the distinct words of many texts. For every byte of all of them the longest token that
starts there is found at once by walking a token trie in step; following these jumps proposes tokens
for every word. A proposal is what the merges would give exactly if every pair of neighbours is
compatible: encoded together, no merge would cross their border. Compatibility is settled for all
distinct pairs at once by undoing the later merge of the two tokens at the border, step by step, and
asking whether the merge across it would have come earlier. Only words with an incompatible pair are
merged one by one, with a queue of merges, so a long word costs n log n.

The check needs merges that are made of earlier ones and give each token once; a vocabulary without
this property is refused.

Words are found as the vocabulary's own file says: strings of its special tokens first, then its
normaliser and pre-tokeniser. Chunks between spaces never share a word, so each distinct chunk of a
buffer is taken apart once; plain ASCII chunks need lower-casing and the word pattern only.

Nulls and ties: a null text is an empty one, without ids and with an empty decoding; equal rows are
encoded alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import small_batches, text_buffers

BUFFER_CHARS = 1 << 23
KNOWN_CHUNKS = 1 << 19
_SCAN = 48  # bytes up to which a scan for the next merge beats a queue of merges
#: Characters that normalising leaves as they are but for lower-casing one by one.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+").fullmatch
_END = 256  # symbol after the last byte of a word
_WIDTH = 257
_NEVER = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTable:
    """Merges, tokens and the token trie of a vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], suffix: str):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        size = max(vocab.values()) + 1
        self.size = size
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        made = np.full(size, -1, np.int64)  # rank of the merge that gives a token, -1 for single symbols
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if made[token] >= 0:
                raise ValueError(f"merge {rank} gives a token that an earlier one gives")
            left[token], right[token], made[token] = vocab[a], vocab[b], rank
        self.left, self.right, self.made = left, right, made
        rows = np.flatnonzero(made >= 0)
        if (np.maximum(made[left[rows]], made[right[rows]]) >= made[rows]).any():
            raise ValueError("a merge uses a token that a later one gives")
        keys = left[rows] * size + right[rows]
        order = np.argsort(keys)
        self.pair_keys, self.pair_made, self.pair_token = keys[order], made[rows][order], rows[order]
        self.merge_of = {(int(left[t]), int(right[t])): (int(made[t]), int(t)) for t in rows}
        self.of_byte, self.of_last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        symbols: dict[int, list[int]] = {}
        for text, token in vocab.items():
            ends = text.endswith(suffix)
            found = [byte_of.get(c, -1) for c in (text[: -len(suffix)] if ends else text)]
            if not found or min(found) < 0:
                continue
            if len(found) == 1 and made[token] < 0:
                (self.of_last if ends else self.of_byte)[found[0]] = token
            symbols[token] = [*found, _END] if ends else found
        if min(self.of_byte.min(), self.of_last.min()) < 0:
            raise ValueError("the vocabulary lacks a single byte, inside or at the end of a word")
        self.byte_ids, self.last_ids = self.of_byte.tolist(), self.of_last.tolist()
        self._grow_trie({t: s for t, s in symbols.items() if made[t] < 0 or self._whole()[t]})

    def _whole(self) -> np.ndarray:
        """Whether the merges, applied to a token's own bytes, give that token back."""
        if not hasattr(self, "_is_whole"):
            whole = np.ones(self.size, bool)
            rows = np.flatnonzero(self.made >= 0)
            rows = rows[np.argsort(self.made[rows])]
            fits = self.compatible(self.left[rows], self.right[rows], self.made[rows])
            for token, ok in zip(rows.tolist(), fits.tolist()):
                whole[token] = ok and whole[self.left[token]] and whole[self.right[token]]
            self._is_whole = whole
        return self._is_whole

    def _grow_trie(self, symbols: dict[int, list[int]]) -> None:
        edges: dict[int, int] = {}
        held = [-1]
        for token, path in symbols.items():
            node = 0
            for s in path:
                key = node * _WIDTH + s
                if key not in edges:
                    edges[key] = len(held)
                    held.append(-1)
                node = edges[key]
            held[node] = token
        order = sorted(edges)
        self.edge_keys = np.array(order, np.int64)
        self.edge_to = np.array([edges[k] for k in order], np.int64)
        self.token_at = np.array(held, np.int64)

    def longest_tokens(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token at every position and its length in symbols; -1 and 0 at word ends.

        A token may reach the last byte of a word only together with the word's end.
        """
        n = len(symbols)
        token, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = node * _WIDTH + symbols[at + depth]
            place = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[place] == key
            at, node = at[hit], self.edge_to[place[hit]]
            depth += 1
            last = symbols[at + depth - 1] == _END
            ahead = symbols[np.minimum(at + depth, n - 1)]
            held = self.token_at[node]
            good = (held >= 0) & (last | (ahead != _END))
            token[at[good]], length[at[good]] = held[good], depth
            at, node = at[~last], node[~last]
        return token, length

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether two neighbouring tokens would arise side by side, with no earlier merge across their border.

        ``limit`` is the rank before which such a merge would have to come; without it any merge counts.
        """
        good = np.ones(len(left), bool)
        row = np.arange(len(left))
        limit = np.full(len(left), _NEVER) if limit is None else limit.copy()
        while len(row):
            key = left * self.size + right
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[place] == key, self.pair_made[place], _NEVER)
            crossed = across < limit
            good[row[crossed]] = False
            made_l, made_r = self.made[left], self.made[right]
            # The later merge is undone; of equal ones the right, as merges run from the left.
            undo_left = made_l > made_r
            limit = np.where(undo_left, made_l, made_r + 1)
            open_ = ~crossed & (np.maximum(made_l, made_r) >= 0)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
            row, left, right, limit = row[open_], left[open_], right[open_], limit[open_]
        return good

    def merge_exactly(self, word: bytes) -> list[int]:
        """One word by the merges themselves: always the leftmost pair of least rank."""
        ids = [self.byte_ids[b] for b in word[:-1]]
        ids.append(self.last_ids[word[-1]])
        if len(ids) > _SCAN:
            return self._merge_queued(ids)
        rank_of, never = self.merge_of.get, (_NEVER, -1)
        ranks = [rank_of(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least is never:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [least[1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), never)
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), never)
        return ids

    def _merge_queued(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            found = self.merge_of.get((ids[i], ids[j])) if j >= 0 else None
            if found:
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids) - 1):
            push(i)
        while queue:
            _, i, a, b, token = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = token, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of every (non-empty) word, and how many words the proposal failed for."""
        if not words:
            return [], 0
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(sizes)
        symbols = np.full(int(ends[-1]), _END, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        symbols[inner] = np.frombuffer(b"".join(words), np.uint8)
        token, length = self.longest_tokens(symbols)
        jump = (np.arange(len(symbols)) + length).tolist()
        starts, at, n = [], 0, len(symbols)
        while at < n:
            starts.append(at)
            at = jump[at]
        ids = token[starts]
        owner = np.searchsorted(ends, starts, "right")
        same = owner[1:] == owner[:-1]
        pairs, back = np.unique(ids[:-1][same] * self.size + ids[1:][same], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.ones(0, bool)
        failing = np.unique(owner[:-1][same][~fits])
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        flat = ids.tolist()
        out = [flat[cuts[i] : cuts[i + 1]] for i in range(len(words))]
        for i in failing.tolist():
            out[i] = self.merge_exactly(words[i])
        return out, len(failing)


class WordEncoder:
    """Texts to ids and back by a vocabulary file, each distinct chunk and word of a list handled once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or not model.get("end_of_word_suffix"):
            raise ValueError("expected a BPE vocabulary with word ends, without dropout")
        own = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.decoder = own.normalizer, own.pre_tokenizer, spec.get("decoder")
        if self.decoder is not None:
            raise ValueError("decoding is by single spaces between tokens; the file names a decoder")
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.table = WordTable(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, list[int]] = {}  # ids of chunks met in earlier buffers
        self.strings = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for text, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = text

    def _words(self, chunk: str) -> list[bytes]:
        if _PLAIN(chunk):
            low = chunk.lower()
            return [low.encode()] if low.isalpha() else [w.encode() for w in self.find(low)]
        marked = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk)) if chunk else []
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in marked]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end."""
        chunk_of: dict[str, int] = {}
        texts_in_chunks = [[chunk_of.setdefault(c, len(chunk_of)) for c in t.split(" ")] if t else [] for t in texts]
        if len(self.known) > KNOWN_CHUNKS:
            self.known.clear()
        fresh = [c for c in chunk_of if c not in self.known]
        word_of: dict[bytes, int] = {}
        parsed: list[list[int]] = []  # numbers of words; specials as -1 - id
        for chunk in fresh:
            found: list[int] = []
            for part in self.at_special.split(chunk) if self.special else [chunk]:
                if part in self.special:
                    found.append(-1 - self.special[part])
                elif part:
                    found += [word_of.setdefault(w, len(word_of)) for w in self._words(part)]
            parsed.append(found)
        ids, _ = self.table.encode_words(list(word_of))
        made = (ids[c[0]] if len(c) == 1 and c[0] >= 0 else [i for w in c for i in (ids[w] if w >= 0 else [-1 - w])] for c in parsed)
        self.known.update(zip(fresh, made))
        chunks = [self.known[c] for c in chunk_of]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = np.fromiter(chain.from_iterable(chunks), np.uint32, int(sizes.sum()))
        order = np.fromiter(chain.from_iterable(texts_in_chunks), np.int64, sum(map(len, texts_in_chunks)))
        lengths = sizes[order]
        ends = np.append(0, np.cumsum(lengths))
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[order] - ends[:-1], lengths)
        return flat[at], ends[np.append(0, np.cumsum(list(map(len, texts_in_chunks))))]

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_documents(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    return _encoded(df, id_col, text_col, path, "ids array<int>", _ids_column)


def decode_documents(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """(doc_id, text): tokens with single spaces between them, special ones included; null for null ids."""
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip_digests(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both.

    Ids are digested as little-endian unsigned 32-bit integers, decoded texts in UTF-8.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(df, id_col, text_col, path, schema, _digest_columns)


def _ids_column(coder: WordEncoder, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))]


def _digest_columns(coder: WordEncoder, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    packed = memoryview(ids.astype("<u4").tobytes())
    flat = ids.tolist()
    pairs = list(zip(cuts.tolist(), cuts[1:].tolist()))
    said = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in pairs]
    decoded = [hashlib.sha256(coder.decode(flat[a:b]).encode()).hexdigest() for a, b in pairs]
    return [pa.array(np.diff(cuts)), pa.array(said, pa.string()), pa.array(decoded, pa.string())]


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, schema: str, columns) -> DataFrame:
    rows = small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for ids, texts in text_buffers(batches, BUFFER_CHARS):
            yield pa.RecordBatch.from_arrays([ids, *columns(coder, *coder.encode(texts))], names)

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
