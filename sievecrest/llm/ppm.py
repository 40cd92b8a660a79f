"""Scoring texts by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the byte that
followed, learned from the training texts. A byte is predicted in the longest context seen; if it
never followed there, the escape probability (method D: half the distinct followers over the
occurrences; a follower seen c times keeps c - 1/2) is paid and the next shorter context predicts it,
with every byte the longer context knew left out. Below order 0 all bytes not yet seen are equally likely.

The probability of a byte depends on it and the ``ORDER`` bytes before it alone, so a text's score is
a sum over its windows of ``ORDER + 1`` bytes, and the trie is a table of distinct packed windows with
their counts. Counts with longer contexts sum to those with shorter ones, hence the bytes that a
longer context knew are known to the shorter one and exclusion is a subtraction of sums. One shuffle
brings windows together whose contexts end in the same ``SPLIT`` bytes: all longer contexts that a
window can fall back to lie there. The few shorter ones are tables of their own.

Windows (and words, for the base score) are many. The most frequent ones, at most ``HEAD`` of either
kind by a count taken first, are broadcast and looked up in hash tables; a text's other windows and
words are joined with their table by Spark. Nothing is dropped, and no key with many rows reaches a
join. A text that a task meets again refers to the first row that has it there.

A text begins after ``ORDER`` start bytes and ends with an end byte; neither occurs in UTF-8. Words
are keyed by 63 bits of their hash with the sign bit set, so one column holds keys of both kinds.

Nulls and ties: a null text is an empty one, scored by its end alone; equal texts score alike; equal
rows are separate rows; without any training text every byte and token has its smallest probability;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.llm.common import segments, small_batches, text_bytes
from sievecrest.session import cut_lineage

ORDER = 6
START, END = b"\xfe", b"\xff"
SYMBOLS = 255  # all bytes but the start byte
SPLIT = 3  # contexts from this many bytes on are settled beside each other
GROUP_ROWS = 1 << 18
HEAD = 1 << 20
PART = 1 << 22
_EMPTY = np.iinfo(np.int64).min


def held_out(id_col: Column) -> Column:
    """Rows that are scored but never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 10 == 0


def framed(text: bytes) -> bytes:
    return START * ORDER + text.lower() + END


def window_codes(part: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and packed bytes of every window of every part."""
    lengths = np.array([len(b) for _, b in part])
    raw = np.frombuffer(b"".join(b for _, b in part), np.uint8)
    n = len(raw) - ORDER
    codes = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        codes <<= 8
        codes |= raw[i : i + n]
    inside = np.ones(len(raw), bool)
    inside[(np.cumsum(lengths)[:, None] - np.arange(1, ORDER + 1)[None, :]).ravel()] = False
    owner = np.repeat(np.array([i for i, _ in part]), lengths - ORDER)
    return owner, codes[inside[:n]]


def word_keys(words) -> np.ndarray:
    """Negative keys; those of windows are not negative."""
    digest = xxhash.xxh64_intdigest
    return (np.array([digest(w) for w in words], np.uint64) | np.uint64(1 << 63)).view(np.int64)


def _rows(keys: np.ndarray, trained: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, trained, found)], ["key", "trained", "found"])


def count_keys(rows: DataFrame) -> DataFrame:
    """(key, trained, found) of all windows and words: occurrences in training texts and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, out in _buffers(batches):
            out = np.array(out)
            for chosen, learn in ((np.flatnonzero(~out), 1), (np.flatnonzero(out), 0)):
                some = [docs[i] for i in chosen]
                words: Counter[bytes] = Counter()
                for doc in some:
                    words.update(doc.lower().split())
                words[b""] = len(some)
                if some:
                    n = np.array(list(words.values()), np.int64)
                    yield _rows(word_keys(words), n * learn, n)
                for part in segments([framed(d) for d in some], PART, ORDER):
                    keys, n = np.unique_counts(np.sort(window_codes(part)[1]))
                    yield _rows(keys, n * learn, n)

    counted = rows.select("text", "held_out").mapInArrow(count, "key long, trained long, found long")
    return counted.groupBy("key").agg(F.sum("trained").alias("trained"), F.sum("found").alias("found"))


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bool]]]:
    docs, out, size = [], [], 0
    for batch in batches:
        for text, held in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
            docs.append(text)
            out.append(bool(held))
            size += len(text)
            if size >= PART:
                yield docs, out
                docs, out, size = [], [], 0
    if docs:
        yield docs, out


def follows(count: Column, n: Column) -> Column:
    """Probability of a byte that followed ``count`` of ``n`` times."""
    return (2 * count - 1) / (2 * n)


def _suffix(key: Column, n_bytes: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1).cast("long"))


def _mask(n_bytes: int) -> int:
    return (1 << (8 * n_bytes)) - 1


class Trie:
    """Levels ``ORDER`` down to ``SPLIT`` of all contexts that end in some set of ``SPLIT`` bytes.

    ``keys`` are the distinct trained windows, ``counts`` their occurrences and ``low`` the occurrences
    of their last ``SPLIT`` bytes anywhere: what their followers count one order below the split.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: np.ndarray):
        order = np.argsort(keys)
        entries, counts, low = keys[order], counts[order], low[order]
        self.levels = {}
        for k in range(ORDER, SPLIT - 1, -1):
            if k > SPLIT:
                shorter, to = np.unique(entries & _mask(k), return_inverse=True)
                short_counts = np.bincount(to, weights=counts, minlength=len(shorter)).astype(np.int64)
                short_low = np.zeros(len(shorter), np.int64)
                short_low[to] = low
                below = short_counts[to]
            else:
                below = low
            first = np.flatnonzero(np.append(True, np.diff(entries >> 8) != 0)) if len(entries) else np.zeros(0, np.int64)
            figures = [np.add.reduceat(c, first) if len(first) else c for c in (counts, np.ones_like(counts), below)]
            self.levels[k] = entries, counts, entries[first] >> 8, figures
            if k > SPLIT:
                entries, counts, low = shorter, short_counts, short_low

    @staticmethod
    def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return place, table[place] == keys

    def values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: log10 probability so far, whether it is complete, and what the shortest context here excludes."""
        value, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left_out = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]  # occurrences, followers
        for k in range(ORDER, SPLIT - 1, -1):
            entries, counts, contexts, (n, q, below) = self.levels[k]
            at, known = self._at(contexts, (keys >> 8) & _mask(k))
            place, hit = self._at(entries, keys & _mask(k + 1))
            some = np.flatnonzero(known & ~done)
            n_left = n[at[some]] - left_out[0][some]
            q_left = q[at[some]] - left_out[1][some]
            follows_ = hit[some]
            top = np.where(follows_, 2 * counts[place[some]] - 1, q_left)
            paid = top > 0
            value[some[paid]] += np.log10(top[paid] / (2 * n_left[paid]))
            done |= hit
            left_out = [np.where(known, f[at] if len(f) else 0, 0) for f in (below, q)]
        return value, done, *left_out


def deep_values(windows: DataFrame) -> DataFrame:
    """(key, found, value, done, low, q, low_c) of (key, trained, found, low_c): the orders from ``SPLIT`` on.

    All windows whose contexts share their last ``SPLIT`` bytes meet in one partition, side by side, so a
    task holds ``GROUP_ROWS`` distinct windows and the rest of the last such group at a time.
    """
    tail = _suffix(F.shiftright("key", 8), SPLIT)
    near = windows.withColumn("tail", tail).repartition("tail").sortWithinPartitions("tail")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            key, trained, found, low, end = (np.concatenate(c) for c in zip(*held))
            cut = len(key) if last else int(np.searchsorted(end, end[-1]))
            held, size = ([] if last else [[c[cut:] for c in (key, trained, found, low, end)]]), len(key) - cut
            key, trained, found, low = key[:cut], trained[:cut], found[:cut], low[:cut]
            seen = trained > 0
            value, done, below, q = Trie(key[seen], trained[seen], low[seen]).values(key)
            columns = [key, found, value, done, below, q, low]
            for at in range(0, cut, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], _DEEP)

        limit = GROUP_ROWS
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= limit:
                yield from groups(False)
                limit = max(GROUP_ROWS, 2 * size)  # a group larger than that is not looked at batch by batch
        if held:
            yield from groups(True)

    schema = "key long, found long, value double, done boolean, low long, q long, low_c long"
    return near.select("key", "trained", "found", "low_c", "tail").mapInArrow(score, schema)


_DEEP = ["key", "found", "value", "done", "low", "q", "low_c"]


def window_scores(counts: DataFrame) -> DataFrame:
    """(key, found, value) of every window: log10 of the probability of its last byte after the others.

    Orders from ``SPLIT`` on are settled where their contexts meet; the tables of the shorter ones are
    small (their keys have at most ``SPLIT`` bytes) and joined.
    """
    windows = counts.where(F.col("key") >= 0)
    low = F.col("key").alias("_key"), F.col("c").alias("low_c")
    level: dict[int, DataFrame] = {}
    trained = windows.where("trained > 0").select(_suffix(F.col("key"), SPLIT).alias("key"), F.col("trained").alias("c"))
    for k in range(SPLIT - 1, -1, -1):
        up = trained if k == SPLIT - 1 else level[k + 1].select(_suffix(F.col("key"), k + 1).alias("key"), "c")
        level[k] = cut_lineage(up.groupBy("key").agg(F.sum("c").alias("c")))
    contexts: dict[int, DataFrame] = {}
    for k in range(SPLIT - 1, -1, -1):
        known = level[k]
        if k:  # what the followers of this context count in the next shorter one
            known = known.join(level[k - 1].select(*low), _suffix(F.col("key"), k) == F.col("_key"))
        else:
            known = known.withColumn("low_c", F.lit(0).cast("long"))
        known = known.groupBy(F.shiftright("key", 8).alias("_ctx")).agg(
            F.struct(F.sum("c").alias("n"), F.count(F.lit(1)).alias("q"), F.sum("low_c").alias("low")).alias(f"ctx{k}")
        )
        contexts[k] = cut_lineage(known)
    lows = level[SPLIT - 1].select(*low)
    windows = windows.join(lows, _suffix(F.col("key"), SPLIT) == F.col("_key"), "left")
    rows = deep_values(windows.select("key", "trained", "found", F.coalesce("low_c", F.lit(0)).alias("low_c")))
    rows = rows.withColumn(f"ctx{SPLIT}", F.struct("low", "q"))
    rows = rows.withColumn(f"c{SPLIT - 1}", F.when(F.col("low_c") > 0, F.col("low_c")))
    for k in range(SPLIT - 1, -1, -1):
        rows = rows.join(contexts[k], _suffix(F.shiftright("key", 8), k) == F.col("_ctx"), "left").drop("_ctx")
        if k < SPLIT - 1:
            table = level[k].select(F.col("key").alias("_key"), F.col("c").alias(f"c{k}"))
            rows = rows.join(table, _suffix(F.col("key"), k + 1) == F.col("_key"), "left").drop("_key")
    value, done = F.col("value"), F.col("done")
    for k in range(SPLIT - 1, -1, -1):
        here, above, hit = F.col(f"ctx{k}"), F.col(f"ctx{k + 1}"), F.col(f"c{k}")
        n = here["n"] - F.coalesce(above["low"], F.lit(0))
        q = here["q"] - F.coalesce(above["q"], F.lit(0))
        step = F.when(done | here.isNull(), 0.0).when(hit.isNotNull(), F.log10(follows(hit, n)))
        value = value + step.when(q > 0, F.log10(q / (2 * n))).otherwise(0.0)
        done = done | hit.isNotNull()
    symbols = F.lit(SYMBOLS) - F.coalesce(F.col("ctx0.q"), F.lit(0))
    value = value + F.when(done, 0.0).otherwise(-F.log10(F.greatest(symbols, F.lit(1))))
    return rows.select("key", "found", value.alias("value"))


class Lookup:
    """Open-addressed table from long keys to doubles, filled and read in whole arrays.

    It travels as its keys and values; every Python worker fills its own table.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.given = keys, values
        self.bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.keys = np.full(1 << self.bits, _EMPTY, np.int64)
        self.values = np.zeros(1 << self.bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == _EMPTY
            winner = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[winner]
            self.keys[at[put]] = keys[left[put]]
            self.values[at[put]] = values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def __reduce__(self):
        return Lookup, self.given

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is in the table."""
        at = self._home(keys)
        held = self.keys[at]
        values = self.values[at]
        hit = held == keys
        open_ = np.flatnonzero(~hit & (held != _EMPTY))
        place = at[open_]
        while len(open_):
            place = (place + 1) & ((1 << self.bits) - 1)
            held = self.keys[place]
            same = held == keys[open_]
            values[open_[same]] = self.values[place[same]]
            hit[open_[same]] = True
            more = ~same & (held != _EMPTY)
            open_, place = open_[more], place[more]
        return np.where(hit, values, 0.0), hit


def frequent_table(table: DataFrame, limit: int) -> Lookup:
    """The most frequent keys, at most ``limit``: a histogram of counts says where to cut."""
    size = F.floor(F.log2("found") * 8).cast("int").alias("size")
    histogram = sorted(((r["size"], r["n"]) for r in table.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    cut, total = None, 0
    for least, n in histogram:
        total += n
        if total > limit:
            break
        cut = least
    if cut is None:
        return Lookup(np.zeros(0, np.int64), np.zeros(0))
    head = table.where(F.floor(F.log2("found") * 8) >= cut).select("key", F.col("value").cast("double")).toArrow()
    return Lookup(head.column(0).to_numpy(), head.column(1).to_numpy())


def _tail(owner: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences by (owner, key)."""
    order = np.lexsort((keys, owner))
    owner, keys, n = owner[order], keys[order], n[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(keys) else order
    return owner[first], keys[first], np.add.reduceat(n, first) if len(first) else n


def score_texts(df: DataFrame, id_col: str, text_col: str, out_col: Column, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``out_col`` says which rows are held out of training.
    """
    rows = small_batches(df).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(out_col, F.lit(False)).alias("held_out")
    )
    counts = cut_lineage(count_keys(rows))
    words = counts.where(F.col("key") < 0).select("key", "found", F.col("trained").cast("double").alias("value"))
    sums = words.agg(F.sum("value").alias("n"), F.count_if(F.col("value") > 0).alias("v")).first()
    train_tokens, vocabulary = int(sums["n"] or 0), int(sums["v"] or 0)
    windows = cut_lineage(window_scores(counts))
    below = train_tokens + 0.1 * (vocabulary + 1)
    tables = rows.sparkSession.sparkContext.broadcast((frequent_table(windows, head), frequent_table(words, head // 2)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window_table, word_table = tables.value
        next_row = TaskContext.get().partitionId() << 33
        first_row: dict[int, int] = {}  # of a text in this task
        for batch in batches:
            docs = text_bytes(batch.column(1))
            row = np.arange(next_row, next_row + len(docs))
            next_row += len(docs)
            same = np.array([first_row.setdefault(xxhash.xxh3_128_intdigest(d), r) for d, r in zip(docs, row.tolist())], np.int64)
            fresh = same == row
            known, base, value = (np.zeros(len(docs)) for _ in range(3))
            rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def look(table: Lookup, owner: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                found, hit = table.find(keys)
                miss = ~hit & fresh[owner]
                rare.append(_tail(owner[miss], keys[miss], n[miss]))
                return found, hit

            def total(owner: np.ndarray, weights: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=weights, minlength=len(docs))

            for part in segments([framed(d) for d in docs], PART, ORDER):
                owner, keys = window_codes(part)
                value += total(owner, look(window_table, owner, keys, np.ones(len(keys), np.int64))[0])
            bags = [Counter(d.lower().split()) for d in docs]
            for bag in bags:
                bag[b""] = 1
            owner = np.repeat(np.arange(len(docs)), [len(b) for b in bags])
            n = np.concatenate([np.fromiter(b.values(), np.int64, len(b)) for b in bags])
            found, hit = look(word_table, owner, word_keys(w for b in bags for w in b), n)
            known += total(owner, n * (hit & (found > 0)))
            base += total(owner, np.where(hit, n * np.log10((found + 0.1) / below), 0.0))
            tokens = total(owner, n).astype(np.int64)
            yield _scored(batch, row, same, tokens, known.astype(np.int64), base, value)
            for owner, keys, n in rare:
                if len(keys):
                    yield _rare(batch, row[owner], keys, n)

    schema = (
        f"doc_id {id_type}, held_out boolean, row long, same long, key long, n long, "
        "n_tokens long, n_known long, base double, value double"
    )
    found = cut_lineage(rows.mapInArrow(score, schema))
    known_values = windows.select("key", F.col("value").alias("v")).unionByName(words.select("key", F.col("value").alias("v")))
    rare = found.where(F.col("key").isNotNull()).select("row", "key", "n").join(known_values, "key")
    is_word, n = F.col("key") < 0, F.col("n")
    more = rare.groupBy("row").agg(
        F.sum(F.when(is_word, n * F.log10((F.col("v") + 0.1) / F.lit(below))).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(is_word & (F.col("v") > 0), n).otherwise(0)).alias("more_known"),
        F.sum(F.when(is_word, 0.0).otherwise(n * F.col("v"))).alias("more_value"),
    )
    texts = found.where(F.col("key").isNull()).drop("row", "key", "n")
    whole = texts.join(more.withColumnRenamed("row", "same"), "same", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("value") + F.coalesce("more_value", F.lit(0.0))).alias("score"),
    )


_FIELDS = ["doc_id", "held_out", "row", "same", "key", "n", "n_tokens", "n_known", "base", "value"]


def _scored(batch: pa.RecordBatch, row, same, tokens, known, base, value) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    columns = [pa.array(row), pa.array(same), none, none, *map(pa.array, (tokens, known, base, value))]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], _FIELDS)


def _rare(batch: pa.RecordBatch, row, keys, n) -> pa.RecordBatch:
    size = len(keys)
    empty = [pa.nulls(size, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    columns = [pa.nulls(size, batch.column(0).type), pa.nulls(size, pa.bool_()), pa.array(row), pa.nulls(size, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(keys), pa.array(n), *empty], _FIELDS)
