"""Phrase counts by prefix-free parsing against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievecrest.llm import phrases
from sievecrest.session import cut_lineage

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(A_TO_Z)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_counts(rows, longest=5):
    count = Counter()
    for text, lang in rows:
        for ws in pieces_of(text):
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    count[lang or "und", tuple(ws[i : i + m])] += 1
    return count


def plain_collocations(rows, least, top):
    count = plain_counts(rows)
    total = Counter()
    for (lang, p), f in count.items():
        total[lang] += f * (len(p) == 1)
    found = {}
    frequent = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in frequent.items():
        inside = any(
            l == lang and len(q) > len(p) and 100 * f >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (l, q), f in frequent.items()
        )
        if inside:
            continue
        score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    for lang, rows_ in found.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            yield lang, rank, p.decode(), -a, l, r, total[lang], -s


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "The", "of", "new", "york", "city", "É", "ß", "日本", "a", "x1"])
    texts = ["".join(word() + rnd.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x1c"]) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    texts += ["New York City of the new\tworld order, today"] * 15 + ["a " * 500, "a" * 20000 + " b c", "x. " * 40, " \t ", ",;:", None, ""]
    return [(t, rnd.choice(["en", "en", "fr", None, "und"])) for t in texts]


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, 7, "c") for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string, n int, chunk string")


@pytest.mark.parametrize("seed, least, top", [(1, 3, 2000), (2, 12, 5)])
def test_collocations_equal_plain_ones(spark, seed, least, top, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", 4 + 12 * seed)  # a small bitmap lets too much pass, never too little
    rows = corpus(seed)
    got = phrases.collocations(table(spark, rows).repartition(3), "text", "lang", min_count=least, top=top).collect()
    want = list(plain_collocations(rows, least, top))
    assert len(want) > 5 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("longest, trigger, most", [(5, 16, 64), (5, 1, 64), (3, 4, 3), (1, 2, 5), (5, 10**6, 7)])
def test_every_phrase_belongs_to_one_chunk(longest, trigger, most, monkeypatch):
    monkeypatch.setattr(phrases, "TRIGGER", trigger)
    monkeypatch.setattr(phrases, "MOST_WORDS", most)
    rows = corpus(3)
    got = Counter()
    for text, _ in rows:
        for (chunk, own), n in phrases.parse([(text or "").encode().lower()], longest).items():
            ws = [(w, k) for k, piece in enumerate(chunk.decode().split(" \n ")) for w in piece.split(" ")]
            assert 0 < own <= len(ws) <= own + longest - 1 and own <= most
            for m in range(1, longest + 1):
                for i in range(min(own, len(ws) - m + 1)):
                    if ws[i][1] == ws[i + m - 1][1]:
                        got["x", tuple(w for w, _ in ws[i : i + m])] += n
    assert got == plain_counts([(t, "x") for t, _ in rows], longest)


def test_copies_share_their_chunks(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(900))
    once = phrases.chunk_dictionary(table(spark, [(text, "en")]), "text", "lang").collect()
    often = phrases.chunk_dictionary(table(spark, [(text, "en")] * 50 + [("before it " + text, "en")]), "text", "lang")
    shared = {(r.chunk, r.own): r.n for r in often.collect()}
    assert sum(shared.get((r.chunk, r.own)) == 51 * r.n for r in once) >= len(once) - 3 and len(shared) <= len(once) + 3


class Frame:
    """What mapInArrow's function makes of given batches."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *_):
        return self

    def mapInArrow(self, work, _schema):
        self.made = list(work(iter(self.batches)))
        return self

    def groupBy(self, *_):
        return self

    def agg(self, _):
        return self.made


def test_counts_of_a_block_leave_in_small_batches(spark):
    names = [f"w{i}" for i in range(25_000)]
    chunks = [[" ".join(names[i : i + 100]) for i in range(0, len(names), 100)], [100] * 250, [3] * 250]
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * 250), *map(pa.array, chunks)], ["lang", "chunk", "own", "n"])
    blocks = phrases.chunk_blocks(Frame(rows)).made
    assert sum(len(x.as_py()) for b in blocks for c in b.columns[2:] for x in c) <= 6 * len(names)
    for size, n in ((1, 25_000), (3, 250 * 98)):
        made = phrases.count_phrases(Frame(*blocks), size)
        assert sum(map(len, made)) == n and max(map(len, made)) <= phrases.CHUNK_ROWS
        got = {p: a for b in made for p, a in zip(b["phrase"].to_pylist(), b["n"].to_pylist())}
        assert len(got) == n and set(got.values()) == {3}


def test_row_groups_of_blocks_are_bounded(spark, monkeypatch):
    written = []
    monkeypatch.setattr(phrases, "cut_lineage", lambda df, *a: written.append(cut_lineage(df, *a)) or written[-1])
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"{i:x}" for i in rnd.integers(0, 1 << 28, 4000)) for _ in range(320)]
    phrases.collocations(table(spark, [(t, "en") for t in texts]).coalesce(1), "text", "lang", longest=1)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in next(b for b in written if "numbers" in b.columns).coalesce(1).inputFiles()]
    groups = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(groups) > 2 * 2**23 and max(groups) < 1.5 * 2**23


def test_scores_are_exact_beyond_64_bits(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        l, r = rnd.randint(1, 10**14), rnd.randint(1, 10**14)
        a = rnd.randint(1, min(l, r))
        rows.append((i, a, rnd.randint(max(l, r), 9 * 10**15), l, r))
    got = phrases.score_cuts(spark.createDataFrame(rows, "i long, a long, n long, l long, r long")).collect()
    assert all(x.score == 1000 * x.a * x.n // (x.l * x.r) for x in got) and any(1000 * x.a * x.n > 2**64 for x in got)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, "en"), ("", None), (" , ", "en")]):
        got = phrases.collocations(table(spark, rows or [("a", "b")]).limit(len(rows)), "text", "lang")
        assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
