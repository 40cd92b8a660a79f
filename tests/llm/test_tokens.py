"""Speculative word BPE, cross-tokenizer alignment and phrase counts against plain versions."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievecrest.llm import alignment, wordbpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "a", "don't  stop\t\n now", "é" * 3, "日本語 テキスト 🙂🙂", "a" * 3000, " " * 500, "x　y \x85 z\x1cw",
    "<|endoftext|> mid<|endoftext|>dle <|startoftext|>", "#*$%&|<>", "12345 67890 1a2b", "ΑΣ Σ İ ß ǆ", "é ́x ̈",
    "a▁b", "<s> </s> <0x41>", "tail ", "\x00 nul",
]


def table(spark, texts):
    """Texts with extra columns whose names clash with those used inside."""
    rows = [(i, t, "k", 1, [2]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row long, ids array<int>")


def noise(seed, n, alphabet="etaoin shrdlu \n'12é#", most=120):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, most))) for _ in range(n)]


# ---- BPE with word ends


def library_words():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    own.no_truncation()
    own.no_padding()
    return own


def test_word_bpe_equals_the_library(spark, sf):
    texts = ODD + noise(1, 200) + noise(2, 200, "ab") + noise(3, 200, "ABÉİΣ日🙂 \n\t\x85\x1c'st", 40) + noise(4, 50, "thanigre", 400)
    texts += ["word" * 300_000, "ab" * 200_000, "x y " * 300_000] + texts[:30]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    own = library_words()
    got = {r.doc_id: r for r in wordbpe.round_trip_digests(table(spark, texts), "doc_id", "text", WORDS).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        said = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        plain = hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), said, plain), (t or "")[:80]


def test_word_bpe_ids_and_text(spark):
    texts = ODD + noise(5, 20)
    ids = wordbpe.encode_documents(table(spark, texts), "doc_id", "text", WORDS)
    own = library_words()
    for r in wordbpe.decode_documents(ids, "doc_id", "ids", WORDS).join(ids, "doc_id").collect():
        want = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.text == own.decode(want, skip_special_tokens=False)
    none = table(spark, ["a"]).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert wordbpe.decode_documents(none, "doc_id", "ids", WORDS).first().text is None
    assert wordbpe.round_trip_digests(table(spark, ["a"]).limit(0), "doc_id", "text", WORDS).count() == 0


def small_table(seed, alphabet="abc", merges=40):
    """A vocabulary grown by random merges over a small alphabet, plus all single bytes."""
    rnd = random.Random(seed)
    chars = wordbpe.byte_characters()
    vocab = {c: i for i, c in enumerate([*chars, *(c + "</w>" for c in chars)])}
    inner, last, made = list(alphabet), [c + "</w>" for c in alphabet], []
    while len(made) < merges:
        a, b = rnd.choice(inner), rnd.choice(inner + last)
        if a + b not in vocab and len(a + b) < 12:
            vocab[a + b] = len(vocab)
            made.append((a, b))
            (last if b.endswith("</w>") else inner).append(a + b)
    return vocab, made


@pytest.mark.parametrize("seed", range(8))
def test_checked_proposals_are_the_merges(seed):
    vocab, merges = small_table(seed)
    own = wordbpe.WordTable(vocab, merges, "</w>")
    rank = {m: i for i, m in enumerate(merges)}
    names = {i: t for t, i in vocab.items()}
    words = list({w for w in noise(seed, 400, "abc", 14) if w})

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while len(parts) > 1:
            least, at = min((rank.get(p, 10**9), i) for i, p in enumerate(zip(parts, parts[1:])))
            if least == 10**9:
                break
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return parts

    got, failing = own.encode_words([w.encode() for w in words])
    assert 0 < failing < len(words)
    for word, ids in zip(words, got):
        assert [names[i] for i in ids] == plain(word), word
        assert own.merge_exactly(word.encode()) == ids


def test_unfit_vocabularies_are_refused():
    vocab, merges = small_table(1)
    with pytest.raises(ValueError):
        wordbpe.WordTable(vocab, merges[::-1], "</w>")
    del vocab["z</w>"]
    with pytest.raises(ValueError):
        wordbpe.WordTable(vocab, merges, "</w>")


# ---- alignment of two tokenizers


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {c: i for i, c in enumerate(wordbpe.byte_characters())}
    docs = []
    for t in texts:
        docs.append(None)
        if not t:
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ta = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not b"".join(ta) == b"".join(tb) == (" " + t).encode():
            continue
        ends_a, ends_b = list(np.cumsum(list(map(len, ta)))), list(np.cumsum(list(map(len, tb))))
        links, i, j = [], 0, 0
        while i < len(ia) and j < len(ib):
            links.append((ia[i], ib[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, pa, pb = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            na, nb = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ia[pa:na])) + "|" + ",".join(map(str, ib[pb:nb])))
            pa, pb = na, nb
        docs[-1] = (len(ia), len(ib), links, groups)
    count = Counter(p for d in docs if d for p in set(d[2]))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            said = hashlib.sha256(";".join(d[3]).encode()).hexdigest()
            best = sum(count[p] == top[p[0]] for p in d[2])
            yield (d[0], d[1], len(d[3]), len(d[2]), best, sum(count[p] for p in d[2]), said)


@pytest.mark.parametrize("head", [0, 5, alignment.HEAD])
def test_alignment_equals_a_plain_one(spark, sf, head):
    texts = ODD + noise(6, 60) + noise(7, 60, "aaab ", 30) + noise(8, 20, "日本é🙂 \t") + ["the cat sat"] * 40
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()]
    got = alignment.align_corpus(table(spark, texts).repartition(5), "doc_id", "text", BYTES, PATTERN, PIECES, head)
    found = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(found) == len(texts)
    for i, want in enumerate(plain_alignment(texts)):
        assert found[i] == want, (texts[i] or "")[:60]


def test_alignment_of_long_texts_in_parts():
    own = alignment.Aligner(alignment.byte_level_vocabulary(BYTES, PATTERN)(), alignment.piece_vocabulary(PIECES)())
    texts = ["word salad, " * 400, "x" * 5000 + " y" * 300, "é" * 700]
    whole = [(i, " " + t) for i, t in enumerate(texts)]
    parts = [(i, p) for i, t in whole for p in alignment.text_parts(t, 97)]
    import pyarrow as pa

    ids = pa.array([0, 1, 2])
    assert len(parts) > len(whole)
    assert alignment._aligned_rows(own, ids, parts, 3, 0).equals(alignment._aligned_rows(own, ids, whole, 3, 0))
    assert list(plain_alignment(texts))[0][3] == alignment._aligned_rows(own, ids, whole, 3, 0).to_pylist()[0]["n_links"]


def test_alignment_of_nothing(spark):
    got = alignment.align_corpus(table(spark, ["a"]).limit(0), "doc_id", "text", BYTES, PATTERN, PIECES)
    assert got.count() == 0 and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    blank = alignment.align_corpus(table(spark, [None, ""]), "doc_id", "text", BYTES, PATTERN, PIECES).collect()
    assert [tuple(r)[1:] for r in blank] == [(0, 0, 0, 0, 0, 0, "")] * 2
