"""Quality rules, language ID, packing, BPE, PPM, wrappers and licenses."""

import difflib
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievecrest.llm import bpe, langid, licenses, packing, ppm, rules, vocab, wrappers
from sievecrest.llm.queries import document_tokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n", "a", "don't  stop\t\n now", "é" * 3, "日本語 テキスト 🙂🙂", "a" * 3000, " " * 500, "x　y \x85 z\x1cw",
    "<|endoftext|> mid<|endoftext|>dle", "#*$%&|<>", "12345 67890 1a2b",
]


def table(spark, texts, lang=None):
    rows = [(i, t, (lang or {}).get(i), "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, length long")


def noise(seed, n, alphabet="etaoin shrdlu \n'12é#"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


# ---- quality rules


def brute_repeat(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)})


def test_rule_report(spark):
    texts = [*ODD, "a b c a b c", "x x x x x", "one\none\n\none two\n", " ".join(f"word{i}" for i in range(80)), *noise(1, 30, "ab \n")]
    got = {r.doc_id: r for r in rules.rule_report(table(spark, texts), "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        lines = [l for l in t.split("\n") if l.strip(" \t\n\v\f\r")]
        want = (len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in t), len(lines) - len(set(lines)), brute_repeat(words))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)
    assert got[len(ODD) + 3].kept


def test_rule_order_changes_the_cost_only(spark):
    texts = [*noise(2, 40, "abcdefgh ABC #\n"), " ".join(f"word{i}" for i in range(80))] * 2
    df = table(spark, texts)
    order = rules.order_rules(df, "text")
    assert sorted(order) == sorted(rules.RULES)
    kept = [sorted(r.doc_id for r in rules.apply_rules(df, "text", o).collect()) for o in (order, order[::-1], None)]
    assert kept[0] == kept[1] == kept[2] == [40, 81]
    assert rules.apply_rules(df.where("doc_id < 0"), "text").count() == 0
    assert rules.apply_rules(df, "text").columns == df.columns


# ---- language


def test_language_id_learns_held_out_rows(spark):
    words = {"xx": "gorp blint frand quorz", "yy": "shelm tindo wurpa kesto", "zz": "älpo örrek ümmat ßank"}
    rnd = random.Random(5)
    texts, lang = [], {}
    for i in range(150):
        name = ("xx", "yy", "zz")[i % 3]
        texts.append(" ".join(rnd.choice(words[name].split()) for _ in range(rnd.randint(5, 40))))
        lang[i] = None if i % 10 == 9 else name
    texts += [None, "", "12 34 !!", "q", "gorp " * 100_000]
    df = table(spark, texts, lang)
    filters = langid.train_filters(df.where(langid.training_row(F.col("doc_id"))), "text", "lang")
    assert sorted(filters.names) == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in langid.predict_languages(df, filters, "doc_id", "text").collect()}
    assert all(got[i].lang_pred == ("xx", "yy", "zz")[i % 3] and got[i].score > 0.9 for i in range(150))
    assert [got[i].lang_pred for i in (150, 151, 152)] == ["und"] * 3 and got[150].score == 0
    assert got[153].lang_pred == filters.names[0] and got[154].lang_pred == "xx"
    kept = {r.doc_id for r in langid.keep_identified(df, filters, "text").collect()}
    assert kept == set(range(150)) | {154}
    none = langid.train_filters(df.where("lang is null"), "text", "lang")
    assert {r.lang_pred for r in langid.predict_languages(df, none, "doc_id", "text").collect()} == {"und"}


def test_filters_return_every_language_and_masks_match_sets():
    rng = np.random.default_rng(2)
    grams = {f"l{i:02d}": rng.integers(0, 2**32, 500, np.uint32) for i in range(70)}
    filters = langid.Filters.build(list(grams), grams)
    for l, (name, codes) in enumerate(grams.items()):
        masks = filters.masks(codes)
        assert ((masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)).all()
    assert filters.false_rates().max() < 1e-6


def test_every_counted_gram_is_found_and_decisions_follow_plain_sets(spark):
    rnd = random.Random(11)
    words = {n: ["".join(rnd.choice(a) for _ in range(rnd.randint(2, 8))) for _ in range(300)]
             for n, a in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "éßøabcij"))}
    texts, lang = [], {}
    for i in range(120):
        lang[i] = ("aa", "bb", "cc")[i % 3 if i % 7 else 0]
        texts.append(" ".join(rnd.choice(words[lang[i]]) for _ in range(rnd.randint(1, 60))))
    texts += [" ".join(rnd.choice(words[n]) for n in ("aa", "bb", "bb", "cc") * 8) for _ in range(30)]
    df = table(spark, texts, lang)
    filters = langid.train_filters(df, "text", "lang")
    sets = {n: set() for n in words}
    for i, name in lang.items():
        plain = b" " + texts[i].encode() + b" "
        sets[name] |= {plain[j : j + 4] for j in range(len(plain) - 3)}
    for l, name in enumerate(filters.names):
        codes = np.array([int.from_bytes(g, "big") for g in sets[name]], np.uint32)
        assert ((filters.masks(codes)[0] >> np.uint64(l)) & np.uint64(1)).all()
    assert (filters.planes == langid.Filters.build(
        filters.names, {n: np.array([int.from_bytes(g, "big") for g in s], np.uint32) for n, s in sets.items()}
    ).planes).all()
    got = {r.doc_id: r for r in langid.predict_languages(df, filters, "doc_id", "text").collect()}
    for i, text in enumerate(texts):
        plain = b" " + text.encode() + b" "
        grams = [plain[j : j + 4] for j in range(len(plain) - 3)]
        share = {n: sum(g in sets[n] for g in grams) / len(grams) for n in words}
        assert share[got[i].lang_pred] >= max(share.values()) - 0.02
        assert got[i].score == pytest.approx(share[got[i].lang_pred], abs=0.02)


def test_filters_grow_with_the_grams_up_to_a_bound():
    assert langid.Filters.empty([], 0).planes.shape == (1, langid.MIN_SLOTS)
    assert langid.Filters.empty(["a"] * 65, 100_000).planes.shape == (2, 1 << 21)
    full = langid.Filters.build(["a", "b"], {"a": np.arange(1 << 20, dtype=np.uint32), "b": np.arange(50, dtype=np.uint32)})
    assert full.planes.shape == (1, langid.MAX_SLOTS)
    assert (full.masks(np.arange(1 << 20, dtype=np.uint32))[0] & np.uint64(1)).all() and full.false_rates()[0] < 0.5


def test_a_language_is_held_to_its_own_level(spark):
    rare, texts, lang = random.Random(2), [], {}
    for i in range(200):
        if i % 2:  # the same words again and again
            texts.append(" ".join(rare.choice(["shelm", "tindo", "wurpa"]) for _ in range(20)))
        else:  # mostly words nobody else has
            odd = ["".join(rare.choice("bcdfgklmnprstv") for _ in range(6)) for _ in range(14)]
            texts.append(" ".join(["gorp blint quorz"] * 2 + odd))
        lang[i] = "yy" if i % 2 else "xx"
    df = table(spark, texts, lang)
    training = langid.training_row(F.col("doc_id"))
    filters = langid.train_filters(df.where(training), "text", "lang")
    levels = langid.language_levels(df.where(~training), filters, "text", "lang")
    assert levels["yy"] == pytest.approx(1, abs=0.01) and levels["xx"] < 0.6
    new = ["gorp blint quorz " + "zzyzyx wjqwjq hhjhjh", "shelm tindo " * 9, "shelm " + "jqx wjq hzh qqj " * 9, None, "12 3"]
    kept = langid.keep_identified(table(spark, new), filters, "text", levels=levels)
    assert {r.doc_id for r in kept.collect()} == {0, 1}
    assert langid.keep_identified(table(spark, new), filters, "text", levels={}).count() == 3
    none = langid.train_filters(df.where("lang is null"), "text", "lang")
    assert langid.language_levels(df, none, "text", "lang") == {}
    assert langid.keep_identified(table(spark, new), none, "text", levels={}).count() == len(new)


# ---- packing


def check_packing(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_documents(spark):
    texts = [*ODD, *noise(3, 300), "word " * 5000, "word " * 2047, *["same text"] * 50]
    rows = packing.pack_documents(table(spark, texts), "doc_id", "text", document_tokenizer()).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == set(range(len(texts)))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        pieces = sorted(docs[i], key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and (r.length == 2048 or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert check_packing(rows) <= math.ceil(total / 2048) + 1
    assert packing.pack_documents(table(spark, texts).where("doc_id < 0"), "doc_id", "text", document_tokenizer()).count() == 0


def test_plan_covers_every_rank_and_is_best_fit():
    rnd = random.Random(4)
    for _ in range(30):
        histogram = {l: rnd.choice((1, 2, 7, 1000)) for l in rnd.sample(range(1, 101), rnd.randint(1, 25))}
        placed = {}
        for length, lo, hi, first, each, offset in packing.plan_sequences(histogram, 100):
            for r in range(lo, hi):
                nth = r - lo
                placed.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
        counts = Counter(l for p in placed.values() for _, l in p)
        assert counts == Counter(histogram)
        for p in placed.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= 100
        rooms = []  # the same best fit, one item at a time
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [r for r in rooms if r >= length]
                room = min(fits) if fits else 100
                if fits:
                    rooms.remove(room)
                rooms.append(room - length)
        assert len(placed) == len(rooms)


# ---- BPE


def test_merge_replay_encodes_like_the_library(spark):
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.load_ranks(RANKS), special_tokens={})
    texts = [*ODD, *noise(6, 200), *noise(7, 100, "aeiouthrn "), "The quick brown fox isn't here. " * 30]
    df = table(spark, texts)
    got = {r.doc_id: r for r in bpe.round_trip_digests(df, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(df, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert ids[i] == want, t
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digests(df.where("doc_id < 0"), "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_whose_inner_order_matters_are_encoded_alone():
    """Ranks where a merge makes a lower pair while the same pair still stands further right."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"cab": 258, b"cc": 259, b"bab": 260}
    table = bpe.MergeTable(ranks)
    words = ["".join(random.Random(i).choice("abc") for _ in range(i % 12 + 1)).encode() for i in range(300)]
    got = bpe.replay_merges(words, table)
    assert all(g == ([ranks[w]] if w in ranks else table.step_by_step(w)) for g, w in zip(got, words))


# ---- PPM


def brute_ppm(train, text, order):
    """Log10 probability by walking contexts byte by byte with explicit exclusion sets."""
    counts = {}
    for t in train:
        b = ppm.framed(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += 1
    total, b = 0.0, ppm.framed(text)
    for i in range(order, len(b)):
        out = set()
        for k in range(order, -2, -1):
            if k < 0:
                total -= math.log10(ppm.SYMBOLS - len(out))
                break
            known = {s: c for s, c in counts.get(b[i - k : i], {}).items() if s not in out}
            n = sum(known.values())
            if b[i] in known:
                total += math.log10((2 * known[b[i]] - 1) / (2 * n))
                break
            if known:
                total += math.log10(len(known) / (2 * n))
            out |= set(known)
    return total


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_scores_match_a_walk_over_contexts(spark, head):
    texts = [*[t for t in ODD if t != "a" * 3000], *noise(8, 60, "abab cdc\n"), *noise(9, 10), "abab cdc abab", "abab cdc abab"]
    df = table(spark, texts)
    got = {r.doc_id: r for r in ppm.score_texts(df, "doc_id", "text", ppm.held_out(F.col("doc_id")), head).collect()}
    assert len(got) == len(texts)
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert any(out) and [got[i].held_out for i in range(len(texts))] == out
    raw = [(t or "").encode() for t in texts]
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in t) for t in raw]
    train = [t for t, o in zip(lower, out) if not o]
    words = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(lower):
        tokens = [*t.split(), b""]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(brute_ppm(train, t, ppm.ORDER))


@pytest.mark.parametrize("rows", [1, 40])
def test_windows_are_settled_a_few_groups_at_a_time(spark, monkeypatch, rows):
    monkeypatch.setattr(ppm, "GROUP_ROWS", rows)
    texts = [*noise(4, 40, "abab cdc\n"), *noise(5, 8), "abab cdc", "aé日本", None]
    out = [i % 5 == 0 for i in range(len(texts))]
    got = {r.doc_id: r.score for r in ppm.score_texts(table(spark, texts), "doc_id", "text", F.col("doc_id") % 5 == 0, 0).collect()}
    raw = [(t or "").encode().lower() for t in texts]
    train = [t for t, o in zip(raw, out) if not o]
    for i, t in enumerate(raw):
        assert got[i] == pytest.approx(brute_ppm(train, t, ppm.ORDER))


def test_six_bytes_of_context_decide(spark):
    texts = ["xbcdefg", "ybcdefh", "xbcdefg", "xbcdefh"]
    df = table(spark, texts)
    out = F.col("doc_id") >= 2
    got = {r.doc_id: r.score for r in ppm.score_texts(df, "doc_id", "text", out, 0).collect()}
    train = [t.encode() for t in texts[:2]]
    assert [got[i] for i in range(4)] == [pytest.approx(brute_ppm(train, t.encode(), 6)) for t in texts]
    assert got[2] > got[3]  # equal with five


def test_scoring_without_training_or_rows(spark):
    df = table(spark, ["ab", None])
    got = ppm.score_texts(df, "doc_id", "text", F.lit(True)).orderBy("doc_id").collect()
    assert [r.score for r in got] == [pytest.approx(-3 * math.log10(255)), pytest.approx(-math.log10(255))]
    assert [(r.train_tokens, r.n_known) for r in got] == [(0, 0)] * 2
    assert ppm.score_texts(df.where("doc_id < 0"), "doc_id", "text", F.lit(True)).count() == 0


def test_long_texts_come_in_parts(monkeypatch):
    text = b"the cat sat on the mat " * 50
    whole = Counter(ppm.window_codes([(0, ppm.framed(text))])[1].tolist())
    from sievecrest.llm.common import segments

    parts = [ppm.window_codes(p)[1].tolist() for p in segments([ppm.framed(text)], 64, ppm.ORDER)]
    assert len(parts) > 5 and Counter(c for p in parts for c in p) == whole


# ---- pages

PAGE = """<html><head><title>No</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">Cookies!</div>{open}<h1>Title {i} &amp; more</h1><p>First&nbsp;part <b>bold {i}<p>Second
 <i>part</i><br>of {i}<ul><li>one {i}<li>two</ul><p>Subscribe to our letter</p><script>if (a<b) "</p>"</script><form>Name</form>
<section id="comments"><p>Nice!</p></section>{close}<aside>Side</aside><div class=ad>Buy</div><footer>(c)</footer></body></html>"""


def test_pages_with_and_without_a_marked_article(spark):
    rows = []
    for i in range(24):
        host, tags = ("a.example.com", ("<article>", "</article>")) if i < 12 else ("b.example.com", ("<div>", "</div>"))
        rows.append((i, f"https://user@{host}:80/p{i}", PAGE.format(i=i, open=tags[0], close=tags[1]), "x"))
    rows += [(100, None, None, "x"), (101, "odd", "", "x"), (102, "http://c/", "plain &lt;text&gt; <", "x"), (102, "http://c/", "plain", "x")]
    rows += [(103, "http://c/", "<div>" * 3000 + "deep" + "<p>more", "x"), (104, "http://c/", "<p>" + "<a href=1>link</a> " * 3 + "<p>say", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text): r for r in wrappers.extract_main_text(df, "page_id", "url", "html").collect()}
    texts = {}
    for (i, t), r in got.items():
        texts.setdefault(i, []).append(t)
        assert r.n_chars == len(t)
    for i in range(24):
        # "two" and "Subscribe ..." are the same on every page of the host: template.
        assert texts[i] == [f"Title {i} & more\nFirst part bold {i}\nSecond part of {i}\none {i}"]
    assert texts[100] == texts[101] == [""] and sorted(texts[102]) == ["plain", "plain <text> <"]
    assert texts[103] == ["deep\nmore"] and texts[104] == ["say"]
    assert wrappers.extract_main_text(df.where("page_id < 0"), "page_id", "url", "html").count() == 0


def extracted(spark, pages):
    """Texts of (host, html) pages in order."""
    rows = [(i, f"http://{host}/", html) for i, (host, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in wrappers.extract_main_text(df, "page_id", "url", "html").orderBy("page_id").collect()]


def test_copies_of_a_page_are_one_page(spark):
    same = "<h1>Same</h1>" + "".join(f"<p>Paragraph {k} of the one article" for k in range(6))
    whole = wrappers._content_blocks(same)[1]
    whole = "\n".join(text for _, _, text in whole)
    other = [f"<h1>Title {i}</h1><p>Text {i} of its own<p>Write to us" for i in range(11)]
    edited = [same.replace("Same", f"Same {i}") for i in range(2)]
    got = extracted(spark, [*[("one", same)] * 20, *[("many", same)] * 190, *[("many", o) for o in other], *[("near", e) for e in edited]])
    assert got[:210] == [whole] * 210
    assert got[210:221] == [f"Title {i}\nText {i} of its own" for i in range(11)]
    assert got[221:] == [whole.replace("Same", f"Same {i}") for i in range(2)]


def test_every_layout_and_any_two_pages_show_their_template(spark):
    def page(kind, i):
        return f"<div class={kind}><h1>{kind} {i}</h1><div><p>Text {i} of its own, as long as it is</div><div class=end>Write to {kind}</div></div>"

    pages = [("two", page("a", i)) for i in range(2)]
    pages += [("half", page("ab"[i % 2], i)) for i in range(20)] + [("half", page("a", 0))] * 30
    pages += [("rest", page("a" if i < 40 else "c", i)) for i in range(43)]
    html = [h for _, h in pages]
    assert extracted(spark, pages) == ["\n".join(t for _, _, t in wrappers._content_blocks(h)[1][:2]) for h in html]


def test_names_of_headings_and_small_marked_parts_lose_no_text():
    def texts(page):
        return [text for _, _, text in wrappers._content_blocks(page)[1]]

    body = '<h2 id="social-impact">A</h2><h2 id="related-work">B</h2><p id="notice-period">C</p><div class="share-price">D</div>'
    assert texts(f"<article>{body}</article>") == texts(f"<main>{body}</main>") == texts(body) == ["A", "B", "C", "D"]
    noise = '<div class="x cookie">E</div><div role=navigation>F</div><aside>G</aside><ul class=comments><li>H</ul>'
    assert texts(f"<article>{body}{noise}</article>") == ["A", "B", "C", "D"]
    outside = '<div class="cookie-notice">I</div><div id="site-footer">J</div><div class="sidebar-left">K</div><div id="post-comments">L</div>'
    assert texts(body + outside) == ["A", "B", "C", "D"]
    main, cards = "<h1>Title</h1><p>Long text of the page, longer than cards", "<article>Card 1</article><article>Card 2</article>"
    assert texts(f"<main>{main}</main>{cards}") == ["Title", "Long text of the page, longer than cards"]
    assert texts(f"<main>{main}{cards}</main>")[:2] == ["Title", "Long text of the page, longer than cards"]
    assert texts("<main><h1>Title</h1><article>Whole text</article></main>") == ["Title", "Whole text"]
    assert texts(f"<main>Hint</main><article>{main}</article>") == ["Title", "Long text of the page, longer than cards"]


def test_tree_matching_is_the_best_ordered_match():
    def tree(spec):
        node = wrappers.Node(spec[0])
        node.kids = [tree(s) for s in spec[1:]]
        return node

    a = tree(["r", ["a"], ["b", ["x"], ["y"]], ["c"], ["a"]])
    b = tree(["r", ["b", ["y"]], ["a"], ["c"]])
    size, pairs = wrappers.match_trees(a, b)
    assert size == 4 and [(x.label, y.label) for x, y in pairs if x.label == "c"] == [("c", "c")]
    wrappers.grow_wrapper(b, a)
    again = wrappers.load_tree(wrappers.dump_tree(b))
    assert wrappers.match_trees(again, a)[0] == 7


# ---- licenses


def test_licenses_in_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    filler = " ".join(f"filler{i} the software is" for i in range(300))
    edited = mit.replace("free of charge", "gratis").replace("software and associated", "program and its")
    texts = [*ODD, mit, f"{filler} {mit} {filler}", f"{mit}\n{mit}", edited, filler, "all rights reserved", "No rights. All reserved.",
             f"{filler} Licensed under the Apache License, Version 2.0. {filler}", mit[: len(mit) // 2]]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, texts), "doc_id", "text").collect()}
    o = len(ODD)
    assert all(got[i].license is None and got[i].licenses == [] for i in range(o))
    assert [got[o + i].license for i in range(4)] == ["MIT"] * 4
    assert [got[o + i].coverage for i in range(3)] == [1.0] * 3 and 0.9 < got[o + 3].coverage < 1
    assert got[o + 1].first_word == 1200 and got[o + 1].last_word == 1200 + len(licenses.words_of(mit.encode())) - 1
    assert [got[o + i].license for i in range(4, 9)] == [None, "reserved", None, "Apache-2.0-notice", None]
    assert licenses.scan_licenses(table(spark, []), "doc_id", "text").count() == 0


def test_neighbouring_licenses_are_told_apart():
    known = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert known.scan(f"Before {text} After".encode(), 0.8)[0][:2] == (name, 1.0)
    names = [[f[0] for f in known.scan(t, 0.8)] for t in (b"Released under the BSD License", b"Licensed under CC BY 4.0", b"Released under the Zlib License")]
    assert names == [["BSD-notice"], ["CC-BY-4.0-notice"], []]


def test_patience_alignment_is_an_alignment_and_close_to_the_longest():
    rnd = random.Random(11)
    for _ in range(50):
        b = [str(rnd.randint(0, 60)) for _ in range(40)]
        a = [w for w in b if rnd.random() > 0.2]
        a.insert(rnd.randint(0, len(a)), "new")
        pairs = licenses.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        longest = sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())
        assert len(pairs) >= 0.7 * longest
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_license_whose_rarest_words_stand_elsewhere():
    """Three rare words of the notice are changed and stand far away instead: the rest of the notice is found all the same."""
    words = licenses.words_of(licenses.TEMPLATES["MIT"].encode())
    rare = [w for w in words if words.count(w) == 1][:3]
    text = b" ".join([*rare, *[b"filler"] * 400, *[b"changed" if w in rare else w for w in words]])
    (found,) = licenses.Templates({"MIT": licenses.TEMPLATES["MIT"]}).scan(text, 0.8)
    assert found[1] >= (len(words) - 3) / len(words) - 1e-9 and found[2] >= 403
