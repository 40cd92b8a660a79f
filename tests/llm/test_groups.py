"""SimHash groups through anchor points, against comparing every pair."""

import random

import numpy as np
import xxhash

from sievecrest.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(items):
    """Least id of the component of each (id, fingerprint)."""
    label = list(range(len(items)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(items):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(items))]


def test_anchor_copies_are_all_anchors_within_reach():
    for width, threshold in ((21, 1), (32, 2)):
        code = simhash.Anchors(0, width, threshold)
        rng = np.random.default_rng(1)
        words = rng.integers(0, 1 << width, 40, np.uint64)
        row, anchor = code.copies(words)
        assert np.bitwise_count(code.home(words) ^ words).max() <= 1
        assert (np.bitwise_count(words[row] ^ anchor) <= 1 + threshold).all()
        assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
        for i, w in enumerate(words):
            for _ in range(30):  # any word within the threshold has its home among the copies
                near = w ^ np.uint64(sum(1 << b for b in random.sample(range(width), random.randint(0, threshold))))
                assert code.home(np.array([near]))[0] in set(anchor[row == i].tolist())


def chains(n, seed):
    """Fingerprints in chains of few flipped bits, and lone ones."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        fp = rnd.getrandbits(64)
        for _ in range(rnd.choice((1, 1, 2, 30))):
            out.append(fp)
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                fp ^= 1 << b
    return out[:n]


def test_links_close_to_the_components_of_all_pairs(spark):
    fps = chains(400, 3)
    items = [(i * 3 + 1, fp) for i, fp in enumerate(fps)]
    want = brute_components(items)
    df = spark.createDataFrame([(d, int(np.uint64(fp).view(np.int64))) for d, fp in items], "doc_id long, fp long")
    points = df.groupBy("fp").agg({"doc_id": "min"})
    for parts, cell in ((3, 1 << 15), (2, 1 << 15), (3, 4)):
        roots = {r.node: r.root for r in simhash.close_links(simhash.anchor_links(points, parts, cell)).collect()}
        signed = [int(np.uint64(fp).view(np.int64)) for fp in fps]
        groups = {}
        for d, fp in zip((d for d, _ in items), signed):
            groups.setdefault(roots.get(fp, fp), []).append(d)
        got = {d: min(g) for g in groups.values() for d in g}
        assert [got[d] for d, _ in items] == want, (parts, cell)


ROWS = (
    [(i, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20 + f"tail{i % 3}") for i in range(40)]
    + [(100 + i, " ".join(f"{i}w{j}" for j in range(60))) for i in range(20)]
    + [(200, None), (201, ""), (202, "  \n"), (203, "Two words"), (204, "two WORDS"), (204, "two words"), (None, "two words")]
)


def test_near_duplicates_of_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, "doc_id", "text").collect()
    items = [(10**9 if i is None else i, brute_fingerprint(t)) for i, t in ROWS]
    want = sorted(zip((d for d, _ in items), (f"{fp:016x}" for _, fp in items), brute_components(items)))
    assert sorted((10**9 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in ROWS], "doc_id long, text string, fp string, rid long")
    got = simhash.one_per_component(df, "doc_id", "text")
    assert got.columns == df.columns
    items = [(10**9 if i is None else i, brute_fingerprint(t)) for i, t in ROWS]
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_components(items)))
    assert simhash.one_per_component(df.where("doc_id = -5"), "doc_id", "text").count() == 0
    assert simhash.near_duplicates(df.where("doc_id = -5"), "doc_id", "text").count() == 0
