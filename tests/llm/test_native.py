"""Sharding over virtual slots and bottom-k fingerprints."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sievecrest.llm import fingerprints, sharding
from sievecrest.session import scratch_path

SCHEMA = "doc_id long, text string, shard string, slot long"


def table(spark, rows):
    """Extra columns carry names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", -1) for i, t in rows], SCHEMA)


ROWS = [(i, "word " * (i % 37 + 1)) for i in range(300)] + [(7, "same")] * 5 + [(None, None), (400, ""), (401, "é" * 3000)]


def place(spark, rows, n_shards=4, n_slots=256):
    units = sharding.record_units(table(spark, rows), "doc_id", "text", n_slots)
    first = sharding.plan_map(spark, sharding.slot_stats(units), n_shards, n_slots)
    return units, first


def test_shards_hold_near_equal_bytes_and_gapless_places(spark):
    units, slot_map = place(spark, ROWS)
    rows = sharding.place_rows(units, slot_map).collect()
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert sorted((r.id is not None, r.id or 0, r.size, r.crc) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 3000 * 2 + 1
    assert all(sorted(r.place for r in rs) == list(range(len(rs))) for rs in by.values())


def test_growing_moves_slots_only_into_the_new_shard_and_versions_are_kept(spark):
    units, first = place(spark, ROWS)
    path = scratch_path(spark, "test-map")
    sharding.write_map(first, path)
    stats = sharding.slot_stats(units)
    sharding.write_map(sharding.edit_map(spark, sharding.read_map(spark, path), stats, 5, 256), path)
    old = {r.vslot: r.shard for r in sharding.read_map(spark, path, 1).collect()}
    new = {r.vslot: (r.shard, r.version, r.bytes) for r in sharding.read_map(spark, path).collect()}
    assert set(old) == set(new) == set(range(256)) and {v[1] for v in new.values()} == {2}
    moved = [s for s in old if old[s] != new[s][0]]
    assert moved and all(new[s][0] == 4 for s in moved)
    load = [sum(b for s, _, b in new.values() if s == shard) for shard in range(5)]
    assert load[4] > 0 and max(load) < sum(load) / 5 * 1.6
    back = sharding.edit_map(spark, sharding.read_map(spark, path), stats, 3, 256).collect()
    assert {r.shard for r in back} == {0, 1, 2} and all(r.version == 3 for r in back)


def test_sharding_an_empty_table(spark):
    units, slot_map = place(spark, [])
    assert slot_map.count() == 256 and sharding.place_rows(units, slot_map).count() == 0


TEXTS = [
    (5, " ".join(f"w{i}" for i in range(400))),
    (4, " ".join(f"w{i}" for i in range(100, 500))),
    (4, " ".join(f"w{i}" for i in range(100, 500))),
    (3, None),
    (2, "only three words"),
    (1, "été " * 20),
    (0, ""),
]


def shingles(text):
    words = text.split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module", params=[1, 3, 2000])
def edited(spark, request):
    rows = fingerprints.fingerprint_edits(table(spark, TEXTS), "doc_id", "text", request.param).collect()
    return sorted(rows, key=lambda r: -r.doc_id)


def test_edited_texts_and_estimates(edited):
    assert [r.doc_id for r in edited] == [5, 4, 4, 3, 2, 1, 0]
    texts = [t or "" for _, t in TEXTS]
    want, near = [], []
    for i, t in enumerate(texts):
        follows = texts[(i + 1) % len(texts)]
        take = len(t) // 3
        new = t[: len(t) - take] + follows[:take]
        want.append(hashlib.sha256(new.encode()).hexdigest())
        near.append((jaccard(shingles(t), shingles(new)), jaccard(shingles(t), shingles(follows))))
    pick = lambda rows: sorted(rows)  # noqa: E731  the two copies may come in either order
    assert pick(r.edited_sha256 for r in edited) == pick(want)
    assert [r.n_chars for r in edited] == [len(t) for t in texts]
    for r, (a, b) in zip(sorted(edited, key=lambda r: r.edited_sha256), [n for _, n in sorted(zip(want, near))]):
        assert abs(r.near_edited - a) < 0.2 and abs(r.near_next - b) < 0.2
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert edited[1].fingerprint == edited[2].fingerprint and edited[3].fingerprint == edited[6].fingerprint == ""


def test_sketches_merge_like_their_texts(spark):
    df = spark.createDataFrame([("a", "a b c d e f"), ("a", "b c d e f g h"), ("b", ""), (None, "x")], "k string, t string")
    parts = df.withColumn("sk", fingerprints.sketch(F.col("t"), 4))
    merged = {r.k: r.sk for r in fingerprints.merge_groups(parts, ["k"], "sk", 4).collect()}
    rows = [r.sk for r in parts.collect()]
    assert merged["a"] == sorted(set(rows[0]) | set(rows[1]))[:4] and merged["b"] == [] and merged[None] == rows[3]
    pair = spark.createDataFrame([(list(range(10)), list(range(5, 15)))], "a array<bigint>, b array<bigint>")
    got = pair.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 64).alias("j"),
        fingerprints.containment(F.col("a"), F.col("b"), 64).alias("c"),
        fingerprints.distinct_shingles(F.col("a"), 64).alias("n"),
    ).first()
    assert got.j == pytest.approx(5 / 15) and got.c == pytest.approx(0.5) and got.n == 10


@pytest.mark.parametrize("chunk_rows", [1, 7, 2000])
def test_next_texts_across_chunks(spark, chunk_rows):
    rows = [(i * 7 % 101, f"text {i}") for i in range(60)] + [(3, "text x")] * 3 + [(None, "a"), (None, "b")]
    got = fingerprints.with_next_text(table(spark, rows), "doc_id", "text", chunk_rows).select("doc_id", "text", "next_text").collect()
    assert len(got) == len(rows)
    ids = {t: (i is None, -(i or 0)) for i, t in rows}
    following = {}
    for r in got:
        following.setdefault(r.text, []).append(r.next_text)
    assert sorted(n for ns in following.values() for n in ns) == sorted(t for _, t in rows)  # a cycle through all rows
    for t, ns in following.items():
        steps = [n for n in ns if n != t]
        assert len(steps) <= 1 or len(rows) == 1
        for n in steps:  # nothing lies between, but for the step from the last row to the first
            between = [u for u in ids if ids[t] < ids[u] < ids[n]]
            assert not between and (ids[n] >= ids[t] or (ids[n], ids[t]) == (min(ids.values()), max(ids.values())))


def test_fingerprints_of_an_empty_table(spark):
    assert fingerprints.fingerprint_edits(table(spark, []), "doc_id", "text").count() == 0
