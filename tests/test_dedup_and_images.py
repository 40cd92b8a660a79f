"""First-wins removal against the one-by-one loop, hot chunks included; image helpers."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecrest.functions import geometry as G
from sievecrest.functions import hashing as H
from sievecrest.operators import dedup as D
from sievecrest.operators import images as I
from sievecrest.sources import readers as RD

SCHEMA = "idx bigint, ahash bigint, dhash bigint, phash bigint, chash bigint, digest string, feature array<double>"


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def make_rows(n, seed, hot=0.0):
    rng = random.Random(seed)
    seeds, rows = [], []
    for i in range(n):
        if seeds and rng.random() < 0.6:
            base = rng.choice(seeds)
            h = [x ^ (1 << rng.randrange(48)) if rng.random() < 0.7 else x for x in base["h"]]
            feat = [x + rng.gauss(0, 0.15) for x in base["f"]]
        else:
            h = [rng.getrandbits(64) for _ in range(4)]
            if rng.random() < hot:
                h[2] &= (1 << 48) - 1  # a chunk of zeros shared by a large part of the table
            feat = [rng.gauss(0, 1) for _ in range(16)]
        m = sum(feat) / 16
        sd = (sum((x - m) ** 2 for x in feat) / 16) ** 0.5
        row = {"h": h, "f": [(x - m) / sd for x in feat]}
        if rows and rng.random() < 0.15:
            row = rows[rng.randrange(len(rows))]
        seeds.append(row)
        rows.append(row)
    digests = {}
    out = []
    for i, r in enumerate(rows):
        d = digests.setdefault(id(r), f"d{len(digests)}")
        a, dd, p, c = (signed(x) for x in r["h"])
        out.append((i, a, dd, p, c, d, r["f"]))
    return out


def loop(rows):
    mask = (1 << 64) - 1

    def ch(v):
        v &= mask
        return [(v >> s) & 0xFFFF for s in (48, 32, 16, 0)]

    def dist(a, b):
        return bin((a ^ b) & mask).count("1")

    kept, result = [], {}
    for r in rows:
        same = next((k for k in kept if k[5] == r[5]), None)
        if same:
            result[r[0]] = ("removed", same[0], "exact_sha256")
            continue
        best = None
        for kind in (3, 2):
            for pos, key in enumerate(ch(r[kind])):
                for k in kept:
                    if key in ch(k[kind]):
                        p, d, a, c = (dist(r[i], k[i]) for i in (3, 2, 1, 4))
                        corr = 1 - float(np.dot(r[6], k[6]) / len(r[6]))
                        if p <= 4 and d <= 4 and corr <= 0.08 or p <= 8 and d <= 8 and a <= 8 and c <= 10 and corr <= 0.04:
                            best = k[0]
                            break
                if best is not None:
                    break
            if best is not None:
                break
        if best is None:
            kept.append(r)
            result[r[0]] = ("kept", None, None)
        else:
            result[r[0]] = ("removed", best, "near")
    return result


@pytest.mark.parametrize("hot, rounds", [(0.0, 1), (0.6, 0), (0.6, 2)])
def test_first_wins_equals_the_loop(spark, hot, rounds):
    rows = make_rows(220, 7, hot)
    want = loop(rows)
    got = D.deduplicate(spark.createDataFrame(rows, SCHEMA), leader_rounds=rounds).collect()
    assert len(got) == len(rows)
    for r in got:
        status, of, reason = want[r["idx"]]
        assert (r["status"], r["duplicate_of"]) == (status, of), r["idx"]
        if status == "removed":
            assert r["duplicate_reason"].startswith("exact" if reason == "exact_sha256" else "near_duplicate")


def test_chain_keeps_the_far_end(spark):
    """A~B and B~C but not A~C: B goes, C stays because B was never kept."""
    edges = spark.createDataFrame([(2, 1), (3, 2)], "later_idx bigint, earlier_idx bigint")
    assert [r["idx"] for r in D.resolve_first_wins(edges).collect()] == [2]


def test_hash_slices_cover_all_bits(spark):
    row = spark.range(1).select(H.pieces(F.lit(-1).cast("bigint"), 9).alias("p")).first()["p"]
    assert sum(bin(x).count("1") for x in row) == 64 and len(row) == 9


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))

    def part(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


@pytest.fixture()
def image_root(tmp_path):
    rng = np.random.default_rng(0)
    for cls in ("rock", "stone"):
        (tmp_path / cls).mkdir()
        for i in range(3):
            img = np.zeros((20, 30, 3), dtype=np.uint8)
            img[4:14, 5 : 15 + i] = rng.integers(60, 255, (10, 10 + i, 3))
            png(tmp_path / cls / f"{cls}_grp{i}_deadbeef0{i}.PNG", img)
    (tmp_path / "rock" / "note.txt").write_text("x")
    return str(tmp_path)


def test_image_sources(spark, image_root):
    assert RD.read_image_dir(spark, image_root).count() == 6
    rows = RD.read_class_dirs(spark, image_root, {"rock": 0, "stone": 1}).collect()
    assert sorted((r["label"], r["group"]) for r in rows) == [(y, f"{c}:grp{i}") for c, y in (("rock", 0), ("stone", 1)) for i in range(3)]
    with pytest.raises(Exception):
        RD.read_class_dirs(spark, image_root, {"nothing": 0}).collect()
    imgs = RD.read_images(spark, image_root)
    stats = I.size_stats(imgs.select("image.width", "image.height")).first()
    assert (stats["n"], stats["width_min"], stats["height_max"], stats["width_var"]) == (6, 30, 20, 0.0)


def test_crops_and_fingerprints(spark, image_root):
    imgs = RD.read_images(spark, image_root)
    cut = I.crop_to_square(imgs, ("name",), threshold=8, padding=0.1, size=32)
    rows = {r["name"]: r for r in cut.collect()}
    r = rows["rock_grp0_deadbeef00.PNG"]
    assert (r["bbox_left"], r["bbox_top"], r["bbox_right"], r["bbox_bottom"]) == (5, 4, 15, 14)
    assert r["bbox_area_ratio"] == pytest.approx(100 / 600) and r["image"]["width"] == 32
    prints = I.fingerprints(cut, ("name",)).collect()
    assert len({p["digest"] for p in prints}) == 6 and all(len(p["feature"]) == 48 * 48 for p in prints)
    dims = I.stats_features(cut, ("name",)).select(F.size("embedding").alias("d")).first()["d"]
    assert dims == 3 * 24 + 2 * 16 + 28 * 28 + 3 * 8 * 8 * 2


def test_views_match_numpy(spark):
    grid = np.arange(6).reshape(2, 3)
    want = {
        "identity": grid, "hflip": grid[:, ::-1], "vflip": grid[::-1], "rot90": np.rot90(grid), "rot180": np.rot90(grid, 2),
        "rot270": np.rot90(grid, 3), "transpose": grid.T, "transverse": np.rot90(grid.T, 2),
    }
    df = spark.createDataFrame([(1, grid.ravel().tolist(), 3, 2)], "id int, px array<int>, w int, h int")
    got = {r["view"]: r["view_px"] for r in I.expand_views(df, "8way").collect()}
    assert got == {k: v.ravel().tolist() for k, v in want.items()}
    with pytest.raises(ValueError):
        I.expand_views(df, "5way")


def test_empty_foreground_and_mask(spark):
    df = spark.createDataFrame([([0, 0, 0, 0],)], "px array<int>")
    row = df.select(G.foreground_bbox(F.col("px"), F.lit(2)).alias("b"), G.mask_bbox(F.col("px"), F.lit(2), F.lit(2)).alias("m")).first()
    assert row["b"] is None and tuple(row["m"]) == (0, 0, 1, 1)


def test_pixel_statistics_of_image_files(spark, image_root):
    """Channel moments, white ratio and box come from PNG files through the pixel planes."""
    imgs = RD.read_images(spark, image_root)
    whole = I.pixel_planes(imgs, ("name",))
    assert {(r["w"], r["h"], len(r["r"])) for r in whole.collect()} == {(30, 20, 600)}
    stats = I.channel_moments(I.channel_sums(I.pixel_planes(imgs, ("name",), 224), {"red": "r", "blue": "b"}), ("red", "blue")).first()
    raw = np.array([r["r"] for r in whole.collect()])
    assert stats["n_images"] == 6 and stats["n_pixels"] == 6 * 224 * 224
    assert stats["mean_red"] == pytest.approx(raw.mean(), abs=0.5) and 0 < stats["std_red"] <= raw.std() + 1
