"""Pixel, mask, hash and duplicate queries over image-shaped views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions import geometry as G
from sievecrest.functions import hashing as H
from sievecrest.functions.vectors import correlation_distance, zscore
from sievecrest.operators import dedup as D
from sievecrest.operators import images as I
from sievecrest.plans import views as V
from sievecrest.plans.views import _packed, with_views
from sievecrest.session import cut_lineage

PX = with_views("pixels")
BOX = """bx AS (SELECT id, px, w, h, list_min(list_transform(hits, lambda i: i%w)) AS x1, list_min(list_transform(hits, lambda i: i//w)) AS y1,
   list_max(list_transform(hits, lambda i: i%w))+1 AS x2, list_max(list_transform(hits, lambda i: i//w))+1 AS y2 FROM
   (SELECT *, list_filter(range(0,64), lambda i: px[i+1]>{t}) AS hits FROM pixels))"""


@query(
    "foreground_boxes",
    f"""{PX}, {BOX.format(t=185)} SELECT id, x1::INT AS left, y1::INT AS top, x2::INT AS right, y2::INT AS bottom,
    greatest(0, x1-round_even(greatest(x2-x1,y2-y1)*0.25e0,0))::INT AS p_left, greatest(0,y1-round_even(greatest(x2-x1,y2-y1)*0.25e0,0))::INT AS p_top,
    least(8, x2+round_even(greatest(x2-x1,y2-y1)*0.25e0,0))::INT AS p_right, least(8,y2+round_even(greatest(x2-x1,y2-y1)*0.25e0,0))::INT AS p_bottom,
    round((x2-x1)*(y2-y1)/64e0,8) AS bbox_area_ratio, round(len(list_filter(px, lambda x: x>185))/64e0,8) AS foreground_ratio FROM bx WHERE x1 IS NOT NULL""",
)
def _(spark, d):
    px, w, h = F.col("px"), F.col("w"), F.col("h")
    df = V.pixels(spark, d).withColumn("box", G.foreground_bbox(px, w, 185)).where("box IS NOT NULL")
    df = df.withColumn("pad", G.padded_bbox(F.col("box"), w, h, 0.25))
    return df.select(
        "id", "box.*", *[F.col(f"pad.{c}").alias(f"p_{c}") for c in ("left", "top", "right", "bottom")],
        F.round(G.bbox_area_ratio(F.col("box"), w, h), 8).alias("bbox_area_ratio"),
        F.round(G.foreground_ratio(px, 185), 8).alias("foreground_ratio"),
    )


SQUARE = """sq AS (SELECT id, x1, y1, x2, y2, x2-x1 AS bw, y2-y1 AS bh, greatest(x2-x1,y2-y1) AS side FROM fr),
  s2 AS (SELECT *, CASE WHEN bw>bh THEN x1 ELSE x1-(bh-bw)//2 END AS sx, CASE WHEN bw>bh THEN y1-(bw-bh)//2 ELSE y1 END AS sy, floor(side*0.3e0)::INT AS pad FROM sq)"""


@query(
    "mask_squares",
    f"""{PX}, {BOX.format(t=205)}, fr AS (SELECT id, coalesce(x1,0) AS x1, coalesce(y1,0) AS y1, coalesce(x2-1,7) AS x2, coalesce(y2-1,7) AS y2 FROM bx), {SQUARE}
    SELECT id, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2, greatest(0,sx-pad)::INT AS sx1, greatest(0,sy-pad)::INT AS sy1,
    least(7, (CASE WHEN bw>bh THEN x2 ELSE sx+bh END)+pad)::INT AS sx2, least(7,(CASE WHEN bw>bh THEN sy+bw ELSE y2 END)+pad)::INT AS sy2 FROM s2""",
)
def _(spark, d):
    mask = F.transform("px", lambda x: F.when(x > 205, 255).otherwise(0))
    w, h = F.col("w"), F.col("h")
    df = V.pixels(spark, d).withColumn("m", G.mask_bbox(mask, w, h)).withColumn("s", G.expand_and_square(F.col("m"), w, h, 0.3))
    return df.select("id", "m.*", *[F.col(f"s.{c}").alias("s" + c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "masked_pixels",
    f"""{PX}, n AS (SELECT a.id, a.px, b.px AS mk FROM pixels a JOIN pixels b ON b.id=a.id+1)
    SELECT id, list_transform(px, lambda x, i: CASE WHEN mk[i]>127 THEN x ELSE 0 END) AS kept, list_transform(px, lambda x, i: CASE WHEN mk[i]>127 THEN 0 ELSE x END) AS inverse,
    list_transform(px, lambda x, i: floor(x*(mk[i]/255e0))::INT) AS soft FROM n""",
)
def _(spark, d):
    p = V.pixels(spark, d)
    m = p.select((F.col("id") - 1).alias("id"), F.col("px").alias("mk"))
    hard = F.transform("mk", lambda x: F.when(x > 127, 255).otherwise(0))
    return p.join(m, "id").select(
        "id", G.apply_mask(F.col("px"), hard).alias("kept"), G.apply_mask(F.col("px"), hard, invert=True).alias("inverse"),
        G.soft_mask(F.col("px"), F.col("mk")).alias("soft"),
    )


@query(
    "crop_and_canvas",
    f"""{PX}, c AS (SELECT id, px, (id%3)::INT AS x1, (id%2)::INT AS y1, (5+id%4)::INT AS x2, (6+id%2)::INT AS y2 FROM pixels),
    q AS (SELECT *, list_transform(range(0,(x2-x1)*(y2-y1)), lambda i: px[(y1+i//(x2-x1))*8+x1+i%(x2-x1)+1]) AS cut, greatest(x2-x1,y2-y1) AS side FROM c)
    SELECT id, cut, list_transform(range(0,side*side), lambda i: CASE WHEN i%side-(side-(x2-x1))//2 BETWEEN 0 AND x2-x1-1 AND i//side-(side-(y2-y1))//2 BETWEEN 0 AND y2-y1-1
      THEN cut[(i//side-(side-(y2-y1))//2)*(x2-x1)+i%side-(side-(x2-x1))//2+1] ELSE 7 END) AS square FROM q""",
)
def _(spark, d):
    i = F.col("id")
    x1, y1, x2, y2 = (e.cast("int") for e in (i % 3, i % 2, 5 + i % 4, 6 + i % 2))
    cut = G.crop(F.col("px"), F.col("w"), x1, y1, x2, y2)
    return V.pixels(spark, d).withColumn("cut", cut).select("id", "cut", G.square_canvas(F.col("cut"), x2 - x1, y2 - y1, 7).alias("square"))


@query(
    "small_masks",
    f"{PX}, r AS (SELECT id, len(list_filter(px, lambda x: x>=200))/64e0 AS white FROM pixels) SELECT id, round(white,6) AS white, white<0.05 AS small FROM r",
)
def _(spark, d):
    mask = F.transform("px", lambda x: F.when(x >= 200, 255).otherwise(0))
    return V.pixels(spark, d).select("id", G.white_ratio(mask).alias("white")).select(
        "id", F.round("white", 6).alias("white"), (F.col("white") < 0.05).alias("small")
    )


@query(
    "below_threshold_masks",
    """WITH m AS (SELECT l_orderkey AS base, l_linenumber AS name, l_discount*4 AS ratio FROM lineitem GROUP BY ALL),
    b AS (SELECT base, name AS bn, ratio AS br FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ratio DESC, name) AS rn FROM m) WHERE rn=1)
    SELECT base, name, round(ratio,6) AS ratio, bn AS best_name, round(br,6) AS best_ratio, name=bn AS is_best FROM m JOIN b USING (base) WHERE ratio<0.15""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("base"), F.col("l_linenumber").alias("name"), (F.col("l_discount") * 4).alias("ratio")).distinct()
    out = I.best_masks(li, "base", "name", "ratio", 0.15)
    return out.withColumn("ratio", F.round("ratio", 6)).withColumn("best_ratio", F.round("best_ratio", 6))


@query(
    "image_size_stats",
    """SELECT count(*) AS n, round(avg(w),4) AS width_mean, round(var_pop(w),4) AS width_var, round(stddev_pop(w),4) AS width_std, min(w) AS width_min, max(w) AS width_max,
    round(avg(h),4) AS height_mean, round(var_pop(h),4) AS height_var, round(stddev_pop(h),4) AS height_std, min(h) AS height_min, max(h) AS height_max,
    round(avg(w::DOUBLE*h),4) AS area_mean, round(var_pop(w::DOUBLE*h),2) AS area_var, round(stddev_pop(w::DOUBLE*h),4) AS area_std
    FROM (SELECT (100+l_partkey%500) AS w, (80+l_suppkey%300) AS h FROM lineitem)""",
)
def _(spark, d):
    df = V.table(spark, d, "lineitem").select((100 + F.col("l_partkey") % 500).alias("width"), (80 + F.col("l_suppkey") % 300).alias("height"))
    out = I.size_stats(df)
    return out.select(*[F.round(c, 2 if c == "area_var" else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "channel_moments",
    f"""{with_views('pixels','images')}, u AS (SELECT unnest(r) AS r, unnest(g) AS g, unnest(b) AS b FROM images), n AS (SELECT count(*) AS k FROM images),
    s AS (SELECT count(*) AS np, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, avg(r::DOUBLE*r)-avg(r)**2 AS vr, avg(g::DOUBLE*g)-avg(g)**2 AS vg, avg(b::DOUBLE*b)-avg(b)**2 AS vb FROM u)
    SELECT (SELECT k FROM n) AS n_images, np AS n_pixels, round(mr,4) AS mean_r, round(vr,4) AS var_r, round(sqrt(vr)/255,6) AS std_r_norm, round((mr+mg+mb)/3,4) AS mean_gray, round(sqrt((vr+vg+vb)/3)/255,6) AS std_gray_norm FROM s""",
)
def _(spark, d):
    sums = I.channel_sums(V.images(spark, d), {"r": "r", "g": "g", "b": "b"})
    out = I.channel_moments(sums, ("r", "g", "b"))
    return out.select(
        "n_images", "n_pixels", *[F.round(c, k).alias(c) for c, k in (("mean_r", 4), ("var_r", 4), ("std_r_norm", 6), ("mean_gray", 4), ("std_gray_norm", 6))]
    )


VIEW_SQL = " UNION ALL ".join(
    f"SELECT id, '{n}' AS \"view\", list_transform(range(0,64), lambda i: px[({e})+1]) AS view_px FROM pixels"
    for n, e in {
        "identity": "i", "hflip": "(i//8)*8+7-i%8", "vflip": "(7-i//8)*8+i%8", "rot90": "(i%8)*8+7-i//8", "rot180": "63-i",
        "rot270": "(7-i%8)*8+i//8", "transpose": "(i%8)*8+i//8", "transverse": "(7-i%8)*8+7-i//8",
    }.items()
)


@query("test_time_views", f"{PX} {VIEW_SQL}")
def _(spark, d):
    return I.expand_views(V.pixels(spark, d), "8way").select("id", "view", "view_px")


@query(
    "view_mean_scores",
    f"""{PX}, v AS ({VIEW_SQL}) SELECT id, round(avg(list_sum(list_transform(view_px, lambda x, i: x*(i-1)))/514080e0),6) AS prob_pos, count(*) AS n_views FROM v WHERE "view" IN ('identity','hflip','vflip','rot90') GROUP BY id""",
)
def _(spark, d):
    from sievecrest.operators.pooling import mean_over

    v = I.expand_views(V.pixels(spark, d), "4way")
    score = F.aggregate(F.transform("view_px", lambda x, i: x * i), F.lit(0), lambda a, x: a + x) / F.lit(514080.0)
    return mean_over(v.withColumn("prob", score), ["id"]).withColumn("prob_pos", F.round("prob_pos", 6))


# ---- hashes -------------------------------------------------------------------------------


@query("image_hashes", f"{with_views('pixels','hash_rows')} SELECT idx, ahash, dhash, phash, chash, digest FROM hash_rows")
def _(spark, d):
    return V.hash_rows(spark, d).drop("feature")


@query(
    "perceptual_hash",
    f"""{PX}, k AS (SELECT u::INT AS u, x::INT AS x, cos((2*x+1)*u*pi()/64e0)*CASE WHEN u=0 THEN sqrt(1/32e0) ELSE sqrt(2/32e0) END AS c FROM range(0,8) a(u), range(0,32) b(x)),
    g AS (SELECT id, y::INT AS y, x::INT AS x, ((px[(y//4)*8+x//4+1]*19595+px[((y//4)*8+x//4+1)%64+1]*38470+px[((y//4)*8+x//4+2)%64+1]*7471+32768)//65536) AS v FROM pixels, range(0,32) a(y), range(0,32) b(x)),
    t AS (SELECT id, y, u, sum(v*c) AS s FROM g JOIN k USING (x) GROUP BY ALL),
    f AS (SELECT t.id, k.u AS v, t.u AS u, sum(t.s*k.c) AS s FROM t JOIN k ON k.x=t.y GROUP BY ALL),
    l AS (SELECT id, list(s ORDER BY v, u) AS lo, median(s) FILTER (u+v>0) AS m FROM f GROUP BY id)
    SELECT id, {_packed('list_transform(lo, lambda x: x>=m)')} AS phash FROM l""",
)
def _(spark, d):
    return I.fingerprints(V.images(spark, d), ("id",)).select("id", "phash")


@query("pixel_digest", f"{with_views('pixels','images')} SELECT id, sha256(array_to_string(px,',')) AS px_digest FROM images")
def _(spark, d):
    return V.images(spark, d).select("id", H.digest(F.array_join("px", ",")).alias("px_digest"))


@query("image_fingerprints")
def _(spark, d):
    return I.fingerprints(V.images(spark, d), ("id",)).drop("feature")


@query("image_stats_features")
def _(spark, d):
    out = I.stats_features(V.images(spark, d), ("id",))
    return out.select("id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("foreground_square_crops")
def _(spark, d):
    out = I.crop_to_square(V.images(spark, d), ("id",), threshold=170, padding=0.1, size=8)
    return out.select("id", "bbox_left", "bbox_top", "bbox_right", "bbox_bottom", "bbox_area_ratio", "foreground_ratio", H.digest(F.col("image.data")).alias("digest"))


@query(
    "correlation_distances",
    f"""{PX}, z AS (SELECT id, list_transform(px, lambda x: (x-list_avg(px))/(CASE WHEN list_stddev_pop(px)>1e-6 THEN list_stddev_pop(px) ELSE 1 END)) AS f, px FROM pixels)
    SELECT a.id, round(1-list_inner_product(a.f,b.f)/64,6) AS corr_dist, bit_count(xor(a.id, b.id*977))::INT AS bits FROM z a JOIN z b ON b.id=a.id+1""",
)
def _(spark, d):
    z = V.pixels(spark, d).select("id", zscore(F.col("px").cast("array<double>")).alias("f"))
    other = z.select((F.col("id") - 1).alias("id"), F.col("f").alias("g"))
    return z.join(other, "id").select(
        "id", F.round(correlation_distance(F.col("f"), F.col("g")), 6).alias("corr_dist"), H.hamming(F.col("id"), (F.col("id") + 1) * 977).alias("bits")
    )


# ---- duplicates ---------------------------------------------------------------------------

HM = with_views("pixels", "hash_rows", "hash_matches")


@query(
    "exact_duplicates",
    f"{with_views('pixels','hash_rows')} SELECT digest, min(idx) AS first_idx, count(*) AS copies FROM hash_rows GROUP BY digest",
)
def _(spark, d):
    return D.exact_duplicates(V.hash_rows(spark, d))


@query("near_duplicate_pairs", f"{HM} SELECT later_idx, earlier_idx, ord, reason FROM hash_matches")
def _(spark, d):
    rows = cut_lineage(V.hash_rows(spark, d))
    return D.matched_pairs(D.hash_pairs(rows, rows), rows)


DECIDE = f"""{HM.replace('WITH ', 'WITH RECURSIVE ', 1)}, ordered AS MATERIALIZED (SELECT idx, digest, row_number() OVER (ORDER BY idx) AS n FROM hash_rows),
   mt AS MATERIALIZED (SELECT o.n, o.idx, list(m.earlier_idx) FILTER (m.earlier_idx IS NOT NULL) AS es FROM ordered o LEFT JOIN
     (SELECT later_idx, earlier_idx FROM hash_matches UNION SELECT a.idx, b.idx FROM hash_rows a JOIN hash_rows b ON a.digest=b.digest AND a.idx>b.idx) m ON m.later_idx=o.idx GROUP BY ALL),
   walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL
     SELECT w.n+1, CASE WHEN list_has_any(w.kept, coalesce(mt.es, []::BIGINT[])) THEN w.kept ELSE list_append(w.kept, mt.idx) END FROM walk w JOIN mt ON mt.n=w.n+1),
   fin AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)),
   firsts AS (SELECT digest, min(idx) AS f FROM hash_rows GROUP BY 1),
   att AS (SELECT later_idx, earlier_idx, reason FROM (SELECT m.*, row_number() OVER (PARTITION BY later_idx ORDER BY ord, earlier_idx) AS rn FROM hash_matches m JOIN fin ON fin.k=m.earlier_idx) WHERE rn=1),
   dec AS (SELECT h.idx, CASE WHEN h.idx IN (SELECT k FROM fin) THEN 'kept' ELSE 'removed' END AS status,
     CASE WHEN h.idx IN (SELECT k FROM fin) THEN NULL WHEN f.f IN (SELECT k FROM fin) THEN f.f ELSE a.earlier_idx END AS duplicate_of,
     CASE WHEN h.idx IN (SELECT k FROM fin) THEN NULL WHEN f.f IN (SELECT k FROM fin) THEN 'exact_sha256' ELSE a.reason END AS duplicate_reason
     FROM hash_rows h JOIN firsts f USING (digest) LEFT JOIN att a ON a.later_idx=h.idx)"""


@query("first_wins_dedup", f"{DECIDE} SELECT * FROM dec")
def _(spark, d):
    return D.deduplicate(V.hash_rows(spark, d)).drop("digest")


@query("dedup_status_counts", f"{DECIDE} SELECT (idx%4)::INT AS category, count(*) FILTER (status='kept') AS kept, count(*) FILTER (status='removed') AS removed FROM dec GROUP BY 1")
def _(spark, d):
    return D.status_counts(D.deduplicate(V.hash_rows(spark, d)).withColumn("category", (F.col("idx") % 4).cast("int")))


@query(
    "dedup_manifest",
    f"""{DECIDE} SELECT status, 'c'||(idx%4) AS category, 'src/'||idx AS source_path, 'out/'||idx||'.png' AS output_path,
     CASE WHEN duplicate_of IS NULL THEN '' ELSE 'out/'||duplicate_of||'.png' END AS duplicate_of, coalesce(duplicate_reason,'') AS duplicate_reason,
     printf('%.8f', (idx%7)/8e0) AS bbox_area_ratio, printf('%.8f', (idx%5)/16e0) AS foreground_ratio FROM dec""",
)
def _(spark, d):
    rows = V.hash_rows(spark, d)
    idx = F.col("idx")
    meta = rows.select(
        "idx", F.concat(F.lit("c"), idx % 4).alias("category"), F.concat(F.lit("src/"), idx).alias("source_path"),
        F.concat(F.lit("out/"), idx, F.lit(".png")).alias("output_path"), (idx % 7 / F.lit(8.0)).alias("bbox_area_ratio"), (idx % 5 / F.lit(16.0)).alias("foreground_ratio"),
    )
    return D.dedup_manifest(D.deduplicate(rows), meta)
