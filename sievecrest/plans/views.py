"""Audit-shaped views over the star-schema, document and embedding tables.

Each view has a Spark builder and the same definition as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("grp"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("label"),
        (((F.col("event_id") * 7919 + 13) % 1001) / F.lit(1001.0)).alias("prob_pos"),
    )


def scored_long(spark: SparkSession, folder: str, models: int = 5) -> DataFrame:
    return (
        scored(spark, folder)
        .select("id", "grp", "label", F.explode(F.array(*[F.lit(m) for m in range(models)])).alias("m"))
        .select(
            "id",
            "grp",
            "label",
            F.concat(F.lit("m"), F.col("m")).alias("model"),
            (((F.col("id") * (F.lit(7919) + 2 * F.col("m")) + 13 * F.col("m")) % 1001) / F.lit(1001.0)).alias("prob"),
        )
    )


def model_scores(spark: SparkSession, folder: str, m: int) -> DataFrame:
    """The rows of ``scored_long`` of model ``m`` alone, made without those of the others."""
    prob = ((F.col("id") * F.lit(7919 + 2 * m) + F.lit(13 * m)) % 1001) / F.lit(1001.0)
    return scored(spark, folder).select("id", "grp", "label", F.lit(f"m{m}").alias("model"), prob.alias("prob"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    slot = F.col("vec_id") % 8
    source = F.when(slot == 5, "myval").when(slot == 6, "test").when(slot == 7, "extra").otherwise("train")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        source.alias("source"),
        F.when(slot != 6, F.col("label") % 2).alias("label"),
        F.col("label").alias("grp"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings seen as 8x8 grey images with values 0..255."""
    grey = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.floor((F.least(F.greatest(x, F.lit(-0.5)), F.lit(0.5)) + 0.5) * 255).cast("int"),
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit(8).alias("w"), F.lit(8).alias("h"), grey.alias("px"), "label"
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line of every document, with a made-up recognition score."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
        .withColumn("score", ((F.col("doc_id") * 31 + F.col("line_no")) % 100) / F.lit(100.0))
    )


def doc_labels(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id")
        .select("doc_id", "quality", "toxic", "lang", "source")
    )


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ship day; days are few, so the ordering window is over a bounded table."""
    from pyspark.sql import Window

    days = (
        table(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("day"))
        .agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"), F.count(F.lit(1)).alias("n"))
    )
    return days.select(
        F.dense_rank().over(Window.orderBy("day")).alias("epoch"),
        F.round(F.col("d") / F.col("n") / 10.0, 4).alias("val_f1"),
    )


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scored(spark, folder)
        .where(F.col("id") % 10 != 0)
        .select("id", F.col("prob_pos"), (F.col("prob_pos") >= 0.5).cast("int").alias("label"))
    )


SQL = {
    "scored": """scored AS (SELECT event_id AS id, user_id AS grp,
      CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END AS label,
      ((event_id*7919+13)%1001)::DOUBLE/1001e0 AS prob_pos FROM events)""",
    "scored_long": """scored_long AS (SELECT id, grp, label, concat('m', m) AS model,
      ((id*(7919+2*m)+13*m)%1001)::DOUBLE/1001e0 AS prob FROM scored, range(0,5) r(m))""",
    "manifest": """manifest AS (SELECT vec_id AS sample_id,
      CASE vec_id%8 WHEN 5 THEN 'myval' WHEN 6 THEN 'test' WHEN 7 THEN 'extra' ELSE 'train' END AS source,
      CASE WHEN vec_id%8<>6 THEN label%2 END AS label, label AS grp,
      embedding::DOUBLE[] AS embedding FROM embeddings)""",
    "pixels": """pixels AS (SELECT vec_id AS id, 8 AS w, 8 AS h, list_transform(embedding::DOUBLE[],
      lambda x: CAST(floor((least(greatest(x,-0.5e0),0.5e0)+0.5e0)*255) AS INT)) AS px, label FROM embeddings)""",
    "texts": """texts AS (SELECT doc_id, (u.i-1)::INT AS line_no, u.line AS text,
      ((doc_id*31+u.i-1)%100)::DOUBLE/100e0 AS score
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d,
      LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls,1) AS i) u)""",
    "doc_labels": """doc_labels AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source
      FROM labels l JOIN documents d USING (doc_id))""",
    "epochs": """epochs AS (SELECT dense_rank() OVER (ORDER BY day)::INT AS epoch,
      round(d::DOUBLE/n/10e0, 4) AS val_f1 FROM (SELECT l_shipdate::DATE AS day,
      sum(round(l_discount*100)::BIGINT)::BIGINT AS d, count(*) AS n FROM lineitem GROUP BY 1))""",
    "baseline": "baseline AS (SELECT id, CASE WHEN id%3=0 THEN 1 ELSE 0 END AS label FROM scored)",
    "predictions": """predictions AS (SELECT id, prob_pos, (prob_pos>=0.5)::INT AS label
      FROM scored WHERE id%10<>0)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """``pixels`` as 8x8 three-channel rows of the image source (data is BGR)."""
    rgb = pixels(spark, folder)
    for k, c in enumerate("rgb"):
        rgb = rgb.withColumn(c, F.concat(F.slice("px", k + 1, 64 - k), F.slice("px", 1, k)) if k else F.col("px"))
    from sievecrest.functions.hashing import gray_bytes

    bgr = F.flatten(F.transform(F.arrays_zip("b", "g", "r"), lambda s: F.array(s["b"], s["g"], s["r"])))
    return rgb.withColumn("data", gray_bytes(bgr)).select(
        "id", "label", "px", "r", "g", "b",
        F.struct(
            F.concat(F.lit("mem:"), F.col("id").cast("string")).alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"),
            F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data",
        ).alias("image"),
    )


def hash_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``pixels`` with exact and slightly changed copies, their hashes and low-resolution vectors."""
    from sievecrest.functions import hashing as H
    from sievecrest.functions.vectors import zscore

    base = pixels(spark, folder).select("id", "px", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    base = base.where("k = 0 OR (k = 1 AND id % 3 = 0) OR (k = 2 AND id % 2 = 0) OR (k = 3 AND id % 5 = 0)")
    at = F.col("id") % 64
    changed = F.transform(
        "px", lambda x, i: F.when((F.col("k") >= 2) & ((i == at) | ((F.col("k") == 3) & (i == 63 - at))), F.least(x + 9, F.lit(255))).otherwise(x)
    )
    rows = base.withColumn("px", changed).withColumn("idx", F.col("id") * 4 + F.col("k"))
    wide = F.concat("px", F.slice("px", 1, 8))
    return rows.select(
        "idx",
        H.average_hash(F.col("px")).alias("ahash"),
        H.difference_hash(wide).alias("dhash"),
        H.bits_to_long(F.transform("px", lambda x: x >= 128)).alias("phash"),
        H.color_hash(F.col("px"), F.reverse("px"), F.col("px")).alias("chash"),
        F.sha2(F.array_join("px", ","), 256).alias("digest"),
        zscore(F.col("px").cast("array<double>")).alias("feature"),
    )


def _packed(bits: str) -> str:
    """SQL: list of booleans -> signed 64-bit value, first bit highest."""
    v = f"list_reduce(list_transform({bits}, lambda zz: zz::HUGEINT), lambda p, q: p*2+q)"
    return f"(CASE WHEN {v} >= 9223372036854775808::HUGEINT THEN {v}-18446744073709551616::HUGEINT ELSE {v} END)::BIGINT"


SQL["images"] = """images AS (SELECT id, label, px, px AS r, list_concat(px[2:], px[:1]) AS g, list_concat(px[3:], px[:2]) AS b FROM pixels)"""
SQL["hash_rows"] = f"""hr0 AS (SELECT id, k, px FROM pixels, range(0,4) r(k) WHERE k=0 OR (k=1 AND id%3=0) OR (k=2 AND id%2=0) OR (k=3 AND id%5=0)),
  hr1 AS (SELECT id*4+k AS idx, list_transform(px, lambda x, i: CASE WHEN k>=2 AND (i-1=id%64 OR (k=3 AND i-1=63-id%64)) THEN least(x+9,255) ELSE x END) AS px FROM hr0),
  hr2 AS (SELECT *, list_avg(px) AS m, list_concat(px, px[:8]) AS wd, list_transform(px, lambda x, i: (x//64)*16+(px[65-i]//64)*4+x//64) AS code FROM hr1),
  hash_rows AS MATERIALIZED (SELECT idx, {_packed('list_transform(px, lambda x: x>=m)')} AS ahash,
   {_packed('list_transform(range(0,64), lambda i: wd[(i//8)*9+i%8+2] >= wd[(i//8)*9+i%8+1])')} AS dhash,
   {_packed('list_transform(px, lambda x: x>=128)')} AS phash,
   {_packed('list_transform(range(0,64), lambda c: len(list_filter(code, lambda y: y=c))>=1)')} AS chash,
   sha256(array_to_string(px, ',')) AS digest,
   list_transform(px, lambda x: (x-m)/(CASE WHEN list_stddev_pop(px)>1e-6 THEN list_stddev_pop(px) ELSE 1 END)) AS feature FROM hr2)"""
SQL["hash_matches"] = """ch AS MATERIALIZED (SELECT *, list_transform([48,32,16,0], lambda s: ((phash::HUGEINT + CASE WHEN phash<0 THEN 18446744073709551616::HUGEINT ELSE 0 END) // (2::HUGEINT**s)::HUGEINT % 65536)::INT) AS pc,
    list_transform([48,32,16,0], lambda s: ((dhash::HUGEINT + CASE WHEN dhash<0 THEN 18446744073709551616::HUGEINT ELSE 0 END) // (2::HUGEINT**s)::HUGEINT % 65536)::INT) AS dc FROM hash_rows),
  pr AS (SELECT a.idx AS later_idx, b.idx AS earlier_idx, a.digest=b.digest AS same, bit_count(xor(a.phash,b.phash)) AS p, bit_count(xor(a.dhash,b.dhash)) AS d,
    bit_count(xor(a.ahash,b.ahash)) AS ah, bit_count(xor(a.chash,b.chash)) AS c, 1-list_inner_product(a.feature,b.feature)/64 AS corr,
    CASE WHEN list_contains(b.pc,a.pc[1]) THEN 0 WHEN list_contains(b.pc,a.pc[2]) THEN 1 WHEN list_contains(b.pc,a.pc[3]) THEN 2 WHEN list_contains(b.pc,a.pc[4]) THEN 3
         WHEN list_contains(b.dc,a.dc[1]) THEN 4 WHEN list_contains(b.dc,a.dc[2]) THEN 5 WHEN list_contains(b.dc,a.dc[3]) THEN 6 WHEN list_contains(b.dc,a.dc[4]) THEN 7 END AS ord
    FROM ch a JOIN ch b ON a.idx>b.idx),
  hash_matches AS MATERIALIZED (SELECT later_idx, earlier_idx, same, ord, CASE WHEN p<=4 AND d<=4 AND corr<=0.08 THEN concat('near_duplicate_phash=',p,';dhash=',d,';corr_dist=',printf('%.4f',round(corr,9)+0e0))
    ELSE concat('near_duplicate_hash_combo=phash:',p,',dhash:',d,',ahash:',ah,',color:',c,';corr_dist=',printf('%.4f',round(corr,9)+0e0)) END AS reason
    FROM pr WHERE ord IS NOT NULL AND ((p<=4 AND d<=4 AND corr<=0.08) OR (p<=8 AND d<=8 AND ah<=8 AND c<=10 AND corr<=0.04)))"""
