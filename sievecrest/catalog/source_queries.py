"""Reader, writer, cache and incremental queries: tables go out to files and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions.scores import threshold_label
from sievecrest.operators import images as I
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views
from sievecrest.session import scratch_path
from sievecrest.sources import readers as RD
from sievecrest.sources import writers as WR
from sievecrest.streaming import incremental as X


@query("labels_csv_roundtrip", "SELECT doc_id::VARCHAR AS id, quality AS label FROM labels")
def _(spark, d):
    path = scratch_path(spark, "labels")
    rows = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic")
    WR.write_csv(rows, path, ["id", "label", "toxic"], [F.col("id")])
    return RD.read_labels(spark, path)


@query("probs_csv_roundtrip", f"{with_views('scored')} SELECT id::VARCHAR AS id, round(prob_pos,6) AS prob_pos_corrected FROM scored")
def _(spark, d):
    path = scratch_path(spark, "probs")
    rows = V.scored(spark, d).select("id", F.round("prob_pos", 6).alias("prob_pos"), "label")
    WR.write_csv(rows, path, ["id", "prob_pos", "label"])
    return RD.read_probs(spark, path)


@query("prefixed_csv", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS cust_seg, c_nationkey::VARCHAR AS cust_nation FROM customer")
def _(spark, d):
    path = scratch_path(spark, "prefixed")
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"))
    WR.write_csv(rows, path, ["id", "seg", "nation"])
    return RD.read_prefixed(spark, path, "cust")


@query("id_list_text", "SELECT DISTINCT user_id::VARCHAR AS id FROM events")
def _(spark, d):
    path = scratch_path(spark, "ids")
    rows = V.table(spark, d, "events")
    WR.write_id_list(rows.select(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("  ")).alias("id")), path)
    return RD.read_id_list(spark, path)


@query("number_list_text", "SELECT DISTINCT l_partkey::INT AS number FROM lineitem")
def _(spark, d):
    path = scratch_path(spark, "numbers")
    k = F.col("l_partkey")
    WR.write_id_list(V.table(spark, d, "lineitem").select(F.when(k % 2 == 0, F.format_string("%06d.jpg", k)).otherwise(k.cast("string")).alias("id")).distinct(), path)
    return RD.read_number_list(spark, path)


@query("discovered_prob_tables", f"{with_views('scored','scored_long')} SELECT count(DISTINCT model) AS tables, count(*) AS rows, round(sum(round(prob,6)),3) AS total FROM scored_long")
def _(spark, d):
    path = scratch_path(spark, "tables")
    for m in range(5):
        part = V.model_scores(spark, d, m).select("id", F.round("prob", 6).alias("prob_pos_corrected"))
        WR.write_csv(part, f"{path}/m{m}", ["id", "prob_pos_corrected"])
    found = RD.discover_prob_tables(spark, path, recursive=True)
    return found.agg(
        F.count_distinct("folder").alias("tables"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("prob_pos_corrected"), 3).alias("total")
    )


@query(
    "json_summary_roundtrip",
    f"{with_views('scored')} SELECT count(*) AS n, count(*) FILTER (label=1) AS positives, concat('{{\"n\":',count(*),',\"positives\":',count(*) FILTER (label=1),'}}') AS summary FROM scored",
)
def _(spark, d):
    path = scratch_path(spark, "summary")
    WR.write_summary(V.scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives")), path)
    back = RD.read_json_sidecar(spark, path)
    return back.withColumn("summary", F.to_json(F.struct("n", "positives")))


@query(
    "ledger_tsv",
    """SELECT o_orderpriority AS status, count(*) AS rows, count(*) FILTER (o_orderkey%10=0) AS malformed FROM orders GROUP BY 1""",
)
def _(spark, d):
    path = scratch_path(spark, "ledger")
    o = V.table(spark, d, "orders")
    metric = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    head = ("commit", "primary_metric", "secondary_metric", "runtime_or_cost", "status", "description")
    rows = o.select(F.col("o_orderkey").alias("commit"), metric.alias("primary_metric"), F.lit("a=1; b=2").alias("secondary_metric"), F.lit("1").alias("runtime_or_cost"), F.col("o_orderpriority").alias("status"), F.lit("x").alias("description"))
    rows.select(*head).write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    led = RD.read_ledger(spark, path)
    return led.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count("_corrupt").alias("malformed"))


@query(
    "manifest_partitioned",
    f"{with_views('manifest')} SELECT source, count(*) AS n, count(label) AS labelled FROM manifest WHERE source IN ('test','myval') GROUP BY 1",
)
def _(spark, d):
    path = scratch_path(spark, "manifest")
    WR.write_manifest(V.manifest(spark, d), path)
    return spark.read.parquet(path).where("source IN ('test', 'myval')").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"))


@query("feature_cache", f"{with_views('manifest')} SELECT sample_id, round(embedding[1]*2,6) AS f0 FROM manifest WHERE source<>'test'")
def _(spark, d):
    path = scratch_path(spark, "cache")
    m = V.manifest(spark, d).select("sample_id", "source", "embedding")

    def compute(rows):
        return rows.select("sample_id", F.transform("embedding", lambda x: x * 2).alias("embedding"))

    WR.cached_features(spark, path, m.where("source = 'train'"), "tiny", compute)
    out = WR.cached_features(spark, path, m.where("source <> 'test'"), "tiny", compute)
    return out.select("sample_id", F.round(F.col("embedding")[0], 6).alias("f0"))


@query(
    "artifact_discovery",
    """WITH f AS (SELECT concat('out/run', l_partkey, '/', CASE l_linenumber%4 WHEN 0 THEN 'best.pt' WHEN 1 THEN 'soup3.pt' WHEN 2 THEN 'train_args.json' ELSE 'last.pt' END) AS path, l_partkey AS p FROM lineitem)
    SELECT DISTINCT replace(path,'out/','') AS tag FROM f WHERE (path LIKE '%/best.pt' OR path LIKE '%/soup3.pt') AND p IN (SELECT p FROM f WHERE path LIKE '%json')""",
)
def _(spark, d):
    kind = F.col("l_linenumber") % 4
    name = F.when(kind == 0, "best.pt").when(kind == 1, "soup3.pt").when(kind == 2, "train_args.json").otherwise("last.pt")
    files = V.table(spark, d, "lineitem").select(F.concat(F.lit("out/run"), "l_partkey", F.lit("/"), name).alias("path")).distinct()
    return RD.discover_artifacts(files).select("tag")


# ---- incremental --------------------------------------------------------------------------


@query(
    "incremental_scoring",
    """SELECT event_id, CASE WHEN value>5 THEN round(value/100,6) END AS prob_pos, CASE WHEN value>5 THEN 'result' ELSE 'empty' END AS status FROM events""",
)
def _(spark, d):
    out, ckpt = scratch_path(spark, "scored"), scratch_path(spark, "scored-progress")
    schema = V.table(spark, d, "events").schema

    def score(rows):
        return rows.where("value > 5").select("event_id", F.round(F.col("value") / 100, 6).alias("prob_pos"))

    for _ in range(2):  # the second call finds nothing new
        rows = X.score_new_files(spark, d, schema, out, ckpt, score, "event_id", "events.parquet")
    return rows.select("event_id", "prob_pos", "status")


@query(
    "unseen_inputs_batch",
    "SELECT event_id, (value>=10)::INT AS label FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, d):
    done = V.table(spark, d, "labels").select(F.col("doc_id").alias("event_id"))
    fresh = X.unseen(V.table(spark, d, "events").select("event_id", "value"), done, "event_id")
    return fresh.select("event_id", threshold_label(F.col("value"), 10).alias("label"))


@query(
    "running_channel_moments",
    f"""{with_views('pixels','images')}, u AS (SELECT unnest(r) AS r FROM images) SELECT (SELECT count(*) FROM images) AS n_images, count(*) AS n_pixels, round(avg(r),4) AS mean_r, round(avg(r::DOUBLE*r)-avg(r)**2,4) AS var_r FROM u""",
)
def _(spark, d):
    out, ckpt = scratch_path(spark, "moments"), scratch_path(spark, "moments-progress")
    schema = V.table(spark, d, "embeddings").schema

    def to_pixels(rows):
        grey = F.transform(
            F.col("embedding").cast("array<double>"),
            lambda x: F.floor((F.least(F.greatest(x, F.lit(-0.5)), F.lit(0.5)) + 0.5) * 255).cast("int"),
        )
        return rows.select(grey.alias("r"))

    sums = X.running_channel_sums(spark, d, schema, out, ckpt, to_pixels, {"r": "r"}, "embeddings.parquet")
    return I.channel_moments(sums, ("r",)).select("n_images", "n_pixels", F.round("mean_r", 4).alias("mean_r"), F.round("var_r", 4).alias("var_r"))
