"""Merge, baseline, mask, asset, pooling and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions.vectors import round_half_up
from sievecrest.operators import joins as J
from sievecrest.operators import pooling as P
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views

LONG = with_views("scored", "scored_long")


@query(
    "feature_merge_chain",
    f"""{with_views('scored')}, pos AS (SELECT id, label FROM scored WHERE label=1)
    SELECT p.id, p.label, o.o_totalprice AS orders_price, l.quality AS labels_quality FROM pos p
    LEFT JOIN orders o ON o.o_orderkey=p.id LEFT JOIN labels l ON l.doc_id=p.id""",
)
def _(spark, d):
    base = V.scored(spark, d).where("label = 1").select("id", "label")
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return J.merge_features(base, [J.prefixed(orders, "orders"), J.prefixed(labels, "labels")])


VOTES_SQL = f"""{LONG}, lab AS (SELECT id, model, CASE WHEN (id+hash_m)%4=0 THEN -1 ELSE (prob>=0.5)::INT END AS label FROM
   (SELECT *, substr(model,2)::INT AS hash_m FROM scored_long) WHERE id%13<>0)"""


def _votes(spark, d):
    lab = F.when((F.col("id") + F.substring("model", 2, 1).cast("int")) % 4 == 0, -1).otherwise((F.col("prob") >= 0.5).cast("int"))
    return V.scored_long(spark, d).where(F.col("id") % 13 != 0).select("id", "model", lab.alias("label"))


@query(
    "model_label_votes",
    f"""{VOTES_SQL}, v AS (SELECT id, coalesce(sum(label) FILTER (label>=0),0)::BIGINT AS p, count(*) FILTER (label>=0) AS c FROM lab GROUP BY id)
    SELECT s.id, coalesce(p,0) AS pos_votes, coalesce(c,0) AS model_count, CASE WHEN c>0 THEN round(p/c::DOUBLE,6) END AS pos_frac,
    coalesce(c,0)-coalesce(p,0) AS neg_votes FROM scored s LEFT JOIN v USING (id)""",
)
def _(spark, d):
    out = J.label_votes(V.scored(spark, d).select("id"), _votes(spark, d))
    return out.withColumn("pos_frac", F.round("pos_frac", 6))


@query(
    "baseline_diff_by_model",
    f"""{LONG}, {V.SQL['baseline']}, j AS (SELECT model, s.id, (prob>=0.5)::INT AS c, b.label AS b FROM scored_long s JOIN baseline b USING (id)),
    f AS (SELECT *, CASE WHEN b=1 AND c<>1 THEN 'down' WHEN b<>1 AND c=1 THEN 'up' END AS dir FROM j),
    t AS (SELECT model, dir, id FROM (SELECT *, row_number() OVER (PARTITION BY model, dir ORDER BY id) AS rn FROM f WHERE dir IS NOT NULL) WHERE rn<=25)
    SELECT model, count(*) AS n, count(*) FILTER (c=1) AS positives, count(*) FILTER (b<>c) AS diff_vs_baseline,
    count(*) FILTER (dir='down') AS baseline_pos_to_neg, count(*) FILTER (dir='up') AS baseline_neg_to_pos,
    (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM t WHERE t.model=f.model AND t.dir='down') AS pos_to_neg_ids,
    (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM t WHERE t.model=f.model AND t.dir='up') AS neg_to_pos_ids FROM f GROUP BY model""",
)
def _(spark, d):
    cand = V.scored_long(spark, d).select("id", "model", (F.col("prob") >= 0.5).cast("int").alias("label"))
    return J.baseline_diff(V.baseline(spark, d), cand, ["model"])


@query(
    "baseline_fill",
    f"""{with_views('scored','baseline','predictions')} SELECT b.id, coalesce(p.label,b.label) AS label, round(p.prob_pos,6) AS prob_pos,
    p.label IS NULL AS filled_from_baseline FROM baseline b LEFT JOIN predictions p USING (id)""",
)
def _(spark, d):
    out = J.baseline_fill(V.baseline(spark, d), V.predictions(spark, d))
    return out.withColumn("prob_pos", F.round("prob_pos", 6))


@query(
    "semi_anti_membership",
    """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents""",
)
def _(spark, d):
    docs, labels = V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels").select("doc_id")
    yes = docs.join(labels, "doc_id", "left_semi").withColumn("labelled", F.lit(True))
    return yes.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query(
    "map_lookup",
    """SELECT event_id, coalesce(f, 0e0) AS frac FROM events LEFT JOIN
    (SELECT user_id, round(count(*) FILTER (event_type='purchase')/count(*)::DOUBLE,6) AS f FROM events GROUP BY 1) USING (user_id)""",
)
def _(spark, d):
    ev = V.table(spark, d, "events").select("event_id", "user_id", "event_type")
    lookup = ev.groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1)), 6).alias("f"))
    return ev.join(lookup, "user_id", "left").select("event_id", F.coalesce("f", F.lit(0.0)).alias("frac"))


ASSETS_SQL = """assets AS (SELECT concat('000', l_orderkey, CASE WHEN l_linenumber=2 THEN '_nomask.done' ELSE '_mask_000.png' END) AS name,
   CASE WHEN l_linenumber=2 THEN '' ELSE concat('crop/000', l_orderkey, '_mask_000.png') END AS path, CASE WHEN l_linenumber=2 THEN 'nomask' ELSE 'mask' END AS status
   FROM lineitem WHERE (l_linenumber=1 AND l_orderkey%2=0) OR (l_linenumber=2 AND l_orderkey%3=0)
   UNION SELECT concat('h-000', o_orderkey, '_mask_000.png'), concat('crop/h-000', o_orderkey, '_mask_000.png'), 'mask' FROM orders WHERE o_orderkey%5=0)"""


def _assets(spark, d):
    li = V.table(spark, d, "lineitem").where("(l_linenumber = 1 AND l_orderkey % 2 = 0) OR (l_linenumber = 2 AND l_orderkey % 3 = 0)")
    second = F.col("l_linenumber") == 2
    stem = F.concat(F.lit("000"), F.col("l_orderkey"))
    a = li.select(
        F.concat(stem, F.when(second, "_nomask.done").otherwise("_mask_000.png")).alias("name"),
        F.when(second, "").otherwise(F.concat(F.lit("crop/"), stem, F.lit("_mask_000.png"))).alias("path"),
        F.when(second, "nomask").otherwise("mask").alias("status"),
    )
    hname = F.concat(F.lit("h-000"), F.col("o_orderkey"), F.lit("_mask_000.png"))
    b = V.table(spark, d, "orders").where("o_orderkey % 5 = 0").select(
        hname.alias("name"), F.concat(F.lit("crop/"), hname).alias("path"), F.lit("mask").alias("status")
    )
    return a.unionByName(b).distinct()


@query(
    "asset_resolution",
    f"""WITH {ASSETS_SQL}, c AS (SELECT o_orderkey AS id, unnest([0,1,2]) AS prio,
     unnest([concat('000',o_orderkey,'_mask_000.png'), concat('h-000',o_orderkey,'_mask_000.png'), concat('000',o_orderkey,'_nomask.done')]) AS name FROM orders),
    h AS (SELECT c.id, path, status, row_number() OVER (PARTITION BY c.id ORDER BY prio) AS rn FROM c JOIN assets USING (name))
    SELECT o_orderkey AS id, coalesce(path,'') AS path, coalesce(status,'missing') AS mask_status FROM orders LEFT JOIN (SELECT * FROM h WHERE rn=1) h ON h.id=o_orderkey""",
)
def _(spark, d):
    ids = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    s = F.concat(F.lit("000"), F.col("id"))
    cands = [(0, F.concat(s, F.lit("_mask_000.png"))), (1, F.concat(F.lit("h-"), s, F.lit("_mask_000.png"))), (2, F.concat(s, F.lit("_nomask.done")))]
    return J.resolve_assets(ids, _assets(spark, d), cands, "id")


@query(
    "alias_index",
    """WITH n AS (SELECT DISTINCT concat('u', user_id, CASE WHEN event_type='click' AND user_id%4=0 THEN '.png' ELSE '.jpeg' END) AS name FROM events),
    p AS (SELECT name, concat('img/',name) AS path, regexp_replace(name,'\\.[^.]+$','') AS st FROM n),
    u AS (SELECT st, min(path) AS path FROM p GROUP BY st HAVING count(*)=1),
    a AS (SELECT concat(st,e) AS name, path FROM u, (SELECT unnest(['.jpg','.jpeg','.png','.bmp','.webp','.tif','.tiff']) AS e))
    SELECT name, path FROM p UNION ALL SELECT name, path FROM a WHERE name NOT IN (SELECT name FROM p)""",
)
def _(spark, d):
    ev = V.table(spark, d, "events")
    ext = F.when((F.col("event_type") == "click") & (F.col("user_id") % 4 == 0), ".png").otherwise(".jpeg")
    names = ev.select(F.concat(F.lit("u"), "user_id", ext).alias("name")).distinct()
    return J.alias_index(names.withColumn("path", F.concat(F.lit("img/"), "name")))


@query(
    "mask_index",
    f"""WITH {ASSETS_SQL}, ids AS (SELECT concat('000', o_orderkey, '.jpg') AS id FROM orders)
    SELECT i.id, a.path AS mask_path, a.path IS NOT NULL AS masked FROM ids i LEFT JOIN assets a ON a.name = concat(left(i.id, length(i.id)-4), '_mask_000.png')""",
)
def _(spark, d):
    ids = V.table(spark, d, "orders").select(F.concat(F.lit("000"), "o_orderkey", F.lit(".jpg")).alias("id"))
    return J.mask_index(ids, _assets(spark, d))


MASKS_SQL = "masks AS (SELECT l_orderkey AS stem, l_linenumber AS mask_no FROM lineitem WHERE l_returnflag<>'R'), markers AS (SELECT DISTINCT l_orderkey AS stem FROM lineitem WHERE l_returnflag='R')"


def _masks(spark, d):
    li = V.table(spark, d, "lineitem")
    masks = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("stem"), F.col("l_linenumber").alias("mask_no"))
    markers = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("stem"))
    return masks, markers, V.table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"))


@query(
    "mask_fanout",
    f"""WITH {MASKS_SQL}, c AS (SELECT stem, count(*) AS n FROM masks GROUP BY 1)
    SELECT o_orderkey AS stem, coalesce(n,0) AS mask_count, coalesce(n,0)=0 AS nomask, coalesce(n,0)=0 AND m.stem IS NULL AS missing_marker
    FROM orders LEFT JOIN c ON c.stem=o_orderkey LEFT JOIN markers m ON m.stem=o_orderkey""",
)
def _(spark, d):
    masks, markers, ids = _masks(spark, d)
    return J.mask_fanout(ids, masks, markers)


@query(
    "instances_or_originals",
    f"""WITH {MASKS_SQL} SELECT stem, mask_no, 'mask' AS kind FROM masks WHERE stem IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT o_orderkey, NULL, 'original' FROM orders WHERE o_orderkey NOT IN (SELECT stem FROM masks)""",
)
def _(spark, d):
    masks, _, ids = _masks(spark, d)
    return J.instances_or_originals(ids, masks)


@query(
    "force_zero_listed",
    f"""{with_views('scored')}, z AS (SELECT DISTINCT user_id*3 AS n FROM events)
    SELECT printf('%06d.jpg', s.id) AS id, CASE WHEN z.n IS NOT NULL THEN 0 ELSE label END AS label, z.n IS NOT NULL AS zeroed FROM scored s LEFT JOIN z ON z.n=s.id""",
)
def _(spark, d):
    df = V.scored(spark, d).select(F.format_string("%06d.jpg", "id").alias("id"), "label")
    nums = V.table(spark, d, "events").select((F.col("user_id") * 3).alias("number"))
    return J.force_zero(df, nums).select("id", "label", "zeroed")


@query(
    "vector_interpolation",
    """WITH b AS (SELECT vec_id*2 AS k, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id AS key, list_transform(CASE WHEN v IS NULL THEN a ELSE list_transform(list_zip(a,v), lambda p: p[1]*0.7e0+p[2]*0.3e0) END, lambda x: round(x,6)) AS vals
    FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) LEFT JOIN b ON b.k=vec_id""",
)
def _(spark, d):
    e = V.manifest(spark, d)
    a = e.select(F.col("sample_id").alias("key"), F.col("embedding").alias("values"))
    b = e.select((F.col("sample_id") * 2).alias("key"), F.col("embedding").alias("values"))
    return J.interpolate_vectors(a, b, 0.3).select("key", round_half_up(F.col("values"), 6).alias("vals"))


@query(
    "feature_concat",
    """SELECT a.vec_id AS sample_id, len(list_concat(a.embedding, b.embedding))::INT AS dims, round(list_sum(list_transform(list_concat(a.embedding,b.embedding), lambda x: x::DOUBLE)),6) AS total
    FROM embeddings a JOIN embeddings b ON b.vec_id+1=a.vec_id""",
)
def _(spark, d):
    e = V.manifest(spark, d).select("sample_id", "embedding")
    out = J.concat_features([e, e.withColumn("sample_id", F.col("sample_id") + 1)])
    return out.select(
        "sample_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total")
    )


@query(
    "provenance_union",
    f"""{with_views('scored')} SELECT doc_id AS id, quality AS label, 'train' AS source, 1e0 AS sample_weight FROM labels
    UNION ALL SELECT id, (prob_pos>=0.5)::INT, 'pseudo', 0.5e0 FROM scored WHERE CASE WHEN prob_pos>=0.5 THEN prob_pos ELSE 1-prob_pos END>=0.95""",
)
def _(spark, d):
    from sievecrest.operators.filters import pseudo_labels

    base = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    sc = V.scored(spark, d).select("id", F.col("prob_pos").alias("prob_pos_corrected"))
    pseudo = pseudo_labels(sc, 0.95).select("id", "label")
    return J.merge_with_weights({"train": (base, 1.0), "pseudo": (pseudo, 0.5)})


@query(
    "id_set_difference",
    """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag='A'), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag='R')
    SELECT (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS only_b,
    (SELECT count(*) FROM a JOIN b USING (id)) AS both""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    return J.id_set_diff(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"))


# ---- pooling and ensembles ------------------------------------------------------------------


@query(
    "instance_pooling",
    """WITH i AS (SELECT l_orderkey AS id, l_discount*10 AS prob FROM lineitem)
    SELECT o_orderkey AS id, round(coalesce(p,0e0),6) AS prob_pos, coalesce(n,0) AS instances FROM orders LEFT JOIN (SELECT id, avg(prob) AS p, count(*) AS n FROM i GROUP BY 1) ON id=o_orderkey""",
)
def _(spark, d):
    inst = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 10).alias("prob"))
    out = P.pool_instances(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), inst)
    return out.withColumn("prob_pos", F.round("prob_pos", 6))


@query("model_mean", f"{LONG} SELECT id, round(avg(prob),6) AS prob_pos, count(*) AS n_views FROM scored_long GROUP BY id")
def _(spark, d):
    return P.mean_over(V.scored_long(spark, d), ["id"]).withColumn("prob_pos", F.round("prob_pos", 6))


@query(
    "vector_pooling",
    """WITH f AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding,1) AS p FROM embeddings),
    m AS (SELECT label, p, round(avg(x),6) AS m FROM f GROUP BY ALL) SELECT label, list(m ORDER BY p) AS vec FROM m GROUP BY label""",
)
def _(spark, d):
    out = P.pool_vectors(V.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec")), "label", "vec")
    return out.select("label", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query(
    "bagged_predictions",
    f"""{LONG}, s AS (SELECT * FROM scored_long WHERE NOT (id%31=0 AND model='m2'))
    SELECT id, round(avg(prob),6) AS prob_pos_corrected, (round(avg(prob),9)>=0.5)::INT AS label, count(*)=5 AS complete FROM s GROUP BY id""",
)
def _(spark, d):
    df = V.scored_long(spark, d).where(~((F.col("id") % 31 == 0) & (F.col("model") == "m2")))
    out = P.bag_probabilities(df, 5)
    return out.withColumn("prob_pos_corrected", F.round("prob_pos_corrected", 6))


@query(
    "vote_probability_audit",
    f"""{LONG} SELECT id, round(avg(prob),6) AS prob_mean, round(max(prob),6) AS prob_max, sum((prob>=0.5)::INT)::BIGINT AS label_votes_pos, count(*) AS label_votes_total FROM scored_long GROUP BY id""",
)
def _(spark, d):
    df = V.scored_long(spark, d).withColumn("label", (F.col("prob") >= 0.5).cast("int"))
    out = P.vote_audit(df)
    return out.withColumn("prob_mean", F.round("prob_mean", 6)).withColumn("prob_max", F.round("prob_max", 6))


@query(
    "model_combinations",
    f"""{LONG}, m AS (SELECT DISTINCT model AS m FROM scored_long),
    c2 AS (SELECT a.m AS x, b.m AS y FROM m a JOIN m b ON a.m<b.m), c3 AS (SELECT x,y,b.m AS z FROM c2 JOIN m b ON y<b.m), c4 AS (SELECT x,y,z,b.m AS w FROM c3 JOIN m b ON z<b.m),
    c5 AS (SELECT x,y,z,w,b.m AS v FROM c4 JOIN m b ON w<b.m)
    SELECT x||' + '||y AS ensemble, 2 AS n_models FROM c2 UNION ALL SELECT x||' + '||y||' + '||z, 3 FROM c3 UNION ALL SELECT x||' + '||y||' + '||z||' + '||w, 4 FROM c4
    UNION ALL SELECT x||' + '||y||' + '||z||' + '||w||' + '||v, 5 FROM c5""",
)
def _(spark, d):
    return P.combination_table(V.scored_long(spark, d).select("model").distinct()).select("ensemble", "n_models")


@query(
    "ensemble_search",
    f"""{LONG}, m AS (SELECT DISTINCT model AS m FROM scored_long),
    c2 AS (SELECT a.m AS x, b.m AS y FROM m a JOIN m b ON a.m<b.m), c3 AS (SELECT x,y,b.m AS z FROM c2 JOIN m b ON y<b.m), c4 AS (SELECT x,y,z,b.m AS w FROM c3 JOIN m b ON z<b.m), c5 AS (SELECT x,y,z,w,b.m AS v FROM c4 JOIN m b ON w<b.m),
    cc AS (SELECT x||' + '||y AS ensemble, 2 AS n_models, [x,y] AS mem FROM c2 UNION ALL SELECT x||' + '||y||' + '||z, 3, [x,y,z] FROM c3
      UNION ALL SELECT x||' + '||y||' + '||z||' + '||w, 4, [x,y,z,w] FROM c4 UNION ALL SELECT x||' + '||y||' + '||z||' + '||w||' + '||v, 5, [x,y,z,w,v] FROM c5),
    pr AS (SELECT id, max(label) AS label, max(grp%2) AS dataset, map_from_entries(list((model, prob) ORDER BY model)) AS p FROM scored_long GROUP BY id),
    e AS (SELECT dataset::VARCHAR||'|'||ensemble AS k, dataset, ensemble, n_models, label, (p[mem[1]]+p[mem[2]]+CASE WHEN n_models>2 THEN p[mem[3]] ELSE 0e0 END+CASE WHEN n_models>3 THEN p[mem[4]] ELSE 0e0 END+CASE WHEN n_models>4 THEN p[mem[5]] ELSE 0e0 END)/n_models AS prob_pos FROM pr, cc),
    cells AS (SELECT k, prob_pos AS score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM e GROUP BY ALL),
    cand AS (SELECT k, score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM cells UNION ALL SELECT k, t, 0, 0 FROM (SELECT DISTINCT k FROM cells),(VALUES (0e0),(0.5e0),(1e0)) c(t)) GROUP BY ALL),
    cums AS (SELECT k, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY k)-sum(pos) OVER w AS fn FROM cand WINDOW w AS (PARTITION BY k ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    sw AS (SELECT k, max(CASE WHEN tp=0 THEN 0e0 ELSE 2e0*(tp::DOUBLE/greatest(1,tp+fp))*(tp::DOUBLE/greatest(1,tp+fn))/(tp::DOUBLE/greatest(1,tp+fp)+tp::DOUBLE/greatest(1,tp+fn)) END) AS best_f1 FROM cums GROUP BY k),
    c AS (SELECT k, min(dataset) AS dataset, min(ensemble) AS ensemble, min(n_models) AS n_models, avg(prob_pos) AS pm, count(*) FILTER (prob_pos>=0.5 AND label=1) AS tp, count(*) FILTER (prob_pos>=0.5 AND label=0) AS fp, count(*) FILTER (prob_pos<0.5 AND label=1) AS fn FROM e GROUP BY k)
    SELECT dataset, ensemble, n_models::INT AS n_models, round(pm,6) AS prob_mean, round(CASE WHEN tp=0 THEN 0e0 ELSE 2e0*(tp::DOUBLE/greatest(1,tp+fp))*(tp::DOUBLE/greatest(1,tp+fn))/(tp::DOUBLE/greatest(1,tp+fp)+tp::DOUBLE/greatest(1,tp+fn)) END,6) AS f1_at_0_5,
    round(best_f1,6) AS best_f1 FROM c JOIN sw USING (k)""",
)
def _(spark, d):
    df = V.scored_long(spark, d).withColumn("dataset", F.col("grp") % 2)
    out = P.ensemble_search(df, "dataset", "id", "label")
    return out.select(
        "dataset", "ensemble", "n_models", *[F.round(c, 6).alias(c) for c in ("prob_mean", "f1_at_0_5", "best_f1")]
    )


@query(
    "top_runs_per_dataset",
    f"""{LONG}, r AS (SELECT model, grp%3 AS dataset, round(avg(prob),6) AS metric FROM scored_long GROUP BY ALL)
    SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY metric DESC, model) AS rn FROM r) WHERE rn<=2""",
)
def _(spark, d):
    from sievecrest.operators.ordering import top_per_group

    runs = V.scored_long(spark, d).groupBy("model", (F.col("grp") % 3).alias("dataset")).agg(F.round(F.avg("prob"), 6).alias("metric"))
    return top_per_group(runs, ["dataset"], [F.desc("metric"), F.asc("model")], 2, "model").drop("rank")


@query(
    "value_counts",
    """SELECT source, lang, count(*) AS n, count(DISTINCT quality) AS labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def _(spark, d):
    df = V.table(spark, d, "documents").select("doc_id", "source", "lang").join(V.table(spark, d, "labels"), "doc_id", "left")
    return df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("quality").alias("labels"))


@query(
    "calibrated_ladder",
    f"""{with_views('scored','baseline','predictions')}, g AS (SELECT i, CASE WHEN i=499 THEN 0.95e0 ELSE i*'{(0.95-1e-4)/499!r}'::DOUBLE+1e-4 END AS t FROM range(0,500) r(i)),
    cells AS (SELECT prob_pos AS s, count(*) AS n FROM predictions GROUP BY 1), cnt AS (SELECT i, t, sum(CASE WHEN s>=t THEN n ELSE 0 END) AS pos FROM cells, g GROUP BY ALL),
    tg AS (SELECT unnest([500,2000,4000])::BIGINT AS target), th AS (SELECT target, t FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(pos-target), i) AS rn FROM cnt, tg) WHERE rn=1),
    f AS (SELECT target, b.label AS b, coalesce((prob_pos>=t)::INT, b.label) AS c, prob_pos IS NULL AS filled FROM baseline b CROSS JOIN th LEFT JOIN predictions p ON p.id=b.id)
    SELECT target, count(*) FILTER (c=1) AS positives, count(*) FILTER (filled) AS filled, count(*) FILTER (b<>c) AS diff_vs_baseline,
    count(*) FILTER (b=1 AND c=0) AS baseline_pos_to_neg, count(*) FILTER (b=0 AND c=1) AS baseline_neg_to_pos FROM f GROUP BY target""",
)
def _(spark, d):
    from sievecrest.plans.ladders import calibrated_ladder

    return calibrated_ladder(V.baseline(spark, d), V.predictions(spark, d), [500, 2000, 4000])


