"""Clusters, probes, decision tables and multi-step plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.catalog.key_queries import FEAT, RANKS_SQL, TIER_SQL, _feat
from sievecrest.catalog.neighbour_queries import RISK_EDGES, rnd, risk_edges
from sievecrest.functions import risk as R
from sievecrest.operators import clusters as C
from sievecrest.operators import joins as J
from sievecrest.operators import neighbours as N
from sievecrest.operators import probes as PB
from sievecrest.operators.filters import matched_rules
from sievecrest.operators.ordering import global_row_number
from sievecrest.plans import audits as A
from sievecrest.plans import ladders as LD
from sievecrest.plans import protocol as PR
from sievecrest.plans import validation as VL
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views
from sievecrest.session import cut_lineage

MAN = with_views("manifest")


@query(
    "standardised_vectors",
    f"""{MAN}, f AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding,1) AS p FROM manifest WHERE source='train'), m AS (SELECT list(mu ORDER BY p) AS mu, list(sd ORDER BY p) AS sd FROM (SELECT p, avg(x) AS mu, stddev_pop(x) AS sd FROM f GROUP BY p))
    SELECT sample_id, list_transform(embedding, lambda x, i: round((x-mu[i])/sd[i],6)) AS z FROM manifest, m""",
)
def _(spark, d):
    m = V.manifest(spark, d)
    out = C.standardise(m, m.where("source = 'train'"))
    return out.select("sample_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("z"))


@query(
    "cluster_summary",
    f"""{MAN} SELECT grp AS cluster, count(*) AS total, count(*) FILTER (source='test') AS test_count, count(*) FILTER (source='train') AS train_count, count(*) FILTER (source='myval') AS myval_count, count(*) FILTER (source='extra') AS extra_count,
    count(*) FILTER (label=1) AS pos_count, count(*) FILTER (label=0) AS neg_count, round(avg(embedding[1]),6) AS mean_topk, round(count(*) FILTER (source='test')/count(*)::DOUBLE,6) AS test_fraction FROM manifest GROUP BY grp""",
)
def _(spark, d):
    m = V.manifest(spark, d).withColumn("cluster", F.col("grp")).withColumn("topk_mean", F.col("embedding")[0])
    return rnd(C.cluster_summary(m, ["test", "train", "myval", "extra"]))


@query(
    "cluster_label_stats",
    f"""WITH c AS (SELECT CASE WHEN doc_id%5=0 THEN -1 ELSE (doc_id%23)::INT END AS k FROM documents), s AS (SELECT k, count(*) AS n FROM c GROUP BY 1)
    SELECT sum(n)::BIGINT AS n_samples, count(*) FILTER (k<>-1) AS n_clusters, coalesce(sum(n) FILTER (k=-1),0)::BIGINT AS n_noise, max(n) FILTER (k<>-1) AS largest, round(coalesce(sum(n) FILTER (k=-1),0)/sum(n),6) AS noise_ratio FROM s""",
)
def _(spark, d):
    k = F.when(F.col("doc_id") % 5 == 0, -1).otherwise((F.col("doc_id") % 23).cast("int"))
    return rnd(C.cluster_label_stats(V.table(spark, d, "documents").select(k.alias("cluster"))))


@query(
    "pca_neighbours",
    f"""{MAN}, n AS (SELECT count(*) FILTER (source='test') AS q, count(*) FILTER (source='train') AS r FROM manifest)
    SELECT (q*least(r,5))::BIGINT AS edges, q AS queries, 0::BIGINT AS out_of_order, true AS variance_kept, true AS uncorrelated FROM n""",
)
def _(spark, d):
    """Edges of the projected space, and what PCA promises: uncorrelated axes that keep most of the variance 16 axes can."""
    m = V.manifest(spark, d)
    z = C.standardise(m, m.where("source = 'train'"))
    p = C.project(z, z.where("source = 'train'"), 16)
    edges = N.cosine_knn(p.where("source = 'test'"), p.where("source = 'train'"), 5)
    train = p.where("source = 'train'").select(*[F.col("embedding")[i].alias(f"x{i}") for i in range(16)])
    variances = [F.var_pop(f"x{i}") for i in range(16)]
    falling = F.lit(True)
    for a, b in zip(variances, variances[1:]):
        falling = falling & (a >= b - 1e-9)
    apart = F.abs(F.covar_pop("x0", "x1")) + F.abs(F.covar_pop("x0", "x7")) + F.abs(F.covar_pop("x3", "x12")) < 1e-6
    whole = z.where("source = 'train'").select(*[F.var_pop(F.col("embedding")[i]).alias(f"v{i}") for i in range(64)])
    total = whole.select(sum(F.col(f"v{i}") for i in range(64)).alias("t")).scalar()
    facts = train.agg((falling & (sum(variances) >= total * 16 / 64)).alias("variance_kept"), apart.alias("uncorrelated"))
    per = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rank") < 1, 1).otherwise(0)).alias("low"),
                                        (F.max_by("cosine_sim", "rank") > F.max_by("cosine_sim", -F.col("rank"))).cast("int").alias("bad"))
    counts = per.agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("queries"), F.sum(F.col("low") + F.col("bad")).alias("out_of_order"))
    return counts.crossJoin(facts)


@query("kmeans_clusters", f"{MAN} SELECT count(*) AS rows, 0::BIGINT AS not_at_nearest, true AS within_k, true AS less_spread FROM manifest")
def _(spark, d):
    """Every row is in the cluster of its nearest centre, and clusters are tighter than the whole."""
    m = V.manifest(spark, d).select("sample_id", "source", F.col("embedding").cast("array<double>").alias("embedding"))
    got = cut_lineage(C.kmeans_labels(m, m, 12, seeds=(42, 43)).select("sample_id", "cluster", "embedding"))
    axes = got.select("cluster", F.posexplode("embedding").alias("p", "x"))
    centres = axes.groupBy("cluster", "p").agg(F.avg("x").alias("c")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("c"))
    packed = centres.agg(F.collect_list(F.struct("cluster", F.transform("c", lambda s: s["c"]).alias("c")))).scalar()
    near = F.transform(
        "_c", lambda k: F.struct(F.aggregate(F.zip_with(k["c"], F.col("embedding"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("dist"), k["cluster"].alias("cluster"))
    )
    placed = got.withColumn("_c", packed).select("cluster", near.alias("near"))
    own = F.filter("near", lambda k: k["cluster"] == F.col("cluster"))[0]["dist"]
    out = placed.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(own > F.array_min("near")["dist"] + 0.05).alias("not_at_nearest"),
        (F.count_distinct("cluster") <= 12).alias("within_k"), F.sum(own).alias("inside"),
    )
    spread = axes.groupBy("p").agg(F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("v") * F.col("n"))).scalar()
    return out.select("rows", "not_at_nearest", "within_k", (F.col("inside") < spread).alias("less_spread"))


SETS = """pool AS (SELECT * FROM manifest WHERE source IN ('train','myval') AND label IS NOT NULL), n AS (SELECT count(*) AS pool, least(count(*),60) AS few FROM pool)"""


def _validation(spark, d):
    sources = ["train", "myval", "test", "extra"]
    scored = VL.test_like_scores(V.manifest(spark, d), sources, sources, components=16, clusters=12)
    return scored, VL.validation_sets(scored, ["train", "myval"], 60)


@query(
    "test_like_validation_sets",
    f"""{MAN}, {SETS} SELECT kind, CASE WHEN kind='weighted' THEN pool ELSE few END AS rows, CASE WHEN kind='weighted' THEN pool ELSE few END AS ids, true AS best_of_label, true AS weights_in_range
    FROM n, (VALUES ('top'),('cluster'),('weighted')) k(kind)""",
)
def _(spark, d):
    """Sizes of the sets, their ids, weights within 0 and 1, and that no better row of a label was left out of ``top``."""
    scored, sets = _validation(spark, d)
    sets = cut_lineage(sets.select("kind", "sample_id", "label", "test_like_score", "sample_weight"))
    worst = sets.where("kind = 'top'").groupBy("label").agg(F.min("test_like_score").alias("worst"))
    pool = sets.where("kind = 'weighted'").join(sets.where("kind = 'top'").select("sample_id"), "sample_id", "left_anti")
    better = pool.join(worst, "label").where(F.col("test_like_score") > F.col("worst") + 1e-12).agg(F.count(F.lit(1))).scalar()
    out = sets.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("ids"),
        F.coalesce(F.min(F.col("sample_weight").between(0, 1)), F.lit(True)).alias("weights_in_range"),
    )
    return out.withColumn("best_of_label", better == 0)


@query(
    "validation_build_summary",
    f"""{MAN}, {SETS}, f AS (SELECT count(*) AS feature_rows, count(*) FILTER (source='test') AS anchor_rows FROM manifest)
    SELECT feature_rows, anchor_rows, few AS top_rows, few AS cluster_rows, pool AS weighted_rows, true AS clusters_within_k, true AS json_agrees FROM f, n""",
)
def _(spark, d):
    scored, sets = _validation(spark, d)
    out = VL.build_summary(scored, sets)
    size = {k: F.col("set_rows")[k].alias(f"{k}_rows") for k in ("top", "cluster", "weighted")}
    agrees = F.get_json_object("summary", "$.set_rows.top").cast("long") == F.col("set_rows")["top"]
    return out.select("feature_rows", "anchor_rows", *size.values(), (F.col("clusters") <= 12).alias("clusters_within_k"), agrees.alias("json_agrees"))


@query(
    "logistic_probe_sweep",
    f"""{MAN} SELECT source, c AS "C", count(*) AS n, count(*) FILTER (label=1) AS positives, true AS in_range, CASE WHEN source='train' THEN true END AS below_prior_loss
    FROM manifest, (VALUES (0.1e0),(1e0)) v(c) WHERE source IN ('train','myval','extra') AND label IS NOT NULL GROUP BY source, c""",
)
def _(spark, d):
    """Every labelled row is scored, and on its training rows a probe's balanced loss is below that of no features."""
    m = V.manifest(spark, d).where("label IS NOT NULL")
    out = PB.logistic_probe(m.where("source = 'train'"), m.where("source IN ('train', 'myval', 'extra')"), [0.1, 1.0])
    y, p = F.col("label"), F.col("prob_pos")
    loss = (F.avg(F.when(y == 1, -F.log(p))) + F.avg(F.when(y == 0, -F.log(1 - p)))) / 2
    return out.groupBy("source", "C").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("positives"), F.min((p > 0) & (p < 1)).alias("in_range"),
        F.when(F.col("source") == "train", loss < F.log(F.lit(2.0))).alias("below_prior_loss"),
    )


@query(
    "logistic_probe_shares",
    """SELECT user_id%4 AS part, c AS "C", count(*) AS n, round(avg((value>=5)::INT),3) AS prob_pos FROM events, (VALUES (1e5),(1e6)) v(c) GROUP BY ALL""",
)
def _(spark, d):
    """With one column a group and hardly a penalty, a probe's probability is the group's share of positives."""
    ev = V.table(spark, d, "events").select((F.col("user_id") % 4).alias("part"), (F.col("value") >= 5).cast("int").alias("label"))
    ev = ev.withColumn("embedding", F.array(*[(F.col("part") == i).cast("double") for i in range(4)]))
    out = PB.logistic_probe(ev, ev, [1e5, 1e6], balanced=False)
    return out.groupBy("part", "C").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob_pos"), 3).alias("prob_pos"))


def _planted(spark, d):
    """The manifest with a label that a linear cut of the vector decides."""
    side = F.col("embedding")[0] + F.col("embedding")[1] > 0
    return V.manifest(spark, d).where("label IS NOT NULL").withColumn("label", side.cast("int"))


PLANTED = f"{MAN}, pl AS (SELECT source, (embedding[1]+embedding[2]>0)::INT AS label FROM manifest WHERE label IS NOT NULL)"


@query("perceptron_probe", f"{PLANTED} SELECT source, count(*) AS n, count(*) FILTER (label=1) AS positives, true AS learned FROM pl WHERE source IN ('train','myval','extra') GROUP BY source")
def _(spark, d):
    m = _planted(spark, d)
    out = PB.mlp_probe(m.where("source = 'train'"), m.where("source IN ('train', 'myval', 'extra')"))
    hit = ((F.col("prob_pos") >= 0.5).cast("int") == F.col("label")).cast("double")
    least = F.when(F.col("source") == "train", 0.95).otherwise(0.65)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"), (F.avg(hit) >= least).alias("learned"))


@query(
    "perceptron_sweep",
    f"""{PLANTED}, g AS (SELECT * FROM (VALUES ('8'),('16')) h(hidden), (VALUES (20),(60)) i(iterations), (VALUES (NULL),(0.03e0)) s(step_size)), p AS (SELECT avg(label) AS share FROM pl WHERE source='myval')
    SELECT hidden, iterations::INT AS iterations, step_size::DOUBLE AS step_size, 42::INT AS seed, true AS above_all_positive FROM g, p""",
)
def _(spark, d):
    """All settings; the best threshold is never worse than calling every row positive."""
    m = _planted(spark, d)
    val = m.where("source = 'myval'")
    out = PB.mlp_sweep(m.where("source = 'train'"), val, [(8,), (16,)], (20, 60), (None, 0.03), (42,))
    share = val.agg(F.avg("label")).scalar()
    above = (F.col("best_f1") >= 2 * share / (1 + share) - 1e-9) & (F.col("best_f1") >= F.col("f1_at_half"))
    return out.select("hidden", "iterations", "step_size", "seed", above.alias("above_all_positive"))


@query(
    "stacking_features",
    f"""{with_views('scored')}, m AS (SELECT id, least(greatest(prob_pos,1e-7),1-1e-7) AS a, least(greatest(((id*7921+13)%1001)/1001e0,1e-7),1-1e-7) AS b FROM scored),
    c AS (SELECT id, 1/(1+exp(-ln(a/(1-a))/1.5e0)) AS a, 1/(1+exp(-ln(b/(1-b))/0.8e0)) AS b FROM m)
    SELECT id, round(a,6) AS a, round(b,6) AS b, round(a*b,6) AS ab, round(abs(a-b),6) AS gap, round((a+b)/2,6) AS mid, round(CASE WHEN a>0.5 THEN a ELSE 0e0 END,6) AS pos FROM c""",
)
def _(spark, d):
    b = (F.col("id") * 7921 + 13) % 1001 / F.lit(1001.0)
    f = PB.stacking_features(PB.temperature_calibrated(F.col("prob_pos"), 1.5), PB.temperature_calibrated(b, 0.8))
    df = V.scored(spark, d).select("id", f.alias("f"))
    return df.select("id", *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(("a", "b", "ab", "gap", "mid", "pos"))])


@query(
    "stacked_models",
    f"""{with_views('scored')} SELECT id%2 AS part, count(*) AS n, count(*) FILTER (label=1) AS positives, true AS in_range, true AS below_prior_loss FROM scored GROUP BY 1""",
)
def _(spark, d):
    """Both halves are scored, and the stacker's balanced loss is below that of no features on the half it learned from."""
    b = (F.col("id") * 7921 + 13) % 1001 / F.lit(1001.0)
    df = V.scored(spark, d).withColumn("b", b)
    val, test = PB.stack_models(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "prob_pos", "b", "label", 1.2, 0.9)
    y, p = F.col("label"), F.col("prob_pos")
    loss = (F.avg(F.when(y == 1, -F.log(p))) + F.avg(F.when(y == 0, -F.log(1 - p)))) / 2
    both = val.unionByName(test).groupBy((F.col("id") % 2).alias("part"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("positives"), F.min((p > 0) & (p < 1)).alias("in_range"),
        (F.first(F.col("id") % 2 == 1) | (loss <= F.log(F.lit(2.0)) + 1e-9)).alias("below_prior_loss"),
    )


@query(
    "batch_linear_scores",
    "SELECT vec_id AS sample_id, round(1/(1+exp(-(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x*(i%5-2)))+0.1e0))),6) AS prob_pos FROM embeddings",
)
def _(spark, d):
    model = PB.linear_model([float((i + 1) % 5 - 2) for i in range(64)], 0.1)
    return PB.batch_score(V.manifest(spark, d), model).select("sample_id", F.round("prob_pos", 6).alias("prob_pos"))


# ---- decision tables ----------------------------------------------------------------------

EV = f"""{RISK_EDGES}, ev AS (SELECT query_id AS id, avg((ref_label=1)::INT) FILTER (rank<=5) AS t5, avg((ref_label=1)::INT) FILTER (rank<=10) AS t10,
   avg((ref_label=1)::INT) FILTER (rank<=10 AND ref_source='train') AS tr, avg((ref_label=1)::INT) FILTER (rank<=10 AND ref_source='myval') AS mv, avg((ref_label=1)::INT) FILTER (rank<=10 AND ref_source='extra') AS ex FROM edges GROUP BY 1),
  aux AS (SELECT id, ((id*7919+13)%1001)/1001e0 AS prob, CASE WHEN id%5=0 THEN 0 ELSE 1 END AS cur, (id%2)::INT AS sec FROM ev),
  rs AS (SELECT id, t5, t10, tr, prob, cur, sec, round((0.30e0*(1-coalesce(t5,t10,0.5e0))+0.25e0*(1-coalesce(tr,t10,0.5e0))+0.15e0*(1-coalesce(mv,t10,0.5e0))+0.10e0*(1-coalesce(ex,0.5e0))+0.10e0*(1-2*abs(prob-0.5e0))+0.10e0*(sec=0)::INT)*(CASE WHEN cur=0 THEN 0.25e0 ELSE 1e0 END),9) AS risk FROM ev JOIN aux USING (id)),
  risk AS (SELECT *, row_number() OVER (ORDER BY risk DESC, id) AS rk FROM rs)"""


def _risk(spark, d):
    e = risk_edges(spark, d)
    ev = N.neighbour_evidence(e, ["train", "myval", "extra"])
    ids = V.manifest(spark, d).where("source = 'test'").select(F.col("sample_id").alias("id"))
    i = F.col("id")
    probs = ids.withColumn("prob_pos", (i * 7919 + 13) % 1001 / F.lit(1001.0))
    current = ids.withColumn("label", F.when(i % 5 == 0, 0).otherwise(1))
    return A.risk_table(ev, probs, current, ids.withColumn("label", (i % 2).cast("int"))), current


@query("risk_table", f"{EV} SELECT id, round(risk,6) AS fp_risk_score, rk AS fp_risk_rank FROM risk")
def _(spark, d):
    return rnd(_risk(spark, d)[0].select("id", "fp_risk_score", "fp_risk_rank"))


VER = f"""{EV}, vf0 AS (SELECT *, ((id%5)::INT) AS pv, CASE WHEN id%5<=4 THEN (id%5)/4e0 END AS alt, CASE WHEN id%16=6 THEN 'inferred_fp' WHEN id%16=14 THEN 'one_of_three_fp' ELSE '' END AS weak FROM risk WHERE cur=1),
  vf AS (SELECT *, round(0.35e0*risk+0.25e0*(1-coalesce(t5,0.5e0))+0.20e0*(1-coalesce(tr,t10,0.5e0))+0.10e0*(1-coalesce(alt,0.5e0))+0.10e0*(1-2*abs(prob-0.5e0)),9) AS ver FROM vf0),
  vr AS (SELECT *, row_number() OVER (ORDER BY ver DESC, risk DESC, id) AS vrank FROM vf)"""


def _verifier(spark, d):
    risk, current = _risk(spark, d)
    ids = current.select("id")
    i = F.col("id")
    like = ids.withColumn("test_like_score", F.lit(0.5))
    votes = ids.withColumn("pos_votes", i % 5).withColumn("model_count", F.lit(4)).withColumn("pos_frac", i % 5 / F.lit(4.0)).withColumn("neg_votes", 4 - i % 5)
    weak = ids.withColumn("weak_label", F.when(i % 16 == 6, "inferred_fp").when(i % 16 == 14, "one_of_three_fp")).where("weak_label IS NOT NULL")
    return A.verifier_features(risk, like, votes, weak), current


@query("verifier_features", f"{VER} SELECT id, weak AS weak_label, round(alt,6) AS alt_model_pos_frac, round(ver,6) AS verifier_fp_score, vrank AS verifier_rank FROM vr")
def _(spark, d):
    return rnd(_verifier(spark, d)[0].select("id", "weak_label", "alt_model_pos_frac", "verifier_fp_score", "verifier_rank"))


RULES_SQL = """hit AS (SELECT 'every_third_id' AS rule, * FROM vr WHERE id%3=0 UNION ALL SELECT 'riskiest_ten', * FROM vr WHERE rk<=10
   UNION ALL SELECT 'neighbours_mostly_negative', * FROM vr WHERE t5<=0.4 UNION ALL SELECT 'models_and_second_doubt', * FROM vr WHERE alt<=0.5 AND sec=0
   UNION ALL SELECT 'never', * FROM vr WHERE prob>2),
  names AS (SELECT unnest(['every_third_id','riskiest_ten','neighbours_mostly_negative','models_and_second_doubt','never']) AS rule)"""


def _rules():
    return {
        "every_third_id": F.col("id") % 3 == 0,
        "riskiest_ten": F.col("fp_risk_rank") <= 10,
        "neighbours_mostly_negative": F.col("top5_pos_frac") <= 0.4,
        "models_and_second_doubt": (F.col("alt_model_pos_frac") <= 0.5) & (F.col("second_label") == 0),
        "never": F.col("prob_pos") > 2,
    }


@query(
    "rule_summary",
    f"""{VER}, {RULES_SQL}, s AS (SELECT n.rule, count(h.id) AS n_selected, count(h.id) FILTER (weak='inferred_fp') AS inferred_hits, count(h.id) FILTER (weak='one_of_three_fp') AS open_hits,
    avg(risk) AS mr, avg(prob) AS mp, avg(alt) AS ma FROM names n LEFT JOIN hit h USING (rule) GROUP BY n.rule)
    SELECT rule, n_selected, inferred_hits, open_hits, round(mr,6) AS mean_fp_risk, round(mp,6) AS mean_prob, round(ma,6) AS mean_alt_pos_frac,
    (row_number() OVER (ORDER BY inferred_hits DESC, open_hits, n_selected, round(mr,9) NULLS LAST, rule))::INT AS place FROM s""",
)
def _(spark, d):
    feats, _ = _verifier(spark, d)
    known = {"inferred": feats.where("weak_label = 'inferred_fp'"), "open": feats.where("weak_label = 'one_of_three_fp'")}
    return rnd(A.rule_summary(feats, _rules(), known))


@query("rule_ids", f"{VER}, {RULES_SQL} SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY vrank) AS place, id FROM hit")
def _(spark, d):
    return A.rule_ids(_verifier(spark, d)[0], _rules())


@query(
    "rule_candidates",
    f"""{VER}, {RULES_SQL} SELECT n.rule, a.id, CASE WHEN h.id IS NOT NULL THEN 0 ELSE a.cur END AS label FROM names n CROSS JOIN aux a LEFT JOIN hit h ON h.rule=n.rule AND h.id=a.id""",
)
def _(spark, d):
    feats, current = _verifier(spark, d)
    rules = _rules()
    return LD.zeroed_candidates(current, matched_rules(feats, rules), list(rules))


@query(
    "tier_candidates",
    f"""{FEAT}, {RANKS_SQL}, t AS (SELECT id, label, {TIER_SQL} AS tier FROM cs), k AS (SELECT unnest(['A','A_B']) AS tiers)
    SELECT tiers, count(*) FILTER (label=1) AS before, count(*) FILTER (label=1 AND NOT (tier='A_lb_inferred' OR (tiers='A_B' AND tier='B_consensus_untested'))) AS after FROM t, k GROUP BY 1""",
)
def _(spark, d):
    df = _feat(spark, d)
    out = A.consensus_scores(df, "risk", "verifier", "top5", "train10", "top10", "alt", "prob_pos", digits=6)
    tiers = out.withColumn("tier", R.assign_tier(F.col("consensus"), F.col("weak"), F.col("top5"), F.col("alt")))
    a = F.when(F.col("tier") == "A_lb_inferred", F.array(F.lit("A"), F.lit("A_B"))).when(F.col("tier") == "B_consensus_untested", F.array(F.lit("A_B")))
    picked = tiers.select("id", F.explode(a).alias("tiers"))
    zeroed = LD.zeroed_candidates(df.select("id", "label"), picked, ["A", "A_B"], name="tiers")
    both = zeroed.join(df.select("id", F.col("label").alias("was")), "id")
    return both.groupBy("tiers").agg(F.count_if(F.col("was") == 1).alias("before"), F.count_if(F.col("label") == 1).alias("after"))


@query(
    "risk_ladder",
    f"""{EV}, l AS (SELECT id FROM aux WHERE id%11=0), p AS (SELECT id, row_number() OVER (ORDER BY rk) AS r FROM risk WHERE cur=1), s AS (SELECT unnest([5,10,15,20,25]) AS n)
    SELECT n, id FROM s, l UNION SELECT n, id FROM s, p WHERE r<=n""",
)
def _(spark, d):
    from pyspark.sql import Window

    risk, current = _risk(spark, d)
    top = risk.where("current_label = 1").select("id", "fp_risk_rank").orderBy("fp_risk_rank").limit(25)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("fp_risk_rank")))
    return LD.risk_ladder(current.where("id % 11 = 0"), ranked, [5, 10, 15, 20, 25])


def _view_sql(name: str, dims: str) -> str:
    """Positive share among the five nearest labelled rows by some of the dimensions."""
    return f"""{name} AS (SELECT id, avg((l=1)::INT) AS share FROM (SELECT q.sample_id AS id, r.label AS l, row_number() OVER (PARTITION BY q.sample_id
      ORDER BY round(list_cosine_similarity(q.embedding[{dims}], r.embedding[{dims}]),12) DESC, r.sample_id) AS rank
      FROM (SELECT * FROM manifest WHERE source='test') q, (SELECT * FROM manifest WHERE label IS NOT NULL) r) WHERE rank<=5 GROUP BY id)"""


@query(
    "embedding_agreement",
    f"""{VER}, {_view_sql("second", "1:32")}, {_view_sql("third", "33:64")}, a AS (SELECT vr.*, s.share AS s5, c.share AS c5 FROM vr LEFT JOIN second s USING (id) LEFT JOIN third c USING (id))
    SELECT id, round(((1-s5)+(1-coalesce(c5,0.5e0)))/2,6) AS two_way_negative, round(((1-coalesce(t5,0.5e0))+(1-s5)+(1-coalesce(c5,0.5e0)))/3,6) AS three_way_negative,
    coalesce(t5<=0.2 AND s5<=0.2 AND c5<=0.2,false) AS strong_negative, coalesce((s5>=0.6 AND t5<=0.2) OR (s5<=0.2 AND t5>=0.6),false) AS disagrees FROM a""",
)
def _(spark, d):
    feats, _ = _verifier(spark, d)
    m = V.manifest(spark, d)
    views = [m.withColumn("embedding", F.slice("embedding", start, 32)) for start in (1, 33)]
    second, third = (A.neighbour_shares(v.where("source = 'test'"), v.where("label IS NOT NULL")) for v in views)
    out = A.embedding_agreement(feats, second, third)
    return rnd(out.select("id", "two_way_negative", "three_way_negative", "strong_negative", "disagrees"))


LONG = with_views("scored", "scored_long")
RUNS = f"""{LONG}, e AS (SELECT model AS run, (grp%3) AS dataset, round(avg(((prob>=0.5)::INT=label)::INT),6) AS acc, round(avg(prob),6) AS prob_mean FROM scored_long GROUP BY ALL),
   kn AS (SELECT model AS run, round(avg(CASE WHEN label=1 THEN prob END),6) AS known_f1 FROM scored_long GROUP BY 1)"""


@query(
    "proxy_truth_report",
    f"""{RUNS}, j AS (SELECT dataset, run, unnest(['acc','prob_mean']) AS metric, unnest([acc, prob_mean]) AS m, known_f1 AS t FROM e JOIN kn USING (run)),
    r AS (SELECT *, rank() OVER (PARTITION BY dataset, metric ORDER BY m)+(count(*) OVER (PARTITION BY dataset, metric, m)-1)/2e0 AS rm, rank() OVER (PARTITION BY dataset, metric ORDER BY t)+(count(*) OVER (PARTITION BY dataset, metric, t)-1)/2e0 AS rt FROM j)
    SELECT dataset, metric, count(*) AS n, CASE WHEN count(*)>=3 THEN round(corr(rm,rt),6) END AS rank_corr FROM r GROUP BY ALL""",
)
def _(spark, d):
    sl = V.scored_long(spark, d).withColumn("dataset", F.col("grp") % 3)
    hit = ((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("int")
    evals = sl.groupBy(F.col("model").alias("run"), "dataset").agg(F.round(F.avg(hit), 6).alias("acc"), F.round(F.avg("prob"), 6).alias("prob_mean"))
    known = sl.groupBy(F.col("model").alias("run")).agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("prob"))), 6).alias("known_f1"))
    return rnd(A.proxy_report(evals, known, ["acc", "prob_mean"]))


@query(
    "run_tiebreak",
    f"""{LONG}, {V.SQL['baseline']}, u AS (SELECT 'u'||(grp%20) AS run, id, (prob_pos>=0.5)::INT AS c FROM scored), r AS (SELECT 'u'||(grp%20) AS run, round(max(prob_pos),6) AS cluster_f1, round(max(prob_pos)+0.002e0,6) AS top_f1 FROM scored GROUP BY 1),
    kn AS (SELECT run, cluster_f1/2 AS known_f1 FROM r WHERE run<>'u3'), dd AS (SELECT run, count(*) FILTER (c=1) AS positives, count(*) FILTER (c<>label) AS diff_vs_baseline, count(*) FILTER (label=1 AND c<>1) AS baseline_pos_to_neg, count(*) FILTER (label<>1 AND c=1) AS baseline_neg_to_pos FROM u JOIN baseline USING (id) WHERE run<>'u5' GROUP BY 1)
    SELECT run, cluster_f1, top_f1, known_f1, positives, diff_vs_baseline, baseline_pos_to_neg, baseline_neg_to_pos, regexp_matches(run,'^u1') AS supervised,
    cluster_f1>=0.993 AND top_f1>=1.0 AS passes_gate, cluster_f1>=0.999 AND top_f1>=0.999 AS saturated, round((cluster_f1+top_f1)/2,6) AS mean_f1,
    concat(CASE WHEN regexp_matches(run,'^u1') THEN 'mytest_supervised;' ELSE '' END, CASE WHEN coalesce(diff_vs_baseline,0)>30 THEN 'large_submission_diff;' ELSE '' END, CASE WHEN coalesce(positives,128)<110 OR coalesce(positives,128)>145 THEN 'pos_count_far;' ELSE '' END) AS flags
    FROM r LEFT JOIN kn USING (run) LEFT JOIN dd USING (run)""",
)
def _(spark, d):
    sc = V.scored(spark, d).withColumn("run", F.concat(F.lit("u"), F.col("grp") % 20))
    runs = sc.groupBy("run").agg(F.round(F.max("prob_pos"), 6).alias("cluster_f1"), F.round(F.max("prob_pos") + 0.002, 6).alias("top_f1"))
    known = runs.where("run <> 'u3'").select("run", (F.col("cluster_f1") / 2).alias("known_f1"))
    cand = sc.where("run <> 'u5'").select("id", "run", (F.col("prob_pos") >= 0.5).cast("int").alias("label"))
    out = A.run_tiebreak(runs, known, J.baseline_diff(V.baseline(spark, d), cand, ["run"]), "^u1")
    return out.withColumn("mean_f1", F.round("mean_f1", 6))


@query(
    "assembled_manifest",
    """SELECT 'train/'||doc_id AS sample_id, 'train' AS source, quality AS label, 'c/'||doc_id AS path, false AS is_not_stone, true AS has_image FROM labels
    UNION ALL SELECT 'test/'||event_id, 'test', NULL, '', event_id%9=0, false FROM events""",
)
def _(spark, d):
    from sievecrest.plans.manifests import assemble_manifest

    train = V.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), F.col("quality").alias("label"), F.concat(F.lit("c/"), "doc_id").alias("path"))
    test = V.table(spark, d, "events").select(F.col("event_id").alias("image_id"), (F.col("event_id") % 9 == 0).alias("is_not_stone"))
    return assemble_manifest({"train": train, "test": test}).select("sample_id", "source", "label", "path", "is_not_stone", "has_image")


def _protocol(spark, d):
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    ev = V.scored(spark, d)
    extra = ev.select(F.concat(F.lit("x"), "id").alias("id"), "label", F.col("grp").alias("group"))
    skips = labels.where("id % 17 = 0")
    return PR.split_protocol(labels, seed=42, skips=skips, sample_ratio=0.9, extra=extra, extra_weight=0.5, extra_val_ratio=0.2, target_ratio=1.5)


PROTO = f"""{with_views('scored')}, b0 AS (SELECT doc_id::VARCHAR AS id, quality AS label FROM labels WHERE doc_id%17<>0),
  b1 AS (SELECT id, label FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42:',id)), id) AS rn, count(*) OVER () AS n FROM b0) WHERE rn<=round_even(n*0.9e0,0)),
  x AS (SELECT 'x'||id AS id, label, grp AS g FROM scored), xg AS (SELECT label, g, count(*) AS n FROM x GROUP BY ALL),
  xo AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY md5(concat('53:',g)), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, greatest(1,round_even(sum(n) OVER (PARTITION BY label)*0.2e0,0)) AS target FROM xg),
  xs AS (SELECT x.id, x.label, before<target AS held FROM x JOIN xo USING (label, g)),
  v AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('49:',id)), id) AS rn, count(*) OVER (PARTITION BY label) AS sz FROM xs WHERE held),
  sp AS (SELECT id, label, CASE WHEN rn<=CASE WHEN sz>1 THEN least(greatest(1,round_even(sz*0.5e0,0)),sz-1) ELSE 0 END THEN 'threshold_search' ELSE 'model_select' END AS role FROM v),
  cn AS (SELECT role, count(*) FILTER (label=0) AS neg, count(*) FILTER (label=1) AS pos FROM sp GROUP BY role),
  rb AS (SELECT sp.*, row_number() OVER (PARTITION BY sp.role, label ORDER BY md5(concat(CASE sp.role WHEN 'threshold_search' THEN '59:' ELSE '71:' END, id)), id) AS rn, neg, pos FROM sp JOIN cn USING (role)),
  fin AS (SELECT id, label, role FROM rb WHERE rn <= CASE WHEN label=1 THEN (CASE WHEN neg/pos::DOUBLE<1.5 THEN greatest(1,round_even(neg/1.5e0,0)) ELSE pos END) ELSE (CASE WHEN neg/pos::DOUBLE<1.5 THEN neg ELSE greatest(1,round_even(pos*1.5e0,0)) END) END),
  proto AS (SELECT id, label, label AS label_idx, 1e0 AS sample_weight, 'train' AS source, 'train' AS role FROM b1 UNION ALL SELECT id, label, label, 0.5e0, 'extra', 'train' FROM xs WHERE NOT held UNION ALL SELECT id, label, label, 0.5e0, 'extra', role FROM fin)"""


@query("split_protocol", f"{PROTO} SELECT * FROM proto")
def _(spark, d):
    return _protocol(spark, d)


@query(
    "split_protocol_priors",
    f"""{PROTO} SELECT role, count(*) FILTER (label<>1) AS negatives, count(*) FILTER (label=1) AS positives, count(*) AS total, round(count(*) FILTER (label<>1)/count(*)::DOUBLE,6) AS neg_prior, round(count(*) FILTER (label=1)/count(*)::DOUBLE,6) AS pos_prior,
    round(count(*) FILTER (label<>1)/(count(*) FILTER (label=1))::DOUBLE,6) AS neg_pos_ratio FROM proto GROUP BY role""",
)
def _(spark, d):
    return rnd(PR.protocol_priors(_protocol(spark, d)))


@query(
    "probes_against_baseline",
    f"""{LONG}, {V.SQL['baseline']}, j AS (SELECT model, id, prob, (prob>=0.5)::INT AS l FROM scored_long WHERE (id+substr(model,2)::INT)%7<>0),
    f AS (SELECT m.model, b.label AS b, j.l, j.prob, coalesce(j.l, b.label) AS c FROM baseline b CROSS JOIN (SELECT DISTINCT model FROM scored_long) m LEFT JOIN j ON j.model=m.model AND j.id=b.id)
    SELECT model, count(l) AS scored, count(*) FILTER (l=1) AS scored_positives, round(avg(prob),6) AS prob_mean, count(*) FILTER (b<>c) AS diff_vs_baseline, count(*) FILTER (b=1 AND c=0) AS baseline_pos_to_neg,
    count(*) FILTER (b=0 AND c=1) AS baseline_neg_to_pos, count(*)-count(l) AS filled, count(*) FILTER (c=1) AS positives FROM f GROUP BY model""",
)
def _(spark, d):
    scored = V.scored_long(spark, d).where((F.col("id") + F.substring("model", 2, 1).cast("int")) % 7 != 0)
    return rnd(LD.probes_against_baseline(scored.withColumnRenamed("prob", "prob_pos"), V.baseline(spark, d), "model"))


@query(
    "sorted_run_report",
    """SELECT o_orderkey AS run, o_orderpriority AS priority, m AS metric, row_number() OVER (ORDER BY o_orderpriority, m DESC NULLS LAST, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderkey%7<>0 THEN o_totalprice END AS m FROM orders)""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("metric")
    )
    order = [F.col("priority").asc_nulls_last(), F.col("metric").desc_nulls_last(), F.col("run").asc_nulls_last()]
    return global_row_number(o, order, "place")
