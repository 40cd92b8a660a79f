"""Priors, calibration, thresholds, evaluation and loss queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions import scores as S
from sievecrest.operators import metrics as M
from sievecrest.operators.cells import CellStore
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views
from sievecrest.session import scratch_path

R6 = 6


def rounded(df, *cols, digits=R6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


F1_SQL = """CASE WHEN tp::DOUBLE/greatest(1,tp+fp) + tp::DOUBLE/greatest(1,tp+fn) = 0 THEN 0e0
  ELSE 2e0*(tp::DOUBLE/greatest(1,tp+fp))*(tp::DOUBLE/greatest(1,tp+fn))
       /(tp::DOUBLE/greatest(1,tp+fp) + tp::DOUBLE/greatest(1,tp+fn)) END"""


def sweep_sql(src: str, score: str = "prob_pos", by: str = "grp") -> str:
    """CTEs ``cand`` and ``sweep``: F1 at every distinct score and at 0, 0.5 and 1, per group."""
    return f"""cells AS (SELECT {by}, {score} AS score, count(*) AS n, count(*) FILTER (label=1) AS pos,
        count(*) FILTER (label=0) AS neg FROM {src} GROUP BY ALL),
      cand AS (SELECT {by}, score, sum(n) AS n, sum(pos) AS pos, sum(neg) AS neg FROM (
        SELECT * FROM cells UNION ALL
        SELECT {by}, c.t, 0, 0, 0 FROM (SELECT DISTINCT {by} FROM cells), (VALUES (0e0),(0.5e0),(1e0)) c(t))
        GROUP BY {by}, score),
      cums AS (SELECT {by}, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        sum(pos) OVER (PARTITION BY {by}) - sum(pos) OVER w AS fn FROM cand
        WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      sweep AS (SELECT {by}, score, {F1_SQL} AS f1 FROM cums),
      best AS (SELECT {by}, max(f1) AS best_f1, min(score) FILTER (f1=mx) AS threshold FROM
        (SELECT *, max(f1) OVER (PARTITION BY {by}) AS mx FROM sweep) GROUP BY {by})"""


@query(
    "class_priors",
    f"""{with_views('scored')} SELECT grp, count(*) FILTER (label<>1) AS negatives, count(*) FILTER (label=1) AS positives,
    count(*) AS total, round(count(*) FILTER (label<>1)/count(*)::DOUBLE,6) AS neg_prior,
    round(count(*) FILTER (label=1)/count(*)::DOUBLE,6) AS pos_prior,
    CASE WHEN count(*) FILTER (label=1)>0 THEN round(count(*) FILTER (label<>1)/(count(*) FILTER (label=1))::DOUBLE,6) END AS neg_pos_ratio
    FROM scored GROUP BY grp""",
)
def _(spark, d):
    return rounded(M.class_priors(V.scored(spark, d), by=["grp"]), "neg_prior", "pos_prior", "neg_pos_ratio")


@query(
    "target_class_weights",
    f"""{with_views('scored')}, p AS (SELECT avg((label=0)::INT) AS np, avg((label=1)::INT) AS pp,
      count(*) FILTER (label=0) AS negatives, count(*) FILTER (label=1) AS positives FROM scored),
    w AS (SELECT *, (1-0.2e0)/np AS nw, 0.2e0/pp AS pw FROM p)
    SELECT negatives, positives, 0.2e0 AS target_pos_prior, round(nw/((nw+pw)/2),6) AS neg_weight,
      round(pw/((nw+pw)/2),6) AS pos_weight FROM w""",
)
def _(spark, d):
    out = M.with_target_weights(M.class_priors(V.scored(spark, d), strict=True), 4.0)
    return rounded(
        out.select("negatives", "positives", "target_pos_prior", "neg_weight", "pos_weight"), "target_pos_prior", "neg_weight", "pos_weight"
    )


@query(
    "prior_corrected_probs",
    f"""{with_views('scored')}, pri AS (SELECT avg(label) AS pi FROM scored),
    q AS (SELECT id, prob_pos, least(greatest(prob_pos,1e-6),1-1e-6) AS p,
      least(greatest(pi,1e-6),1-1e-6) AS pi FROM scored, pri)
    SELECT id, round(prob_pos,6) AS prob_pos,
     round(1/(1+exp(-(ln(p/(1-p)) + ln(0.2e0/0.8e0) - ln(pi/(1-pi))))),6) AS prob_pos_corrected,
     (round(1/(1+exp(-(ln(p/(1-p)) + ln(0.2e0/0.8e0) - ln(pi/(1-pi))))),6) >= 0.5)::INT AS label FROM q""",
)
def _(spark, d):
    df = V.scored(spark, d)
    train_pi = M.class_priors(df).select("pos_prior").scalar()
    fixed = F.round(S.bayes_prior_correct(F.col("prob_pos"), train_pi, 0.2), 6)
    return df.select("id", F.round("prob_pos", 6).alias("prob_pos"), fixed.alias("prob_pos_corrected")).withColumn(
        "label", S.threshold_label(F.col("prob_pos_corrected"), 0.5)
    )


@query(
    "clamp_logit_sigmoid",
    f"""{with_views('scored')}, q AS (SELECT id, least(greatest(prob_pos,1e-3),1-1e-3) AS p FROM scored)
    SELECT id, round(p,6) AS clamped, round(ln(p/(1-p)),6) AS logit, round(1/(1+exp(-ln(p/(1-p)))),6) AS back FROM q""",
)
def _(spark, d):
    p = F.col("prob_pos")
    return V.scored(spark, d).select(
        "id",
        F.round(S.clamp(p, 1e-3), 6).alias("clamped"),
        F.round(S.logit(p, 1e-3), 6).alias("logit"),
        F.round(S.sigmoid(S.logit(p, 1e-3)), 6).alias("back"),
    )


@query(
    "confidence_columns",
    f"""{with_views('scored')} SELECT id, round(CASE WHEN prob_pos>=0.5 THEN prob_pos ELSE 1-prob_pos END,6) AS confidence,
    round(1-2*abs(prob_pos-0.5),6) AS low_conf, (prob_pos>=0.4)::INT AS label FROM scored""",
)
def _(spark, d):
    p = F.col("prob_pos")
    return V.scored(spark, d).select(
        "id",
        F.round(S.confidence(p), 6).alias("confidence"),
        F.round(S.low_confidence(p), 6).alias("low_conf"),
        S.threshold_label(p, 0.4).alias("label"),
    )


@query(
    "f1_by_group",
    f"""{with_views('scored')}, c AS (SELECT grp, count(*) FILTER (prob_pos>=0.5 AND label=1) AS tp,
    count(*) FILTER (prob_pos>=0.5 AND label=0) AS fp, count(*) FILTER (prob_pos<0.5 AND label=1) AS fn
    FROM scored GROUP BY grp) SELECT grp, tp, fp, fn, round({F1_SQL},6) AS f1 FROM c""",
)
def _(spark, d):
    return rounded(M.f1_at(V.scored(spark, d), "prob_pos", "label", 0.5, ["grp"]), "f1")


@query(
    "best_threshold_by_group",
    f"""{with_views('scored')}, {sweep_sql('scored')}
    SELECT grp, round(threshold,6) AS threshold, round(best_f1,6) AS best_f1 FROM best""",
)
def _(spark, d):
    return rounded(M.best_threshold(V.scored(spark, d), "prob_pos", "label", ["grp"]), "threshold", "best_f1")


@query(
    "best_threshold_overall",
    f"""{with_views('scored')}, one AS (SELECT *, 1 AS g FROM scored), {sweep_sql('one', by='g')}
    SELECT round(threshold,6) AS threshold, round(best_f1,6) AS best_f1 FROM best""",
)
def _(spark, d):
    return rounded(M.best_threshold(V.scored(spark, d), "prob_pos", "label"), "threshold", "best_f1")


@query(
    "best_threshold_zero_start",
    f"""{with_views('scored')}, {sweep_sql('scored')}
    SELECT grp, round(CASE WHEN best_f1>0 THEN threshold ELSE 0.5e0 END,6) AS threshold,
      round(greatest(best_f1,0e0),6) AS best_f1 FROM best""",
)
def _(spark, d):
    return rounded(M.best_threshold(V.scored(spark, d), "prob_pos", "label", ["grp"], start=0.0), "threshold", "best_f1")


GRID_STEP = repr((0.95 - 1e-4) / 499)


@query(
    "calibrate_to_positive_count",
    f"""{with_views('scored_long').replace('WITH scored_long', 'WITH ' + V.SQL['scored'] + ', scored_long')},
    grid AS (SELECT i, CASE WHEN i=499 THEN 0.95e0 ELSE i*'{GRID_STEP}'::DOUBLE + 1e-4 END AS t FROM range(0,500) r(i)),
    cells AS (SELECT model, prob, count(*) AS n FROM scored_long GROUP BY ALL),
    cnt AS (SELECT model, i, t, sum(CASE WHEN prob>=t THEN n ELSE 0 END)::BIGINT AS pos FROM cells, grid GROUP BY ALL),
    tg AS (SELECT unnest([100,120,1000,2500])::BIGINT AS target)
    SELECT model, target, round(t,6) AS threshold, pos AS positives FROM
    (SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY abs(pos-target), i) AS rn FROM cnt, tg) WHERE rn=1""",
)
def _(spark, d):
    out = M.calibrate_to_positive_count(V.scored_long(spark, d), "prob", [100, 120, 1000, 2500], ["model"])
    return rounded(out, "threshold")


LONG = with_views("scored", "scored_long")


EVAL_SQL = f"""{LONG}, src AS (SELECT model||'/'||(grp%3) AS k, model, grp%3 AS dataset, prob AS prob_pos, label FROM scored_long),
    {sweep_sql('src', by='k')},
    c AS (SELECT k, min(model) AS model, min(dataset) AS dataset, count(*) FILTER (prob_pos>=0.5 AND label=1) AS tp,
     count(*) FILTER (prob_pos>=0.5 AND label=0) AS fp, count(*) FILTER (prob_pos<0.5 AND label=1) AS fn,
     count(*) AS n, count(*) FILTER (label=1) AS pos_true, count(*) FILTER (prob_pos>=0.5) AS pos_pred_at_0_5,
     avg(prob_pos) AS prob_mean, stddev_pop(prob_pos) AS prob_std, quantile_cont(prob_pos,0.5) AS prob_median FROM src GROUP BY k)
    SELECT model, dataset, n, pos_true, pos_pred_at_0_5, round(prob_mean,6) AS prob_mean, round(prob_std,6) AS prob_std,
     round(prob_median,6) AS prob_median, round({F1_SQL},6) AS f1_at_0_5, round(best_f1,6) AS best_f1,
     round(threshold,6) AS best_threshold FROM c JOIN best USING (k)"""


@query(
    "eval_summary",
    EVAL_SQL,
)
def _(spark, d):
    df = V.scored_long(spark, d).withColumn("dataset", F.col("grp") % 3)
    out = M.eval_summary(df, "prob", "label", ["model", "dataset"])
    return rounded(out, "prob_mean", "prob_std", "prob_median", "f1_at_0_5", "best_f1", "best_threshold")


DISTRIBUTION_SQL = f"""{with_views('scored')} SELECT label, count(*) AS n, round(avg(prob_pos),6) AS mean, round(stddev_pop(prob_pos),6) AS std,
    count(*) FILTER (prob_pos>=0.5) AS pos_at_0_5, round(quantile_cont(prob_pos,0.1),6) AS p10,
    round(quantile_cont(prob_pos,0.25),6) AS p25, round(quantile_cont(prob_pos,0.5),6) AS p50,
    round(quantile_cont(prob_pos,0.75),6) AS p75, round(quantile_cont(prob_pos,0.9),6) AS p90 FROM scored GROUP BY label"""


@query(
    "probability_distribution",
    DISTRIBUTION_SQL,
)
def _(spark, d):
    out = M.distribution_report(V.scored(spark, d), "prob_pos", ["label"])
    return rounded(out, "mean", "std", "p10", "p25", "p50", "p75", "p90")


@query("cell_store_summary", EVAL_SQL)
def _(spark, d):
    """Runs arrive one by one; the first comes with wrong scores, which are taken back and replaced."""
    df = V.scored_long(spark, d).withColumn("dataset", F.col("grp") % 3)
    store = CellStore(spark, scratch_path(spark, "score-cells"), ["model", "dataset"])
    runs = {f"m{i}": df.where(F.col("model") == f"m{i}") for i in range(5)}
    wrong = runs["m0"].withColumn("prob", 1 - F.col("prob"))
    store.add(wrong, "prob", "label", "m0-wrong")
    for name, rows in runs.items():
        store.add(rows, "prob", "label", name)
    store.retract(wrong, "prob", "label", "m0-undo")
    return rounded(store.summary(), "prob_mean", "prob_std", "prob_median", "f1_at_0_5", "best_f1", "best_threshold")


@query("cell_store_distribution", DISTRIBUTION_SQL)
def _(spark, d):
    """One batch a label, merged into one part before the report."""
    df = V.scored(spark, d)
    store = CellStore(spark, scratch_path(spark, "score-cells"), ["label"])
    for label in (0, 1):
        store.add(df.where(F.col("label") == label), "prob_pos", "label", f"label-{label}")
    store.compact()
    return rounded(store.distribution(), "mean", "std", "p10", "p25", "p50", "p75", "p90")


@query(
    "value_distribution_overall",
    """SELECT count(*) AS n, round(avg(l_extendedprice),4) AS mean, round(stddev_pop(l_extendedprice),4) AS std,
    count(*) FILTER (l_extendedprice>=0.5) AS pos_at_0_5, round(quantile_cont(l_extendedprice,0.1),4) AS p10,
    round(quantile_cont(l_extendedprice,0.25),4) AS p25, round(quantile_cont(l_extendedprice,0.5),4) AS p50,
    round(quantile_cont(l_extendedprice,0.75),4) AS p75, round(quantile_cont(l_extendedprice,0.9),4) AS p90 FROM lineitem""",
)
def _(spark, d):
    out = M.distribution_report(V.table(spark, d, "lineitem"), "l_extendedprice")
    return rounded(out, "mean", "std", "p10", "p25", "p50", "p75", "p90", digits=4)


@query(
    "probability_histogram",
    f"""{with_views('scored')}, b AS (SELECT label, len(list_filter(range(1,50), lambda i: i/50e0<=prob_pos))::INT AS bin FROM scored),
    e AS (SELECT * FROM (SELECT DISTINCT label FROM scored), (SELECT unnest(range(50))::INT AS bin))
    SELECT label, e.bin, count(b.bin) AS count, round(count(b.bin)/((sum(count(b.bin)) OVER (PARTITION BY label))*(1e0/50)),6) AS density
    FROM e LEFT JOIN b USING (label, bin) GROUP BY label, e.bin""",
)
def _(spark, d):
    return rounded(M.histogram(V.scored(spark, d), "prob_pos", ["label"]), "density")


@query(
    "distribution_at_best_threshold",
    f"""{with_views('scored')}, o AS (SELECT label, prob_pos FROM scored WHERE id%2=0), d AS (SELECT prob_pos AS p FROM scored WHERE id%2=1),
    c AS (SELECT t, (SELECT count(*) FROM o WHERE prob_pos>=t AND label=1) AS tp, (SELECT count(*) FROM o WHERE prob_pos>=t AND label=0) AS fp, (SELECT count(*) FROM o WHERE prob_pos<t AND label=1) AS fn
      FROM (SELECT DISTINCT prob_pos AS t FROM o UNION SELECT unnest([0e0,0.5e0,1e0]))),
    b AS (SELECT t AS threshold FROM c ORDER BY CASE WHEN tp=0 THEN 0e0 ELSE 2e0*(tp::DOUBLE/greatest(1,tp+fp))*(tp::DOUBLE/greatest(1,tp+fn))/(tp::DOUBLE/greatest(1,tp+fp)+tp::DOUBLE/greatest(1,tp+fn)) END DESC, t LIMIT 1)
    SELECT count(*) AS n, count(*) FILTER (p>=0.5) AS pos_at_0_5, round(max(threshold),6) AS threshold, count(*) FILTER (p>=threshold) AS pos_at_best,
      round(count(*) FILTER (p>=0.5)/(count(*) FILTER (p<0.5))::DOUBLE,6) AS ratio_at_0_5, round(count(*) FILTER (p>=threshold)/nullif(count(*) FILTER (p<threshold),0)::DOUBLE,6) AS ratio_at_best FROM d, b""",
)
def _(spark, d):
    df = V.scored(spark, d)
    out = M.distribution_at_threshold(df.where("id % 2 = 1"), "prob_pos", df.where("id % 2 = 0"), "label")
    return rounded(out.select("n", "pos_at_0_5", "threshold", "pos_at_best", "ratio_at_0_5", "ratio_at_best"), "threshold", "ratio_at_0_5", "ratio_at_best")


RUNS_SQL = f"""{with_views('scored')}, runs AS (SELECT grp AS run, id%3 AS ds, avg(label) AS truth,
    count(*) FILTER (prob_pos>=0.5)::DOUBLE/count(*) AS metric, avg(prob_pos) AS pm FROM scored GROUP BY ALL)"""


@query(
    "rank_correlation",
    f"""{RUNS_SQL}, r0 AS (SELECT run, min((metric, truth)) AS s FROM (SELECT run, round(metric,6) AS metric, round(truth,6) AS truth FROM runs) GROUP BY run),
    r AS (SELECT run, s[1] AS metric, s[2] AS truth FROM r0),
    k AS (SELECT rank() OVER (ORDER BY metric) + (count(*) OVER (PARTITION BY metric)-1)/2e0 AS rm,
      rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth)-1)/2e0 AS rt FROM r)
    SELECT count(*) AS n, CASE WHEN count(*)>=3 THEN round(corr(rm, rt),6) END AS rank_corr FROM k""".replace(
        "min((metric, truth))", "arg_min([metric, truth], metric*1e9+truth)"
    ),
)
def _(spark, d):
    runs = (
        V.scored(spark, d)
        .groupBy(F.col("grp").alias("run"), (F.col("id") % 3).alias("ds"))
        .agg(F.avg("label").alias("truth"), (F.count_if(F.col("prob_pos") >= 0.5) / F.count(F.lit(1))).alias("metric"))
        .withColumn("metric", F.round("metric", 6))
        .withColumn("truth", F.round("truth", 6))
    )
    return rounded(M.rank_correlation(runs, "run", "metric", "truth"), "rank_corr")


@query(
    "run_metrics_wide",
    f"""{RUNS_SQL} SELECT run, round(max(metric) FILTER (ds=0),6) AS metric__d0, round(max(pm) FILTER (ds=0),6) AS pm__d0,
    round(max(metric) FILTER (ds=1),6) AS metric__d1, round(max(pm) FILTER (ds=1),6) AS pm__d1,
    round(max(metric) FILTER (ds=2),6) AS metric__d2, round(max(pm) FILTER (ds=2),6) AS pm__d2 FROM runs GROUP BY run""",
)
def _(spark, d):
    runs = (
        V.scored(spark, d)
        .groupBy(F.col("grp").alias("run"), F.concat(F.lit("d"), F.col("id") % 3).alias("ds"))
        .agg((F.count_if(F.col("prob_pos") >= 0.5) / F.count(F.lit(1))).alias("metric"), F.avg("prob_pos").alias("pm"))
    )
    out = M.pivot_runs(runs, "run", "ds", ["d0", "d1", "d2"], ["metric", "pm"])
    return rounded(out, *[c for c in out.columns if c != "run"])


@query(
    "softmax_argmax",
    f"""{with_views('scored')}, l AS (SELECT id, label, prob_pos*4-2 AS a, ((id%97)::DOUBLE/97)*4-2 AS b FROM scored)
    SELECT id, round(exp(b)/(exp(a)+exp(b)),6) AS prob_pos, (b>a)::INT AS pred, ((b>a)::INT=label)::INT AS hit FROM l""",
)
def _(spark, d):
    z = F.array(F.col("prob_pos") * 4 - 2, (F.col("id") % 97) / F.lit(97.0) * 4 - 2)
    df = V.scored(spark, d).withColumn("z", z)
    return df.select(
        "id", F.round(S.softmax(F.col("z"), 1), 6).alias("prob_pos"), S.argmax(F.col("z")).alias("pred"), "label"
    ).select("id", "prob_pos", "pred", (F.col("pred") == F.col("label")).cast("int").alias("hit"))


LOGITS = f"""{with_views('scored')}, l AS (SELECT id, grp, label, prob_pos*4-2 AS a, ((id%97)::DOUBLE/97)*4-2 AS b,
   1+(id%3)*0.5e0 AS sw FROM scored), s AS (SELECT *, a-ln(exp(a)+exp(b)) AS la, b-ln(exp(a)+exp(b)) AS lb FROM l)"""


def _logit_frame(spark, d):
    z = F.array(F.col("prob_pos") * 4 - 2, (F.col("id") % 97) / F.lit(97.0) * 4 - 2)
    return V.scored(spark, d).withColumn("z", z).withColumn("sw", 1 + (F.col("id") % 3) * 0.5)


@query(
    "per_row_losses",
    f"""{LOGITS} SELECT id,
    round(-((CASE WHEN label=0 THEN 0.95e0 ELSE 0.05e0 END)*la*0.8e0 + (CASE WHEN label=1 THEN 0.95e0 ELSE 0.05e0 END)*lb*1.2e0)*sw,6) AS soft_ce,
    round(pow(1-exp(CASE WHEN label=1 THEN lb ELSE la END),2)*(CASE WHEN label=1 THEN 0.25e0 ELSE 0.75e0 END)
      *-(CASE WHEN label=1 THEN lb ELSE la END)*sw,6) AS focal FROM s""",
)
def _(spark, d):
    df = _logit_frame(spark, d)
    soft = S.soft_cross_entropy(F.col("z"), S.smoothed_target(F.col("label"), 2, 0.1), [0.8, 1.2], F.col("sw"))
    return df.select(
        "id",
        F.round(soft, 6).alias("soft_ce"),
        F.round(S.focal_loss(F.col("z"), F.col("label"), sample_weight=F.col("sw")), 6).alias("focal"),
    )


@query(
    "weighted_loss_accuracy",
    f"""{LOGITS} SELECT grp, count(*) AS n, round(sum(-(CASE WHEN label=1 THEN lb ELSE la END)*sw)/count(*),6) AS loss,
    round(avg(((b>a)::INT=label)::INT),6) AS accuracy FROM s GROUP BY grp""",
)
def _(spark, d):
    df = _logit_frame(spark, d)
    ce = S.soft_cross_entropy(F.col("z"), S.smoothed_target(F.col("label")))
    out = M.weighted_loss(df, ce, S.argmax(F.col("z")) == F.col("label"), F.col("sw"), ["grp"])
    return rounded(out, "loss", "accuracy")


@query(
    "temperature_grid",
    f"""{with_views('scored')}, q AS (SELECT label, least(greatest(prob_pos,1e-7),1-1e-7) AS p FROM scored),
    g AS (SELECT unnest([0.5e0,1e0,2e0,4e0,8e0]) AS temperature),
    v AS (SELECT temperature, label, least(greatest(1/(1+exp(-(ln(p/(1-p))/temperature))),1e-7),1-1e-7) AS c FROM q, g)
    SELECT temperature, round(avg(-ln(CASE WHEN label=1 THEN c ELSE 1-c END)),6) AS nll FROM v GROUP BY temperature""",
)
def _(spark, d):
    return rounded(M.temperature_nll(V.scored(spark, d), "prob_pos", "label", [0.5, 1.0, 2.0, 4.0, 8.0]), "nll")


def _fit_sql(rounds: int = 4, points: int = 25) -> str:
    """Grids that narrow around the best point, one pair of CTEs a round."""
    nll = "avg(-ln(CASE WHEN label=1 THEN c ELSE 1-c END))"
    scaled = "least(greatest(1/(1+exp(-(x/t))),1e-7),1-1e-7)"
    parts = ["b0 AS (SELECT 0.1e0 AS low, 10e0 AS high)"]
    for i in range(1, rounds + 1):
        step = f"((high-low)/{points - 1})"
        parts.append(
            f"g{i} AS (SELECT low, high, {step} AS step, low + k*{step} AS t FROM b{i - 1}, (SELECT unnest(range({points}))::DOUBLE AS k)), "
            f"n{i} AS (SELECT t, min(low) AS low, min(high) AS high, min(step) AS step, {nll} AS nll FROM (SELECT *, {scaled} AS c FROM lg, g{i}) GROUP BY t), "
            f"b{i} AS (SELECT greatest(low, t-step) AS low, least(high, t+step) AS high, t AS best FROM n{i} ORDER BY nll, t LIMIT 1)"
        )
    both = f"(SELECT 1e0 AS t UNION ALL SELECT best FROM b{rounds})"
    return ", ".join(parts) + f" SELECT round(t,6) AS temperature, round({nll},6) AS nll FROM (SELECT *, {scaled} AS c FROM lg, {both}) GROUP BY t"


@query(
    "temperature_fit",
    f"""{with_views('scored')}, q AS (SELECT label, least(greatest(prob_pos,1e-7),1-1e-7) AS p FROM scored), lg AS (SELECT label, ln(p/(1-p)) AS x FROM q), {_fit_sql()}""",
)
def _(spark, d):
    df = V.scored(spark, d)
    t = M.fit_temperature(df, "prob_pos", "label")
    return rounded(M.temperature_nll(df, "prob_pos", "label", [1.0, t]), "temperature", "nll")


@query(
    "average_percent_rank",
    """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey%5<>0 THEN round(o_totalprice/1000) END AS v FROM orders),
    n AS (SELECT count(*) AS n, count(v) AS k FROM r)
    SELECT id, round((CASE WHEN v IS NULL THEN (k+1+n)/2e0 ELSE rank() OVER (ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY v)-1)/2e0 END)/n,8) AS pct_rank FROM r, n""",
)
def _(spark, d):
    from sievecrest.operators.ordering import average_rank

    df = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.round(F.col("o_totalprice") / 1000)).alias("v"),
    )
    return average_rank(df, "v", "pct_rank", pct=True).select("id", F.round("pct_rank", 8).alias("pct_rank"))


@query(
    "unique_rank_descending",
    f"""{with_views('scored')} SELECT id, row_number() OVER (ORDER BY prob_pos DESC, id) AS risk_rank FROM scored""",
)
def _(spark, d):
    from sievecrest.operators.ordering import global_row_number

    df = V.scored(spark, d).select("id", "prob_pos")
    return global_row_number(df, [F.col("prob_pos").desc(), F.col("id").asc()], "risk_rank").select("id", "risk_rank")
