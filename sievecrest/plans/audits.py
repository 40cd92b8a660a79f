"""Multi-step audit plans built from the operators; steps that rank rows write narrow tables as they are planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.functions import risk as R
from sievecrest.operators.filters import matched_rules
from sievecrest.operators.metrics import grouped_rank_correlation
from sievecrest.operators.neighbours import cosine_knn, with_ref_columns
from sievecrest.operators.ordering import average_ranks, global_row_number, running_totals
from sievecrest.session import cut_lineage


def consensus_scores(
    df: DataFrame, risk: str, verifier: str, top5: str, train10: str, top10: str, alt: str, prob: str,
    risk_high_is_bad: bool = True, digits: int | None = None,
) -> DataFrame:
    """Consensus of percentile ranks, neighbour labels, model disagreement and low confidence.

    ``risk_high_is_bad`` gives the highest risk the strongest signal; False turns the ranks round.
    """
    ranked = average_ranks(df, {risk: "_rr", verifier: "_rv"}, pct=True)
    rr, rv = F.col("_rr"), F.col("_rv")
    if not risk_high_is_bad:
        rr, rv = 1.0 - rr, 1.0 - rv
    score = R.consensus_fp_score(
        rr, rv, R.neighbour_negative_signal(F.col(top5), F.col(train10), F.col(top10)), F.col(alt), F.col(prob)
    )
    if digits is not None:
        score = F.round(score, digits)
    return ranked.withColumn("consensus", score).drop("_rr", "_rv")


def risk_table(evidence: DataFrame, probs: DataFrame, current: DataFrame, second: DataFrame, extra: str = "extra") -> DataFrame:
    """Neighbour evidence merged with probabilities and two label tables, scored and ranked.

    ``evidence`` has query_id; the other tables have id. Rank 1 is the riskiest row.
    """
    df = (
        evidence.withColumnRenamed("query_id", "id")
        .join(probs.select("id", "prob_pos"), "id", "left")
        .join(current.select("id", F.col("label").alias("current_label")), "id", "left")
        .join(second.select("id", F.col("label").alias("second_label")), "id", "left")
    )
    c = F.col
    score = R.fp_risk_score(
        c("top5_pos_frac"), c("top10_pos_frac"), c("train_top10_pos_frac"), c("myval_top10_pos_frac"), c(f"{extra}_top10_pos_frac"),
        c("prob_pos"), c("current_label"), c("second_label"),
    )
    scored = df.withColumn("fp_risk_score", F.round(score, 9))
    return global_row_number(scored, [c("fp_risk_score").desc(), c("id").asc()], "fp_risk_rank")


def verifier_features(risk: DataFrame, likeness: DataFrame, votes: DataFrame, weak: DataFrame) -> DataFrame:
    """Feature table of current positives: risk, test-likeness, model votes, weak labels, score and rank."""
    c = F.col
    pos = risk.where(c("current_label") == 1)
    alt = votes.select("id", c("pos_votes").alias("alt_model_pos_votes"), c("model_count").alias("alt_model_count"),
                       c("pos_frac").alias("alt_model_pos_frac"), c("neg_votes").alias("alt_model_neg_votes"))
    df = pos.join(likeness, "id", "left").join(alt, "id", "left").join(weak, "id", "left")
    df = df.withColumn("weak_label", F.coalesce("weak_label", F.lit("")))
    score = R.verifier_fp_score(
        c("fp_risk_score"), c("top5_pos_frac"), c("train_top10_pos_frac"), c("top10_pos_frac"), c("alt_model_pos_frac"), c("prob_pos")
    )
    scored = df.withColumn("verifier_fp_score", F.round(score, 9))
    order = [c("verifier_fp_score").desc(), c("fp_risk_score").desc(), c("id").asc()]
    return global_row_number(scored, order, "verifier_rank")


def rule_summary(features: DataFrame, rules: dict, known: dict[str, DataFrame]) -> DataFrame:
    """Per rule: rows selected, hits in known id sets and mean evidence; empty rules stay.

    ``place`` orders rules by the hits in the known sets (most of the first, then fewest of the
    others), then by fewest rows and least mean risk. The ids of a rule, all of them and in rank
    order, are rows of ``rule_ids``.
    """
    hits = matched_rules(features, rules)
    for name, ids in known.items():
        hits = hits.join(ids.select("id").distinct().withColumn(f"_{name}", F.lit(True)), "id", "left")
    facts = hits.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_selected"),
        *[F.count(f"_{name}").alias(f"{name}_hits") for name in known],
        F.avg("fp_risk_score").alias("mean_fp_risk"), F.avg("prob_pos").alias("mean_prob"), F.avg("alt_model_pos_frac").alias("mean_alt_pos_frac"),
    )
    every = features.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    counts = ["n_selected", *[f"{n}_hits" for n in known]]
    out = every.join(facts, "rule", "left").select(
        "rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "mean_fp_risk", "mean_prob", "mean_alt_pos_frac"
    )
    first, *others = [f"{n}_hits" for n in known]
    order = [F.col(first).desc(), *[F.col(c).asc() for c in others], F.col("n_selected").asc(), F.col("mean_fp_risk").asc_nulls_last(), F.col("rule").asc()]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def rule_ids(features: DataFrame, rules: dict) -> DataFrame:
    """(rule, place, id): every id a rule selects, in verifier rank order.

    The verifier rank is unique, so a rule's place is the number of its rows up to that rank; ranks
    are summed range by range and no rule is ordered in one task.
    """
    hits = cut_lineage(matched_rules(features, rules).select("rule", "id", "verifier_rank").withColumn("one", F.lit(1).cast("bigint")))
    placed = running_totals(hits, "verifier_rank", ["one"], ["rule"], descending=False)
    return placed.select("rule", F.col("cum_one").alias("place"), "id")


def neighbour_shares(queries: DataFrame, refs: DataFrame, k: int = 5, find=cosine_knn) -> DataFrame:
    """(id, top5_pos_frac): positive share among the ``k`` nearest labelled rows of one backbone."""
    edges = with_ref_columns(find(queries, refs, k), refs, ["label"])
    return edges.groupBy(F.col("query_id").alias("id")).agg(F.avg((F.col("ref_label") == 1).cast("int")).alias("top5_pos_frac"))


def embedding_agreement(base: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """Join top-5 positive shares of two more embeddings to the base table and rate their agreement."""
    cols = {"top5_pos_frac": "top5"}
    def shares(df, p):
        return df.select("id", *[F.col(c).alias(f"{p}_{n}") for c, n in cols.items()])

    df = base.join(shares(second, "second"), "id", "left").join(shares(third, "third"), "id", "left")
    a, b, c = F.col("top5_pos_frac"), F.col("second_top5"), F.col("third_top5")
    three = R.negative_consensus(a, b, c)
    return (
        df.withColumn("two_way_negative", R.negative_consensus(b, c))
        .withColumn("three_way_negative", three)
        .withColumn("strong_negative", R.strong_negative(a, b, c))
        .withColumn("disagrees", R.embeddings_disagree(b, a))
        .withColumn("note", R.consensus_note(F.col("weak_label"), three, b, c))
    )


def run_tiebreak(runs: DataFrame, known: DataFrame, diffs: DataFrame, supervised_pattern: str) -> DataFrame:
    """Runs with known scores, gate, saturation, mean, flags; sort keys are columns of the result.

    ``runs`` has run, cluster_f1, top_f1; ``diffs`` comes from ``baseline_diff`` by run.
    """
    c = F.col
    supervised = c("run").rlike(supervised_pattern)
    df = runs.join(known, "run", "left").join(diffs.select("run", "positives", "diff_vs_baseline", "baseline_pos_to_neg", "baseline_neg_to_pos"), "run", "left")
    return df.select(
        "run", "cluster_f1", "top_f1", "known_f1", "positives", "diff_vs_baseline", "baseline_pos_to_neg", "baseline_neg_to_pos",
        supervised.alias("supervised"),
        R.gate(c("cluster_f1"), c("top_f1")).alias("passes_gate"),
        R.gate(c("cluster_f1"), c("top_f1"), 0.999, 0.999).alias("saturated"),
        ((c("cluster_f1") + c("top_f1")) / 2.0).alias("mean_f1"),
        R.risk_flags(supervised, c("diff_vs_baseline"), c("positives")).alias("flags"),
    )


def proxy_report(evals: DataFrame, known: DataFrame, metrics: list[str]) -> DataFrame:
    """Rank correlation of each metric with the known score, per dataset: (dataset, metric, n, rank_corr)."""
    joined = evals.join(known, "run")
    parts = None
    for m in metrics:
        part = grouped_rank_correlation(joined, "dataset", "run", m, "known_f1").withColumn("metric", F.lit(m))
        parts = part if parts is None else parts.unionByName(part)
    return parts
