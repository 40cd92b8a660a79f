"""Neighbour search, neighbour evidence and label-conflict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions.risk import candidate_filter
from sievecrest.functions.vectors import l2_normalise, norm, round_half_up
from sievecrest.operators import neighbours as N
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views


def rnd(df, digits=6, skip=()):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes]
    )


def knn_sql(q: str, r: str, k: int) -> str:
    """CTE ``edges`` with the exact top k, ties by reference id."""
    return f"""edges AS (SELECT * FROM (SELECT q.sample_id AS query_id, r.sample_id AS ref_id, q.label AS query_label, r.label AS ref_label, r.source AS ref_source,
      list_cosine_similarity(q.embedding, r.embedding) AS sim,
      row_number() OVER (PARTITION BY q.sample_id ORDER BY round(list_cosine_similarity(q.embedding, r.embedding),12) DESC, r.sample_id) AS rank
      FROM (SELECT * FROM manifest WHERE {q}) q, (SELECT * FROM manifest WHERE {r}) r) WHERE rank<={k})"""


MAN = with_views("manifest")
RISK_EDGES = f"{MAN}, {knn_sql(chr(34)+'source'+chr(34)+chr(61)+chr(39)+'test'+chr(39), 'label IS NOT NULL', 20)}"
CONFLICT_EDGES = f"{MAN}, {knn_sql(chr(34)+'source'+chr(34)+chr(61)+chr(39)+'extra'+chr(39), 'source<>' + chr(39) + 'extra' + chr(39), 10)}"


def risk_edges(spark, d, k=20):
    m = V.manifest(spark, d)
    refs = m.where("label IS NOT NULL")
    edges = N.cosine_knn(m.where("source = 'test'"), refs, k)
    return N.with_ref_columns(edges, refs, ["label", "source"])


def conflict_edges(spark, d, k=10):
    m = V.manifest(spark, d)
    refs, queries = m.where("source <> 'extra'"), m.where("source = 'extra'")
    edges = N.with_ref_columns(N.cosine_knn(queries, refs, k), refs, ["label", "source"])
    return edges.join(queries.select(F.col("sample_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query("l2_normalise", f"{MAN} SELECT sample_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x*x))),6) AS norm, list_transform(embedding, lambda x: round(x/greatest(sqrt(list_sum(list_transform(embedding, lambda y: y*y))),1e-8),6)) AS unit FROM manifest")
def _(spark, d):
    e = F.col("embedding")
    return V.manifest(spark, d).select(
        "sample_id", F.round(norm(e), 6).alias("norm"), round_half_up(l2_normalise(e), 6).alias("unit")
    )


@query("exact_cosine_knn", f"{RISK_EDGES} SELECT query_id, rank::INT AS rank, ref_id, round(sim,6) AS cosine_sim FROM edges")
def _(spark, d):
    m = V.manifest(spark, d)
    return rnd(N.cosine_knn(m.where("source = 'test'"), m.where("label IS NOT NULL"), 20))


@query(
    "approx_cosine_knn",
    f"""{with_views("manifest")}, q AS (SELECT sample_id AS id, embedding::DOUBLE[] AS v FROM manifest WHERE source='test'),
    r AS (SELECT sample_id AS id, embedding::DOUBLE[] AS v FROM manifest WHERE label IS NOT NULL UNION ALL SELECT id+1000000, v FROM q
      UNION ALL SELECT id+2000000, list_transform(v, lambda x, i: x*(1+0.1e0*(i%3))) FROM q),
    s AS (SELECT q.id AS query_id, r.id AS ref_id, list_dot_product(q.v,r.v)/(sqrt(list_dot_product(q.v,q.v))*sqrt(list_dot_product(r.v,r.v))) AS sim FROM q, r)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(sim,9) DESC, ref_id))::INT AS rank, ref_id, round(sim,6) AS cosine_sim FROM s WHERE sim>=0.95e0
    QUALIFY rank<=10""",
)
def _(spark, d):
    """Exact and slightly bent copies of every query among the references: all of them must be found."""
    m = V.manifest(spark, d)
    q, r = m.where("source = 'test'").select("sample_id", "embedding"), m.where("label IS NOT NULL").select("sample_id", "embedding")
    bent = F.transform("embedding", lambda x, i: x * (1 + 0.1 * ((i + 1) % 3)))
    copies = q.withColumn("sample_id", F.col("sample_id") + 1000000)
    near = q.select((F.col("sample_id") + 2000000).alias("sample_id"), bent.alias("embedding"))
    return rnd(N.approx_knn(q, r.unionByName(copies).unionByName(near), 10, 0.95))


@query(
    "approx_knn_recall",
    f"""{with_views("manifest")}, v AS (SELECT sample_id AS id, embedding::DOUBLE[] AS v FROM manifest),
    s AS (SELECT a.id, round(list_dot_product(a.v,b.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(b.v,b.v))),12) AS sim, b.id AS ref
      FROM v a, v b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, ref)<=10)
    SELECT count(*) AS expected, true AS enough FROM s WHERE sim>=0.7e0""",
)
def _(spark, d):
    """All rows against all rows in cells of 256 rows; at least nine in ten of the exact neighbours are found."""
    m = V.manifest(spark, d).select("sample_id", "embedding")
    exact = N.cosine_knn(m, m, 10).where("cosine_sim >= 0.7")
    found = N.approx_knn(m, m, 10, 0.7, cell_rows=256)
    return N.neighbour_recall(found, exact).select("expected", (F.col("recall") >= 0.9).alias("enough"))


EVIDENCE_COLS = ", ".join(
    [f"round(avg((ref_label=1)::INT) FILTER (rank<={c}),6) AS top{c}_pos_frac" for c in (5, 10, 20)]
    + [
        f"round(avg((ref_label=1)::INT) FILTER (rank<=10 AND ref_source='{s}'),6) AS {s}_top10_pos_frac, count(*) FILTER (rank<=10 AND ref_source='{s}' AND ref_label=0) AS top10_{s}_neg, count(*) FILTER (rank<=10 AND ref_source='{s}' AND ref_label=1) AS top10_{s}_pos"
        for s in ("train", "myval", "extra")
    ]
    + [f"round(avg(sim) FILTER (rank<={c}),6) AS mean_top{c}_sim" for c in (5, 10)]
)
EVIDENCE_SQL = f"""SELECT query_id, round(max(sim) FILTER (rank=1),6) AS top1_sim, max(ref_source) FILTER (rank=1) AS top1_source, max(ref_label) FILTER (rank=1) AS top1_label, {EVIDENCE_COLS} FROM edges GROUP BY query_id"""


@query("neighbour_evidence", f"{RISK_EDGES} {EVIDENCE_SQL}")
def _(spark, d):
    return rnd(N.neighbour_evidence(risk_edges(spark, d), ["train", "myval", "extra"]))


CONFLICT_SQL = """kn AS (SELECT *, CASE WHEN ref_label IS NOT NULL THEN count(ref_label) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) END AS kr FROM edges),
   conf AS (SELECT query_id, max(query_label) AS query_label, round(max(sim) FILTER (rank=1),6) AS top1_sim, max(ref_source) FILTER (rank=1) AS top1_source,
   max(coalesce(ref_label,-1)) FILTER (rank=1) AS top1_label, round(coalesce(avg((ref_label=query_label)::INT) FILTER (kr<=3),0e0),6) AS top3_same_label_frac,
   round(coalesce(avg((ref_label=query_label)::INT) FILTER (kr<=5),0e0),6) AS top5_same_label_frac, round(avg((ref_source='test')::INT) FILTER (rank<=5),6) AS top5_test_frac,
   round(coalesce(avg((ref_label=query_label)::INT) FILTER (kr IS NOT NULL),0e0),6) AS top10_same_label_frac, round(avg((ref_source='test')::INT),6) AS top10_test_frac,
   count(*) FILTER (ref_source='train') AS top10_source_train, count(*) FILTER (ref_source='myval') AS top10_source_myval, count(*) FILTER (ref_source='test') AS top10_source_test,
   count(*) FILTER (ref_label=1) AS top10_source_pos, count(*) FILTER (ref_label=0) AS top10_source_neg,
   round((1-coalesce(avg((ref_label=query_label)::INT) FILTER (kr IS NOT NULL),0e0))*avg(sim)*10,6) AS conflict_score FROM kn GROUP BY query_id)"""


@query("label_conflict_audit", f"{CONFLICT_EDGES}, {CONFLICT_SQL} SELECT * FROM conf")
def _(spark, d):
    return rnd(N.label_conflicts(conflict_edges(spark, d), ["train", "myval", "test"]))


@query(
    "audit_candidates",
    f"""{CONFLICT_EDGES}, {CONFLICT_SQL}, k AS (SELECT * FROM conf WHERE top10_test_frac>=0.1 AND top10_same_label_frac>=0.3 AND conflict_score<=3 AND top1_sim>=0.25)
    SELECT query_id AS sample_id, query_label AS label, conflict_score, round(0.25e0+0.75e0*top10_test_frac,6) AS sample_weight FROM k""",
)
def _(spark, d):
    from sievecrest.plans.manifests import audit_candidates

    conf = rnd(N.label_conflicts(conflict_edges(spark, d), ["train", "myval", "test"]))
    args = [F.col(c) for c in ("top10_test_frac", "top10_same_label_frac", "conflict_score", "top1_sim")]
    flag = candidate_filter((0.1, 0.3, 3.0, 0.25), *args)
    return rnd(audit_candidates(conf, flag))


@query(
    "named_candidate_filters",
    f"""{CONFLICT_EDGES}, {CONFLICT_SQL} SELECT count(*) FILTER (top10_test_frac>=0.2 AND top10_same_label_frac>=0.4 AND conflict_score<=2.5 AND top1_sim>=0.3) AS strict,
     count(*) FILTER (top10_test_frac>=0.1 AND top10_same_label_frac>=0.3 AND conflict_score<=3 AND top1_sim>=0.25) AS medium,
     count(*) FILTER (top10_test_frac>=0.2 AND conflict_score<=4 AND top1_sim>=0.25) AS testprox,
     count(*) FILTER (top10_test_frac>=0.2 AND top10_same_label_frac>=0.8 AND conflict_score<=2 AND top1_sim>=0.75) AS published_strict, count(*) AS rows FROM conf""",
)
def _(spark, d):
    conf = rnd(N.label_conflicts(conflict_edges(spark, d), ["train", "myval", "test"]))
    args = [F.col(c) for c in ("top10_test_frac", "top10_same_label_frac", "conflict_score", "top1_sim")]
    cuts = {"strict": (0.2, 0.4, 2.5, 0.3), "medium": (0.1, 0.3, 3.0, 0.25), "testprox": (0.2, None, 4.0, 0.25), "published_strict": "strict"}
    return conf.agg(*[F.count_if(candidate_filter(c, *args)).alias(k) for k, c in cuts.items()], F.count(F.lit(1)).alias("rows"))


@query(
    "contact_index",
    f"""{RISK_EDGES} SELECT query_id, string_agg(ref_label::VARCHAR, ',' ORDER BY rank) AS top_neighbor_labels, string_agg(ref_source, ',' ORDER BY rank) AS top_neighbor_sources FROM edges WHERE rank<=6 GROUP BY query_id""",
)
def _(spark, d):
    return N.contact_index(risk_edges(spark, d), 6)


ANCHOR = """un AS (SELECT sample_id, source, list_transform(embedding, lambda x: x/greatest(sqrt(list_sum(list_transform(embedding, lambda y: y*y))),1e-8)) AS u FROM manifest),
  ce AS (SELECT list(m ORDER BY p) AS c FROM (SELECT p, avg(x) AS m FROM (SELECT unnest(u) AS x, generate_subscripts(u,1) AS p FROM un WHERE source='test') GROUP BY p))"""


@query("centroid_similarity", f"{MAN}, {ANCHOR} SELECT sample_id, round(list_cosine_similarity(u, c),6) AS centroid_cos FROM un, ce")
def _(spark, d):
    m = V.manifest(spark, d).withColumn("embedding", l2_normalise(F.col("embedding")))
    return rnd(N.centroid_similarity(m, m.where("source = 'test'")).select("sample_id", "centroid_cos"))


@query(
    "test_likeness",
    f"""{MAN}, {knn_sql('true', "source='test'", 10)} SELECT query_id, round(avg(sim),6) AS topk_mean, round(max(sim),6) AS topk_max FROM edges GROUP BY query_id""",
)
def _(spark, d):
    m = V.manifest(spark, d)
    return rnd(N.test_likeness(N.cosine_knn(m, m.where("source = 'test'"), 10), 10))
