"""Split, fold, sample, rebalance and contract-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.operators import checks as C
from sievecrest.operators import splits as SP
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views

DL = with_views("doc_labels")
RN = "row_number() OVER (PARTITION BY quality ORDER BY md5(concat('{s}:',doc_id)), doc_id)"


def split_sql(view: str, idc: str, label: str, seed: int, ratio: str, names=("val", "train"), role="role") -> str:
    return f"""SELECT *, CASE WHEN rn <= CASE WHEN sz>1 THEN least(greatest(1,round_even(sz*{ratio},0)),sz-1) ELSE 0 END
      THEN '{names[0]}' ELSE '{names[1]}' END AS {role} FROM (SELECT *,
      row_number() OVER (PARTITION BY {label} ORDER BY md5(concat('{seed}:',{idc})), {idc}) AS rn,
      count(*) OVER (PARTITION BY {label}) AS sz FROM {view})"""


@query("stratified_split", f"{DL} SELECT doc_id, quality, role FROM ({split_sql('doc_labels','doc_id','quality',42,'0.2e0')})")
def _(spark, d):
    return SP.stratified_split(V.doc_labels(spark, d), "doc_id", "quality", 0.2, 42).select("doc_id", "quality", "role")


@query(
    "stratified_split_events",
    f"{with_views('scored')} SELECT id, label, role FROM ({split_sql('scored','id','label',7,'0.15e0')})",
)
def _(spark, d):
    return SP.stratified_split(V.scored(spark, d), "id", "label", 0.15, 7).select("id", "label", "role")


@query(
    "stratified_subsplit",
    f"""{DL}, val AS (SELECT * EXCLUDE (rn, sz, role) FROM ({split_sql('doc_labels','doc_id','quality',42,'0.2e0')}) WHERE role='val')
    SELECT doc_id, quality, role FROM ({split_sql('val','doc_id','quality',49,'0.5e0',('threshold_search','model_select'))})""",
)
def _(spark, d):
    val = SP.stratified_split(V.doc_labels(spark, d), "doc_id", "quality", 0.2, 42).where("role = 'val'").drop("role")
    return SP.stratified_subsplit(val, "doc_id", "quality", 0.5, 49).select("doc_id", "quality", "role")


@query(
    "stratified_group_split",
    f"""{with_views('scored')}, g AS (SELECT label, grp, count(*) AS n FROM scored GROUP BY ALL),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY md5(concat('11:',grp)), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before,
      greatest(1, round_even(sum(n) OVER (PARTITION BY label)*0.2e0,0)) AS target FROM g)
    SELECT s.id, s.label, s.grp, CASE WHEN before<target THEN 'val' ELSE 'train' END AS role FROM scored s JOIN o USING (label, grp)""",
)
def _(spark, d):
    return SP.stratified_group_split(V.scored(spark, d), "label", "grp", 0.2, 11, strict=True).select("id", "label", "grp", "role")


KF = "(row_number() OVER (PARTITION BY label ORDER BY md5(concat('5:',id)), id)-1)%5+1"


@query("stratified_kfold", f"{with_views('scored')} SELECT id, label, ({KF})::INT AS fold FROM scored")
def _(spark, d):
    return SP.stratified_kfold(V.scored(spark, d), "id", "label", 5, 5).select("id", "label", "fold")


@query(
    "kfold_roles",
    f"""{DL}, k AS (SELECT doc_id, quality AS label, ({KF.replace("id)", "doc_id)").replace(":',id", ":',doc_id").replace(", id", ", doc_id").replace("PARTITION BY label", "PARTITION BY quality")})::INT AS own FROM doc_labels)
    SELECT doc_id, label, f::INT AS fold, CASE WHEN own=f THEN 'val' ELSE 'train' END AS role FROM k, range(1,6) r(f)""",
)
def _(spark, d):
    df = V.doc_labels(spark, d).select("doc_id", F.col("quality").alias("label"))
    return SP.fold_roles(SP.stratified_kfold(df, "doc_id", "label", 5, 5), 5).select("doc_id", "label", "fold", "role")


@query(
    "fold_label_distribution",
    f"""{with_views('scored')}, k AS (SELECT label, ({KF})::INT AS own FROM scored),
    x AS (SELECT f::INT AS fold, CASE WHEN own=f THEN 'val' ELSE 'train' END AS role, label FROM k, range(1,6) r(f))
    SELECT fold, role, label, count(*) AS n, grouping(label)=1 AS is_total FROM x GROUP BY GROUPING SETS ((fold,role,label),(fold,role))""",
)
def _(spark, d):
    return SP.fold_label_distribution(SP.stratified_kfold(V.scored(spark, d), "id", "label", 5, 5), "label", 5)


@query(
    "rebalance_to_ratio",
    f"""{with_views('scored')}, c AS (SELECT count(*) FILTER (label=0) AS neg, count(*) FILTER (label=1) AS pos FROM scored),
    r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('17:',id)), id) AS rn FROM scored)
    SELECT id, label FROM r, c WHERE rn <= CASE WHEN label=1 THEN (CASE WHEN neg/pos::DOUBLE<4.06 THEN greatest(1,round_even(neg/4.06e0,0)) ELSE pos END)
      ELSE (CASE WHEN neg/pos::DOUBLE<4.06 THEN neg ELSE greatest(1,round_even(pos*4.06e0,0)) END) END""",
)
def _(spark, d):
    return SP.rebalance_to_ratio(V.scored(spark, d), "id", "label", 4.06, 17).select("id", "label")


@query(
    "sample_fraction",
    f"""{with_views('scored')} SELECT id, label FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('3:',id)), id) AS rn,
    count(*) OVER () AS n FROM scored) WHERE rn <= round_even(n*0.35e0,0)""",
)
def _(spark, d):
    return SP.sample_fraction(V.scored(spark, d), "id", 0.35, 3).select("id", "label")


@query(
    "sample_rows",
    f"""{with_views('scored')} SELECT id, label FROM scored ORDER BY md5(concat('9:',id)), id LIMIT 250""",
)
def _(spark, d):
    return SP.sample_n(V.scored(spark, d), "id", 250, 9).select("id", "label")


@query(
    "stratified_take",
    f"""{with_views('scored')}, l AS (SELECT greatest(1,count(DISTINCT grp)) AS k FROM scored),
    r AS (SELECT id, grp, prob_pos, row_number() OVER (PARTITION BY grp ORDER BY prob_pos DESC, id) AS rn FROM scored),
    lead AS (SELECT r.* FROM r, l WHERE rn <= greatest(1, 400//k)),
    rest AS (SELECT r.* FROM r, l WHERE rn > greatest(1, 400//k) ORDER BY prob_pos DESC, id LIMIT (SELECT greatest(0, 400-count(*)) FROM lead))
    SELECT id, grp FROM lead UNION ALL SELECT id, grp FROM rest""",
)
def _(spark, d):
    return SP.stratified_take(V.scored(spark, d), "id", "grp", "prob_pos", 400).select("id", "grp")


CST = f"""{with_views('scored')}, s AS (SELECT id, label, prob_pos, grp%40 AS cluster, ((grp%40)*37%41)/41e0 AS frac FROM scored),
    sp AS (SELECT cluster, max(frac) AS frac, count(DISTINCT label) AS labels FROM s GROUP BY cluster),
    q AS (SELECT greatest(4, 400//greatest(1,least(count(*),12))) AS q FROM sp),
    r AS (SELECT s.*, labels, row_number() OVER (PARTITION BY s.cluster, label ORDER BY prob_pos DESC, id) AS rn FROM s JOIN sp USING (cluster)),
    m AS (SELECT r.*, q, (rn <= greatest(1, q//greatest(1,labels)))::INT AS lead FROM r, q),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY lead DESC, prob_pos DESC, id) AS pos, sum(lead) OVER (PARTITION BY cluster) AS leads FROM m),
    t AS (SELECT * FROM p WHERE pos <= greatest(leads, q)),
    v AS (SELECT cluster, coalesce(sum(count(*)) OVER (ORDER BY max(frac) DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM t GROUP BY cluster),
    k AS (SELECT t.id, t.label, t.cluster FROM t JOIN v USING (cluster) WHERE before < 400 AND before+pos <= 400),
    f AS (SELECT id, label, cluster FROM s WHERE id NOT IN (SELECT id FROM k) ORDER BY prob_pos DESC, id LIMIT (SELECT greatest(0,400-count(*)) FROM k))
    SELECT id, label, cluster FROM k UNION ALL SELECT * FROM f"""


@query("cluster_stratified_take", CST)
def _(spark, d):
    df = V.scored(spark, d).withColumn("cluster", F.col("grp") % 40).withColumn("frac", (F.col("grp") % 40) * 37 % 41 / F.lit(41.0))
    return SP.cluster_stratified_take(df, "id", "label", "prob_pos", "cluster", "frac", 400).select("id", "label", "cluster")


@query(
    "keep_first_per_key",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
    ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn=1""",
)
def _(spark, d):
    df = V.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return SP.keep_first(df, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"])


# ---- contract checks ----------------------------------------------------------------------


@query(
    "duplicate_id_check",
    """WITH g AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*)>1)
    SELECT count(*) AS duplicate_ids, sum(n)::BIGINT AS rows, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM g ORDER BY id LIMIT 5)) AS examples FROM g""",
)
def _(spark, d):
    return C.duplicate_report(V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))


@query(
    "id_set_equality",
    """WITH a AS (SELECT DISTINCT doc_id AS id FROM documents), b AS (SELECT DISTINCT doc_id+3 AS id FROM labels),
    m AS (SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)), e AS (SELECT id FROM b WHERE id NOT IN (SELECT id FROM a))
    SELECT (SELECT count(*) FROM a JOIN b USING (id)) AS shared, (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM e) AS extra,
    (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM m ORDER BY id LIMIT 5)) AS missing_examples,
    coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM e ORDER BY id LIMIT 5)),'') AS extra_examples""",
)
def _(spark, d):
    a = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    b = V.table(spark, d, "labels").select((F.col("doc_id") + 3).alias("id"))
    return C.id_set_report(a, b)


@query(
    "complete_join_check",
    """SELECT count(*) AS base_rows, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS joined_rows,
    count(*) = (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS complete FROM documents""",
)
def _(spark, d):
    return C.complete_join_report(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), "doc_id")


@query(
    "label_check",
    """SELECT count(DISTINCT q) AS classes, count(*) FILTER (q IS NULL) AS missing_labels,
    count(*) FILTER (q NOT IN (0,1)) AS unknown_labels, count(*) FILTER (q=0) AS label_0, count(*) FILTER (q=1) AS label_1,
    count(*) FILTER (q NOT IN (0,1))=0 AND least(count(*) FILTER (q=0), count(*) FILTER (q=1))>0 AS usable
    FROM (SELECT quality AS q FROM documents LEFT JOIN labels USING (doc_id))""",
)
def _(spark, d):
    joined = V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left")
    return C.label_report(joined, "quality")


@query(
    "missing_asset_check",
    """WITH m AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT count(*) AS missing, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM m ORDER BY 1 LIMIT 5)) AS examples FROM m""",
)
def _(spark, d):
    return C.missing_assets(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), "doc_id")


@query(
    "null_value_check",
    """SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS quality_nulls, count(*) FILTER (lang IS NULL) AS lang_nulls
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, d):
    joined = V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id", "left")
    return C.null_report(joined, ["quality", "lang"])
