"""Identifier, URL, filter and rule-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions import keys as K
from sievecrest.functions import risk as R
from sievecrest.functions import urls as U
from sievecrest.operators import filters as FL
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views


@query(
    "normalize_id",
    """SELECT p, printf('%06d.jpg', regexp_extract(p, '([0-9]+)_mask', 1)::INT) AS norm, regexp_extract(p,'([0-9]+)_mask',1)::INT AS number,
    regexp_extract(p,'([0-9]+)_mask',1)::INT AS first_run FROM (SELECT concat('crops/', o_orderkey, '_mask_000.png') AS p FROM orders)""",
)
def _(spark, d):
    p = F.concat(F.lit("crops/"), F.col("o_orderkey"), F.lit("_mask_000.png"))
    return V.table(spark, d, "orders").select(p.alias("p")).select(
        "p", K.normalize_id(F.col("p")).alias("norm"), K.id_number(F.col("p")).alias("number"), K.first_number(F.col("p")).alias("first_run")
    )


@query(
    "extract_number",
    """SELECT p_name, p_partkey, CASE WHEN regexp_replace(s,'[^0-9]','','g')='' THEN ''
     ELSE (regexp_replace(s,'[^0-9]','','g')::HUGEINT)::VARCHAR END AS digits FROM
     (SELECT p_name, p_partkey, concat(p_name, '_00', CASE WHEN p_partkey%3=0 THEN '' ELSE p_partkey::VARCHAR END) AS s FROM part)""",
)
def _(spark, d):
    s = F.concat(
        F.col("p_name"), F.lit("_00"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_partkey").cast("string")), F.lit(".png")
    )
    return V.table(spark, d, "part").select("p_name", "p_partkey", K.extract_number(s).alias("digits"))


@query(
    "mask_name_parse",
    """SELECT name, CASE WHEN regexp_matches(name,'^\\d{6}_mask_\\d+\\.png$') THEN left(name,6) END AS base, split_part(name,'_mask_',1) AS stem
    FROM (SELECT printf('%0'||(CASE WHEN l_orderkey%4=0 THEN '5' ELSE '6' END)||'d', l_orderkey::INT) || '_mask_' || printf('%03d', l_linenumber) || '.png' AS name FROM lineitem)""",
)
def _(spark, d):
    width = F.when(F.col("l_orderkey") % 4 == 0, F.format_string("%05d", "l_orderkey")).otherwise(F.format_string("%06d", "l_orderkey"))
    name = F.concat(width, F.lit("_mask_"), F.format_string("%03d", "l_linenumber"), F.lit(".png"))
    return V.table(spark, d, "lineitem").select(name.alias("name")).select(
        "name", K.mask_base(F.col("name")).alias("base"), K.mask_stem(F.col("name")).alias("stem")
    )


NAMES_SQL = """names AS (SELECT id, CASE id%4 WHEN 0 THEN concat('rock_', grp, '_', md5(id::VARCHAR), '.png')
   WHEN 1 THEN concat('rock_', grp, '_x', id, '.jpg') WHEN 2 THEN concat('plain', id, '.png') ELSE concat('rock_', md5(id::VARCHAR), '.jpeg') END AS name FROM scored)"""


def _names(spark, d):
    h = F.md5(F.col("id").cast("string"))
    m = F.col("id") % 4
    name = (
        F.when(m == 0, F.concat(F.lit("rock_"), "grp", F.lit("_"), h, F.lit(".png")))
        .when(m == 1, F.concat(F.lit("rock_"), "grp", F.lit("_x"), "id", F.lit(".jpg")))
        .when(m == 2, F.concat(F.lit("plain"), "id", F.lit(".png")))
        .otherwise(F.concat(F.lit("rock_"), h, F.lit(".jpeg")))
    )
    return V.scored(spark, d).select("id", name.alias("name"))


@query(
    "infer_group",
    f"""{with_views('scored')}, {NAMES_SQL}, p AS (SELECT id, name, regexp_replace(name,'\\.[^.]+$','') AS st FROM names),
    q AS (SELECT *, string_split(st,'_') AS parts FROM p),
    r AS (SELECT *, CASE WHEN regexp_matches(parts[-1],'^[0-9a-fA-F]{{8,}}$') THEN parts[2:-2] ELSE parts[2:] END AS pay FROM q)
    SELECT id, CASE WHEN len(parts)<2 THEN st ELSE coalesce(nullif(pay[1],''), st) END AS grp_name FROM r""",
)
def _(spark, d):
    return _names(spark, d).select("id", K.infer_group(F.col("name")).alias("grp_name"))


@query(
    "safe_output_name",
    """SELECT page_id, concat('page_', regexp_replace(regexp_replace(regexp_extract(url,'([^/]*)$',1),'^(.+)\\.[^.]+$','\\1'),'[^\\p{L}\\p{N}._-]','_','g'),
     '_', left(sha1(url),8), '.png') AS name FROM pages""",
)
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", K.safe_output_name(F.lit("page"), F.col("url")).alias("name"))


@query(
    "label_index",
    """SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang)-1)::INT AS label_idx FROM documents""",
)
def _(spark, d):
    from sievecrest.operators.labels import with_label_index

    return with_label_index(V.table(spark, d, "documents").select("doc_id", "lang"), "lang", expected=None)


@query(
    "target_size",
    """WITH s0 AS (SELECT l_orderkey, l_linenumber, greatest(1,l_partkey)::INT AS w, greatest(1,l_suppkey*7+l_linenumber)::INT AS h FROM lineitem),
    s1 AS (SELECT *, greatest(w,h) AS e FROM s0),
    s2 AS (SELECT l_orderkey, l_linenumber, CASE WHEN e>1280 THEN greatest(1,round_even(w*(1280e0/e),0))::INT ELSE w END AS w,
       CASE WHEN e>1280 THEN greatest(1,round_even(h*(1280e0/e),0))::INT ELSE h END AS h FROM s1),
    s3 AS (SELECT *, w::BIGINT*h AS a FROM s2),
    s4 AS (SELECT l_orderkey, l_linenumber, CASE WHEN a>400000 THEN greatest(1,round_even(w*sqrt(400000e0/a),0))::INT ELSE w END AS w,
       CASE WHEN a>400000 THEN greatest(1,round_even(h*sqrt(400000e0/a),0))::INT ELSE h END AS h FROM s3),
    s5 AS (SELECT *, least(w,h) AS m FROM s4)
    SELECT l_orderkey, l_linenumber, CASE WHEN m<32 THEN greatest(1,round_even(w*(32e0/m),0))::INT ELSE w END AS w,
       CASE WHEN m<32 THEN greatest(1,round_even(h*(32e0/m),0))::INT ELSE h END AS h FROM s5""",
)
def _(spark, d):
    size = K.target_size(F.col("l_partkey"), F.col("l_suppkey") * 7 + F.col("l_linenumber"), 1280, 400_000, 32)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(
    "safe_names",
    """SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(t,'[\\\\/:*?"<>|]+','_','g'),'[ \\t\\n\\r\\f\\x0B]+',' ','g')),180),''),'item') AS name
    FROM (SELECT doc_id, text AS t FROM documents)""",
)
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", U.safe_name(F.col("text")).alias("name"))


@query(
    "content_images",
    f"""{with_views('scored')}, {NAMES_SQL}, i AS (SELECT id, concat('http://x.example.com/', CASE WHEN id%11=0 THEN 'logo-' ELSE '' END, name, CASE WHEN id%5=0 THEN '?v=1' ELSE '' END) AS src,
    (id%120)::INT AS w, (id%90)::INT AS h FROM names)
    SELECT id, src FROM i WHERE NOT regexp_matches(lower(src),'(ajax-loader|loader|spinner|logo|icon|flag|sprite|bullet|menu|arrow)')
     AND regexp_matches(regexp_replace(lower(src),'[?#].*$',''),'\\.(jpg|jpeg|png|webp)$') AND NOT ((w>0 OR h>0) AND w<80 AND h<80)""",
)
def _(spark, d):
    src = F.concat(
        F.lit("http://x.example.com/"), F.when(F.col("id") % 11 == 0, "logo-").otherwise(""), "name",
        F.when(F.col("id") % 5 == 0, "?v=1").otherwise(""),
    )
    df = _names(spark, d).select("id", src.alias("src"), (F.col("id") % 120).alias("w"), (F.col("id") % 90).alias("h"))
    return df.where(U.is_content_image(F.col("src"), F.col("w"), F.col("h"))).select("id", "src")


@query(
    "label_source_display",
    """SELECT doc_id, length(p)>0 AS has_image, CASE WHEN length(p)>0 THEN 'mask' WHEN doc_id%3=1 THEN 'nomask' ELSE 'missing' END AS mask_status
    FROM (SELECT doc_id, CASE WHEN doc_id%3=0 THEN concat('crop/',doc_id,'.png') ELSE '' END AS p FROM documents)""",
)
def _(spark, d):
    from sievecrest.operators.labels import asset_flags

    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("crop/"), "doc_id", F.lit(".png"))).otherwise("")
    df = V.table(spark, d, "documents").select("doc_id", p.alias("path"), (F.col("doc_id") % 3 == 1).alias("marker"))
    return asset_flags(df, "path", "marker").select("doc_id", "has_image", "mask_status")


# ---- filters ------------------------------------------------------------------------------

SKIPS = "skips AS (SELECT DISTINCT doc_id*2 AS doc_id FROM labels)"


def _skips(spark, d):
    return V.table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"))


@query("skip_listed_ids", f"WITH {SKIPS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM skips)")
def _(spark, d):
    return FL.skip_ids(V.table(spark, d, "documents").select("doc_id", "lang"), _skips(spark, d), "doc_id")


@query(
    "skip_report",
    f"""WITH {SKIPS}, u AS (SELECT doc_id FROM skips WHERE doc_id NOT IN (SELECT doc_id FROM documents))
    SELECT (SELECT count(*) FROM skips) AS requested, (SELECT count(*) FROM skips)-(SELECT count(*) FROM u) AS matched,
    (SELECT count(*) FROM u) AS unmatched, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM skips)) AS remaining,
    (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM u ORDER BY 1 LIMIT 10)) AS unmatched_examples""",
)
def _(spark, d):
    return FL.skip_report(V.table(spark, d, "documents").select("doc_id"), _skips(spark, d), "doc_id")


@query(
    "duplicate_name_report",
    """WITH n AS (SELECT concat('u', user_id, '.png') AS name FROM events), s AS (SELECT DISTINCT concat('u', user_id, '.png') AS name FROM events WHERE user_id%7=0),
    g AS (SELECT name, count(*) AS c FROM n GROUP BY 1), k AS (SELECT * FROM g WHERE name NOT IN (SELECT name FROM s))
    SELECT (SELECT sum(c)::BIGINT FROM k) AS kept, coalesce((SELECT sum(c)::BIGINT FROM g WHERE name IN (SELECT name FROM s)),0)::BIGINT AS skipped,
    (SELECT count(*) FROM k WHERE c>1) AS duplicate_names, (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM k WHERE c>1 ORDER BY name LIMIT 10)) AS duplicate_examples""",
)
def _(spark, d):
    ev = V.table(spark, d, "events")
    name = F.concat(F.lit("u"), "user_id", F.lit(".png")).alias("name")
    return FL.duplicate_name_report(ev.select(name), "name", ev.where(F.col("user_id") % 7 == 0).select(name))


@query(
    "mask_quality_counts",
    """WITH m AS (SELECT l_discount/10 AS ratio, l_linenumber>1 AS has_mask FROM lineitem)
    SELECT CASE WHEN NOT has_mask THEN 'no_mask' WHEN ratio<0.005 THEN 'small' ELSE 'keep' END AS reason, count(*) AS n FROM m GROUP BY 1""",
)
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    reason = FL.mask_quality(F.col("l_discount") / 10, F.col("l_linenumber") > 1)
    return li.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("labelled_source_rows", f"{with_views('manifest')} SELECT sample_id, label FROM manifest WHERE source='myval' AND label IS NOT NULL")
def _(spark, d):
    return FL.labelled_source(V.manifest(spark, d), "myval").select("sample_id", "label")


@query(
    "pseudo_labels",
    f"""{with_views('scored')} SELECT id, (prob_pos>=0.5)::INT AS label, (prob_pos>=0.5)::INT AS label_idx, round(prob_pos,6) AS prob_pos_corrected,
    round(CASE WHEN prob_pos>=0.5 THEN prob_pos ELSE 1-prob_pos END,6) AS pseudo_confidence, 'pseudo' AS source
    FROM scored WHERE CASE WHEN prob_pos>=0.5 THEN prob_pos ELSE 1-prob_pos END >= 0.9""",
)
def _(spark, d):
    df = V.scored(spark, d).select("id", F.col("prob_pos").alias("prob_pos_corrected"))
    out = FL.pseudo_labels(df, 0.9)
    return out.withColumn("prob_pos_corrected", F.round("prob_pos_corrected", 6)).withColumn(
        "pseudo_confidence", F.round("pseudo_confidence", 6)
    )


@query(
    "gate_saturation",
    f"""{with_views('scored')}, r AS (SELECT grp AS run, max(prob_pos) AS cluster, quantile_cont(prob_pos,0.995) AS top FROM scored GROUP BY 1)
    SELECT count(*) AS runs, count(*) FILTER (cluster>=0.99 AND top>=0.98) AS passing, count(*) FILTER (cluster>=0.996 AND top>=0.99) AS saturated FROM r""",
)
def _(spark, d):
    from sievecrest.operators.metrics import exact_percentiles

    sc = V.scored(spark, d)
    runs = sc.groupBy("grp").agg(F.max("prob_pos").alias("cluster")).join(exact_percentiles(sc, "prob_pos", [0.995], ["grp"], ["top"]), "grp")
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(R.gate(F.col("cluster"), F.col("top"), 0.99, 0.98)).alias("passing"),
        F.count_if(R.gate(F.col("cluster"), F.col("top"), 0.996, 0.99)).alias("saturated"),
    )


# ---- scores and tiers over a feature-shaped view --------------------------------------------

FEAT_SQL = """feat AS (SELECT id, prob_pos, CASE WHEN id%9<>0 THEN (id%6)/5e0 END AS top5, (id%11)/10e0 AS top10,
   CASE WHEN id%4<>0 THEN (id%8)/7e0 END AS train10, CASE WHEN id%3=0 THEN (id%5)/4e0 END AS myval10,
   CASE WHEN id%5=0 THEN (id%3)/2e0 END AS extra10, CASE WHEN id%7<>0 THEN (id%7)/6e0 END AS alt,
   CASE WHEN id%6<>0 THEN (id%2)::INT END AS second, label,
   CASE WHEN id%50=0 THEN 'inferred_fp' WHEN id%50=1 THEN 'one_of_three_fp' ELSE '' END AS weak FROM scored),
  f2 AS (SELECT *, coalesce(top5,top10,0.5e0) AS t5, coalesce(train10,top10,0.5e0) AS tr, coalesce(myval10,top10,0.5e0) AS mv,
   0.30e0*(1-coalesce(top5,top10,0.5e0))+0.25e0*(1-coalesce(train10,top10,0.5e0))+0.15e0*(1-coalesce(myval10,top10,0.5e0))
   +0.10e0*(1-coalesce(extra10,0.5e0))+0.10e0*(1-2*abs(prob_pos-0.5e0))+0.10e0*(CASE WHEN coalesce(second,0)=0 THEN 1 ELSE 0 END) AS raw FROM feat),
  f3 AS (SELECT *, round(CASE WHEN label=0 THEN raw*0.25e0 ELSE raw END,6) AS risk FROM f2),
  f4 AS (SELECT *, round(0.35e0*risk+0.25e0*(1-coalesce(top5,0.5e0))+0.20e0*(1-tr)+0.10e0*(1-coalesce(alt,0.5e0))+0.10e0*(1-2*abs(prob_pos-0.5e0)),6) AS verifier FROM f3)"""
FEAT = f"{with_views('scored')}, {FEAT_SQL}"


def _feat(spark, d):
    i = F.col("id")

    def frac(m):
        return i % m / F.lit(float(m - 1))

    df = V.scored(spark, d).select(
        "id", "prob_pos", "label",
        F.when(i % 9 != 0, frac(6)).alias("top5"), frac(11).alias("top10"), F.when(i % 4 != 0, frac(8)).alias("train10"),
        F.when(i % 3 == 0, frac(5)).alias("myval10"), F.when(i % 5 == 0, frac(3)).alias("extra10"),
        F.when(i % 7 != 0, frac(7)).alias("alt"), F.when(i % 6 != 0, (i % 2).cast("int")).alias("second"),
        F.when(i % 50 == 0, "inferred_fp").when(i % 50 == 1, "one_of_three_fp").otherwise("").alias("weak"),
    )
    c = F.col
    df = df.withColumn("risk", F.round(R.fp_risk_score(c("top5"), c("top10"), c("train10"), c("myval10"), c("extra10"), c("prob_pos"), c("label"), c("second")), 6))
    return df.withColumn("verifier", F.round(R.verifier_fp_score(c("risk"), c("top5"), c("train10"), c("top10"), c("alt"), c("prob_pos")), 6))


@query("risk_scores", f"{FEAT} SELECT id, risk, verifier FROM f4")
def _(spark, d):
    return _feat(spark, d).select("id", "risk", "verifier")


RANKS_SQL = """rk AS (SELECT *, (rank() OVER (ORDER BY risk)+(count(*) OVER (PARTITION BY risk)-1)/2e0)/count(*) OVER () AS rr,
   (rank() OVER (ORDER BY verifier)+(count(*) OVER (PARTITION BY verifier)-1)/2e0)/count(*) OVER () AS rv FROM f4),
  cs AS (SELECT *, round(0.28e0*rr+0.22e0*rv+0.25e0*(0.5e0*(1-coalesce(top5,0.5e0))+0.3e0*(1-tr)+0.2e0*(1-top10))
   +0.15e0*(1-coalesce(alt,0.5e0))+0.10e0*(1-2*abs(prob_pos-0.5e0)),6) AS consensus FROM rk)"""
TIER_SQL = """CASE WHEN weak='inferred_fp' THEN 'A_lb_inferred' WHEN consensus>=0.82 AND top5<=0 AND alt<=0.35 AND weak<>'one_of_three_fp' THEN 'B_consensus_untested'
   WHEN weak='one_of_three_fp' THEN 'C_unresolved_one_of_three' WHEN consensus>=0.72 THEN 'D_review_only' ELSE 'E_low_priority' END"""


@query("consensus_tiers", f"{FEAT}, {RANKS_SQL} SELECT id, consensus, {TIER_SQL} AS tier FROM cs")
def _(spark, d):
    from sievecrest.plans.audits import consensus_scores

    df = _feat(spark, d)
    out = consensus_scores(df, "risk", "verifier", "top5", "train10", "top10", "alt", "prob_pos", digits=6)
    return out.withColumn("tier", R.assign_tier(F.col("consensus"), F.col("weak"), F.col("top5"), F.col("alt"))).select("id", "consensus", "tier")


@query(
    "embedding_consensus",
    f"""{FEAT} SELECT id, round(((1-coalesce(train10,0.5e0))+(1-coalesce(alt,0.5e0)))/2,6) AS two_way,
    round(((1-coalesce(top5,0.5e0))+(1-coalesce(train10,0.5e0))+(1-coalesce(alt,0.5e0)))/3,6) AS three_way,
    coalesce(top5<=0.2 AND train10<=0.2 AND alt<=0.2,false) AS strong_negative,
    coalesce((train10>=0.6 AND top5<=0.2) OR (train10<=0.2 AND top5>=0.6),false) AS disagrees,
    CASE WHEN weak='one_of_three_fp' AND alt<0.6 AND train10<=0.2 THEN 'unresolved_group_mixed_vlm' WHEN weak='one_of_three_fp' AND alt>=0.6 THEN 'unresolved_group_clip_positive'
     WHEN weak='inferred_fp' AND ((1-coalesce(top5,0.5e0))+(1-coalesce(train10,0.5e0))+(1-coalesce(alt,0.5e0)))/3>=0.85 THEN 'lb_inferred_fp_and_embedding_negative' ELSE '' END AS note FROM f4""",
)
def _(spark, d):
    c = F.col
    three = R.negative_consensus(c("top5"), c("train10"), c("alt"))
    return _feat(spark, d).select(
        "id",
        F.round(R.negative_consensus(c("train10"), c("alt")), 6).alias("two_way"),
        F.round(three, 6).alias("three_way"),
        R.strong_negative(c("top5"), c("train10"), c("alt")).alias("strong_negative"),
        R.embeddings_disagree(c("train10"), c("top5")).alias("disagrees"),
        R.consensus_note(c("weak"), three, c("train10"), c("alt")).alias("note"),
    )


@query(
    "range_weights",
    f"""{with_views('scored')} SELECT id, round(0.25e0+0.75e0*(prob_pos-min(prob_pos) OVER ())/greatest(max(prob_pos) OVER ()-min(prob_pos) OVER (),1e-8),6) AS sample_weight FROM scored""",
)
def _(spark, d):
    from sievecrest.operators.labels import minmax_weight

    out = minmax_weight(V.scored(spark, d), "prob_pos")
    return out.select("id", F.round("sample_weight", 6).alias("sample_weight"))


@query(
    "risk_flag_strings",
    """SELECT o_orderkey AS run, concat(CASE WHEN o_orderpriority LIKE '1%' THEN 'mytest_supervised;' ELSE '' END,
    CASE WHEN coalesce(df,0)>30 THEN 'large_submission_diff;' ELSE '' END,
    CASE WHEN coalesce(pos,128)<110 OR coalesce(pos,128)>145 THEN 'pos_count_far;' ELSE '' END) AS flags
    FROM (SELECT *, CASE WHEN o_orderkey%4<>0 THEN o_custkey%60 END AS df, CASE WHEN o_orderkey%5<>0 THEN 90+o_custkey%80 END AS pos FROM orders)""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        k.alias("run"),
        R.risk_flags(
            F.col("o_orderpriority").startswith("1"),
            F.when(k % 4 != 0, F.col("o_custkey") % 60),
            F.when(k % 5 != 0, 90 + F.col("o_custkey") % 80),
        ).alias("flags"),
    )


@query(
    "two_model_flip",
    f"""{with_views('scored')}, m AS (SELECT id, CASE WHEN id%3=0 THEN 1 ELSE 0 END AS label0, prob_pos AS a, ((id*7921+13)%1001)/1001e0 AS b FROM scored)
    SELECT id, CASE WHEN label0=1 AND a<0.25 AND b<0.35 AND (a+b)/2<0.25 THEN 0 WHEN label0=0 AND a>0.65 AND b>0.6 AND (a+b)/2>0.55 THEN 1 ELSE label0 END AS label FROM m""",
)
def _(spark, d):
    a, b = F.col("prob_pos"), (F.col("id") * 7921 + 13) % 1001 / F.lit(1001.0)
    return V.scored(spark, d).select(
        "id", R.agreement_flip(F.when(F.col("id") % 3 == 0, 1).otherwise(0), a, b, (a + b) / 2).alias("label")
    )
