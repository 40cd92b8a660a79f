"""Text-line, keyword, web-page and run-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecrest.catalog.base import query
from sievecrest.functions import text as TX
from sievecrest.operators import ledger as L
from sievecrest.operators import pages as PG
from sievecrest.operators import textlines as TL
from sievecrest.plans import views as V
from sievecrest.plans.views import with_views

TXT = with_views("texts")
NORM = "lower(regexp_replace(text,'[\\s|\\-_/\\\\\\x0B]+','','g'))"


@query("normalize_text", f"{TXT} SELECT doc_id, line_no, md5({NORM}) AS norm FROM texts")
def _(spark, d):
    return V.texts(spark, d).select("doc_id", "line_no", F.md5(TX.normalize_text(F.col("text"))).alias("norm"))


@query("keyword_detection", f"{TXT} SELECT DISTINCT doc_id FROM texts WHERE score>=0.4 AND (contains({NORM},'themention') OR contains({NORM},'pourla') OR contains({NORM},'withand'))")
def _(spark, d):
    return TL.keyword_images(V.texts(spark, d), "doc_id", TX.parse_keywords("the-mention, Pour la,with_and"), 0.4)


LINES = f"""{TXT}, k AS (SELECT doc_id, line_no, trim(text) AS t FROM texts WHERE score>=0.5)"""


@query(
    "lines_to_text",
    f"{LINES} SELECT doc_id, md5('['||string_agg(t, chr(10) ORDER BY line_no)||']') AS cap, count(*) AS n FROM k WHERE t<>'' GROUP BY doc_id",
)
def _(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), ((F.col("doc_id") * 31 + i) % 100 / F.lit(100.0)).alias("score")))
    from sievecrest.operators.filters import keep_lines

    docs = V.table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    out = docs.select("doc_id", F.md5(TX.bracketed(TX.lines_to_text(F.col("lines"), 0.5))).alias("cap"), F.size(keep_lines(F.col("lines"), 0.5)).cast("bigint").alias("n"))
    return out.where(F.col("cap").isNotNull())


@query(
    "keyword_weak_labels",
    """WITH w AS (SELECT * FROM (VALUES ('the ',1),('ment',1),('tion',1),('und',0),('que',0)) v(keyword,label))
    SELECT doc_id, keyword, label FROM documents, w WHERE contains(text, keyword)""",
)
def _(spark, d):
    return TL.keyword_labels(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["the ", "ment", "tion"], ["und", "que"])


OPENINGS = """k AS (SELECT array_to_string(string_split(text,' ')[1:2],' ') AS keyword, min(item_id)%2 AS label FROM benchmark GROUP BY 1)"""


def _openings(spark, d):
    """The first two words of every benchmark item, with a label."""
    words = F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("keyword")
    return V.table(spark, d, "benchmark").groupBy(words).agg((F.min("item_id") % 2).alias("label"))


@query("keyword_table_labels", f"WITH {OPENINGS} SELECT doc_id, keyword, label FROM documents, k WHERE contains(text, keyword)")
def _(spark, d):
    return TL.table_keyword_labels(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _openings(spark, d))


@query(
    "keyword_table_detection",
    f"{TXT}, {OPENINGS} SELECT DISTINCT doc_id FROM texts, (SELECT lower(regexp_replace(keyword,'[\\s|\\-_/\\\\]+','','g')) AS w FROM k) WHERE score>=0.4 AND w<>'' AND contains({NORM},w)",
)
def _(spark, d):
    return TL.table_keyword_images(V.texts(spark, d), "doc_id", _openings(spark, d), 0.4)


@query(
    "keyword_label_conflicts",
    """WITH w AS (SELECT * FROM (VALUES ('the ',1),('ment',1),('tion',1),('und',0),('que',0)) v(keyword,label)), h AS (SELECT doc_id, label FROM documents, w WHERE contains(text, keyword))
    SELECT doc_id, count(*) AS hits, count(*) FILTER (label=1) AS pos_hits, count(DISTINCT label)>1 AS conflict FROM h GROUP BY 1""",
)
def _(spark, d):
    hits = TL.keyword_labels(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["the ", "ment", "tion"], ["und", "que"])
    return TL.label_conflicts(hits, "doc_id")


@query(
    "line_score_filter",
    f"""{TXT} SELECT doc_id, count(*) AS kept, sum(length(trim(text)))::BIGINT AS chars FROM texts WHERE score>=0.3 AND trim(text)<>'' GROUP BY 1""",
)
def _(spark, d):
    from sievecrest.operators.filters import keep_lines

    lines = V.texts(spark, d).select("doc_id", F.explode(keep_lines(F.array(F.struct("text", "score")), 0.3)).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("l.text")).alias("chars"))


# ---- pages --------------------------------------------------------------------------------

ENC = """array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN regexp_full_match(c, '[!#-;=?-_a-z|~%&\\[\\]\\\\^]') THEN c ELSE url_encode(c) END), '')"""
LINK_SQL = f"""anc AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs,
   regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts FROM pages),
  fl AS (SELECT page_id, url, unnest(hs) AS h, unnest(ts) AS t, generate_subscripts(hs,1)-1 AS pos FROM anc),
  links AS (SELECT page_id, pos::INT AS pos, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t,'(?s)<[^>]*>','','g'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&'),'\\s+',' ','g')) AS text,
   CASE WHEN regexp_matches(trim(h),'^[A-Za-z][A-Za-z0-9+.-]*:') THEN trim(h) WHEN trim(h) LIKE '/%' THEN concat(regexp_extract(url,'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)',1), {ENC.format(x="replace(trim(h),'&amp;','&')")})
    ELSE concat('?', h) END AS href FROM fl)"""


@query("page_links", f"WITH {LINK_SQL} SELECT page_id, pos, text, href FROM links")
def _(spark, d):
    return PG.page_links(V.table(spark, d, "pages"))


@query(
    "page_link_classes",
    f"""WITH {LINK_SQL}, k AS (SELECT page_id, pos, text, href, CASE WHEN regexp_matches(href,'(?i)/th[a-z]+$') THEN 'item' WHEN regexp_matches(href,'(?i)/(de|la|le|of)') THEN 'collection' WHEN regexp_matches(href,'/[a-z]$|/[a-z][a-z]$') THEN 'pagination' END AS kind FROM links)
    SELECT page_id, kind, href, arg_min(text, pos) AS text FROM k WHERE kind IS NOT NULL GROUP BY page_id, kind, href""",
)
def _(spark, d):
    rules = {"item": "(?i)/th[a-z]+$", "collection": "(?i)/(de|la|le|of)", "pagination": "/[a-z]$|/[a-z][a-z]$"}
    return PG.classify_links(PG.page_links(V.table(spark, d, "pages")), rules)


@query(
    "page_heads",
    """WITH c AS (SELECT page_id, regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1) AS t, regexp_extract(html,'(?is)<h1[^>]*>(.*?)</h1>',1) AS h1, regexp_extract(html,'(?is)<h2[^>]*>(.*?)</h2>',1) AS h2,
     regexp_replace(regexp_replace(regexp_extract(html,'(?is)<body[^>]*>(.*)</body>',1),'(?is)<(script|style)[^>]*>.*?</(script|style)>','','g'),'(?s)<!--.*?-->','','g') AS b FROM pages),
    p AS (SELECT page_id, """
    + ", ".join(
        f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({c},'(?s)<[^>]*>','','g'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&'),'\\s+',' ','g')) AS {c}"
        for c in ("t", "h1", "h2", "b")
    )
    + """ FROM c) SELECT page_id, t AS title, CASE WHEN h1<>'' THEN h1 ELSE h2 END AS heading, md5(b) AS body FROM p""",
)
def _(spark, d):
    return PG.page_heads(V.table(spark, d, "pages")).select("page_id", "title", "heading", F.md5("text").alias("body"))


@query(
    "crawl_frontier",
    f"""WITH {LINK_SQL}, v AS (SELECT DISTINCT href FROM links WHERE page_id%3=0), n AS (SELECT DISTINCT href FROM links WHERE href NOT IN (SELECT href FROM v) ORDER BY href LIMIT 200)
    SELECT href, CASE WHEN regexp_extract(href,'(?i)id=(\\d+)',1)<>'' THEN regexp_extract(href,'(?i)id=(\\d+)',1)
      ELSE left(trim(regexp_replace(regexp_replace(href,'[\\\\/:*?"<>|]+','_','g'),'\\s+',' ','g')),180) END AS item FROM n""",
)
def _(spark, d):
    links = PG.page_links(V.table(spark, d, "pages"))
    out = PG.frontier(links, links.where(F.col("page_id") % 3 == 0), 200)
    return out.select("href", PG.item_id(F.col("href"), F.col("href")).alias("item"))


ORIGIN = "regexp_extract(url,'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)',1)"
IMAGE_SQL = f"""imgs AS (SELECT page_id, 0 AS pos, {ORIGIN}||'/img/'||(page_id%97)||'.jpg?s=1' AS src, 'Picture '||page_id AS alt, (page_id%300)::INT AS width, 90 AS height FROM pages
  UNION ALL SELECT page_id, 1, 'https://cdn.example.org/logo.png', '', 0, 0 FROM pages WHERE page_id%2=0)"""


def _pages_with_images(spark, d):
    """The pages with image tags made of their own columns before the end."""
    p = F.col("page_id")
    photo = F.format_string('<IMG class="x"\n src="/img/%d.jpg?s=1" alt=\'Picture %d\' width="%dpx" height="90">', p % 97, p, p % 300)
    logo = F.when(p % 2 == 0, '<img src="https://cdn.example.org/logo.png"/><img alt="no source">').otherwise("")
    return V.table(spark, d, "pages").withColumn("html", F.concat("html", photo, logo))


@query("page_images", f"WITH {IMAGE_SQL} SELECT page_id, pos, src, alt, width, height FROM imgs")
def _(spark, d):
    return PG.page_images(_pages_with_images(spark, d))


@query(
    "crawl_summary",
    f"""WITH {LINK_SQL}, {IMAGE_SQL}, n AS (SELECT (SELECT count(*) FROM pages) AS page_count, (SELECT count(DISTINCT href) FROM links) AS item_count, (SELECT count(DISTINCT src) FROM imgs) AS image_count)
    SELECT *, concat('{{"page_count":',page_count,',"item_count":',item_count,',"image_count":',image_count,'}}') AS summary FROM n""",
)
def _(spark, d):
    pages = _pages_with_images(spark, d)
    items = PG.page_links(pages).select("href").distinct()
    return PG.crawl_summary(pages.select("page_id"), items, PG.page_images(pages))


# ---- run histories ------------------------------------------------------------------------

EP = with_views("epochs")
RUN_SQL = """h0 AS (SELECT *, coalesce(val_f1 > max(val_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM epochs),
  h AS (SELECT *, max(val_f1) OVER (ORDER BY epoch) AS best_so_far, (epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch))::INT AS since_best FROM h0)"""


@query("running_best", f"{EP}, {RUN_SQL} SELECT epoch, val_f1, improved, best_so_far, since_best, since_best>=6 AS stop FROM h")
def _(spark, d):
    return L.running_best(V.epochs(spark, d), patience=6)


@query(
    "best_and_stop_epoch",
    f"{EP}, {RUN_SQL} SELECT (SELECT min(epoch) FROM h WHERE since_best>=6) AS stop_epoch, (SELECT epoch FROM epochs ORDER BY val_f1 DESC, epoch LIMIT 1) AS best_epoch, (SELECT max(val_f1) FROM epochs) AS best_score",
)
def _(spark, d):
    ep = V.epochs(spark, d)
    stop = L.early_stop_epoch(L.running_best(ep, patience=6)).scalar()
    return L.best_epoch(ep).withColumn("stop_epoch", stop)


ES = f"""{with_views('scored')}, e AS (SELECT id, label, CASE WHEN id%2=0 THEN 'search' ELSE 'select' END AS subset, (k+1)::INT AS epoch,
   round(((id*(7919+2*k)+13*k)%1001)::DOUBLE/1001e0*0.7e0 + label*0.03e0*k,6) AS prob FROM scored, range(0,6) r(k)),
  q AS (SELECT *, least(greatest(prob,1e-6),1-1e-6) AS c FROM e), e2 AS (SELECT *, round(1/(1+exp(-(ln(c/(1-c))+ln(0.2e0/0.8e0)-ln(0.4e0/0.6e0)))),9) AS p FROM q),
  cells AS (SELECT epoch, p AS score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM e2 WHERE subset='search' GROUP BY ALL),
  cand AS (SELECT epoch, score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM cells UNION ALL SELECT epoch, t, 0, 0 FROM (SELECT DISTINCT epoch FROM cells), (VALUES (0e0),(0.5e0),(1e0)) v(t)) GROUP BY ALL),
  cums AS (SELECT epoch, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY epoch)-sum(pos) OVER w AS fn FROM cand WINDOW w AS (PARTITION BY epoch ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT epoch, score, CASE WHEN tp=0 THEN 0e0 ELSE 2e0*(tp::DOUBLE/greatest(1,tp+fp))*(tp::DOUBLE/greatest(1,tp+fn))/(tp::DOUBLE/greatest(1,tp+fp)+tp::DOUBLE/greatest(1,tp+fn)) END AS f1 FROM cums),
  b AS (SELECT epoch, max(f1) AS search_f1, arg_min(score, score) FILTER (f1=mx) AS threshold FROM (SELECT *, max(f1) OVER (PARTITION BY epoch) AS mx FROM f) GROUP BY epoch),
  s AS (SELECT epoch, search_f1, threshold, count(*) FILTER (p>=threshold AND label=1) AS tp, count(*) FILTER (p>=threshold AND label=0) AS fp, count(*) FILTER (p<threshold AND label=1) AS fn FROM e2 JOIN b USING (epoch) WHERE subset='select' GROUP BY ALL)
  SELECT epoch, round(threshold,6) AS threshold, round(search_f1,6) AS search_f1, round(CASE WHEN tp=0 THEN 0e0 ELSE 2e0*(tp::DOUBLE/greatest(1,tp+fp))*(tp::DOUBLE/greatest(1,tp+fn))/(tp::DOUBLE/greatest(1,tp+fp)+tp::DOUBLE/greatest(1,tp+fn)) END,6) AS val_f1 FROM s"""


@query("epoch_selection", ES)
def _(spark, d):
    k = F.col("k")
    df = V.scored(spark, d).withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(6)])))
    prob = F.round((F.col("id") * (F.lit(7919) + 2 * k) + 13 * k) % 1001 / F.lit(1001.0) * 0.7 + F.col("label") * 0.03 * k, 6)
    df = df.select("id", "label", F.when(F.col("id") % 2 == 0, "search").otherwise("select").alias("subset"), (k + 1).alias("epoch"), prob.alias("prob"))
    from sievecrest.functions.scores import bayes_prior_correct

    df = df.withColumn("prob", F.round(bayes_prior_correct(F.col("prob"), 0.4, 0.2), 9))
    out = L.epoch_selection(df, 0.4, 0.2, correct=False)
    return out.select("epoch", *[F.round(c, 6).alias(c) for c in ("threshold", "search_f1", "val_f1")])


@query(
    "ledger_settings",
    """SELECT o_orderkey AS run, o_custkey%7 AS epoch, 'on' AS bayes, CASE WHEN o_orderkey%2=0 THEN round(o_custkey/100e0,2) END AS seed FROM orders""",
)
def _(spark, d):
    text = F.concat(
        F.lit("epoch="), F.col("o_custkey") % 7, F.lit("; bayes=on"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ;seed="), F.round(F.col("o_custkey") / 100, 2))).otherwise(""),
    )
    m = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), L.parse_settings(text).alias("m"))
    return m.select("run", F.col("m.epoch").cast("bigint").alias("epoch"), F.col("m.bayes").alias("bayes"), F.col("m.seed").cast("double").alias("seed"))


@query(
    "ledger_progress",
    """SELECT o_orderkey AS run, o_custkey AS grp, o_totalprice AS metric, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best_so_far,
    coalesce(o_totalprice > max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM orders""",
)
def _(spark, d):
    df = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("metric"))
    return L.ledger_progress(df, "run", "metric", "grp")


@query(
    "ledger_keep_rates",
    """SELECT o_orderpriority AS commit, count(*) AS runs, count(*) FILTER (o_orderstatus='F') AS kept, round(count(*) FILTER (o_orderstatus='F')/count(*)::DOUBLE,6) AS keep_rate, max(o_totalprice) AS best_metric FROM orders GROUP BY 1""",
)
def _(spark, d):
    df = V.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("commit"), F.when(F.col("o_orderstatus") == "F", "keep").otherwise("discard").alias("status"), F.col("o_totalprice").alias("primary_metric")
    )
    return L.keep_rates(df, "commit").withColumn("keep_rate", F.round("keep_rate", 6))


