"""Keys, URLs, text, joins, readers, streaming and plans on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from sievecrest.functions import keys as K
from sievecrest.functions import risk as R
from sievecrest.functions import text as TX
from sievecrest.functions import urls as U
from sievecrest.operators import filters as FL
from sievecrest.operators import joins as J
from sievecrest.operators import ledger as L
from sievecrest.operators import pages as PG
from sievecrest.operators.labels import with_label_index
from sievecrest.plans.audits import consensus_scores
from sievecrest.sources import readers as RD
from sievecrest.sources import writers as WR
from sievecrest.streaming import incremental as X


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "path, want",
    [("a/b/17.jpg", "000017.jpg"), ("x/000004_mask_000.png", "000004.jpg"), ("1234567.png", "1234567.jpg"), ("abc.png", None)],
)
def test_normalize_id(spark, path, want):
    assert one(spark, K.normalize_id(F.col("p")), p=path) == want


@pytest.mark.parametrize(
    "name, want",
    [("rock_basalt_1a2b3c4d5e.png", "basalt"), ("rock_1a2b3c4d5e.png", "rock_1a2b3c4d5e"), ("plain.jpg", "plain"), ("rock__x.jpg", "rock__x"), ("rock_a_b.jpg", "a")],
)
def test_infer_group(spark, name, want):
    assert one(spark, K.infer_group(F.col("n")), n=name) == want


@pytest.mark.parametrize("w, h, want", [(4000, 3000, (1280, 960)), (10, 10, (32, 32)), (1400, 1400, (1183, 1183)), (5, 2000, None)])
def test_target_size(spark, w, h, want):
    got = tuple(one(spark, K.target_size(F.col("w"), F.col("h")), w=w, h=h))
    if w == 5:  # the short edge grows last, whatever that does to the long one
        assert got[0] == 32
    else:
        assert got == want


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("http://h.org/a/b/c.html?x=1#f", "d.html", "http://h.org/a/b/d.html"),
        ("http://h.org/a/b/c.html", "../d?e=1", "http://h.org/a/d?e=1"),
        ("http://h.org/a/b/", "./x/../y", "http://h.org/a/b/y"),
        ("http://h.org", "/é x", "http://h.org/%C3%A9%20x"),
        ("http://h.org/a", "//o.net/z", "http://o.net/z"),
        ("http://h.org/a?b", "#top", "http://h.org/a?b#top"),
        ("http://h.org/a?b", "?c=2", "http://h.org/a?c=2"),
        ("http://h.org/a", "https://q.net/", "https://q.net/"),
        ("not a url", "x", None),
    ],
)
def test_resolve_url(spark, base, href, want):
    assert one(spark, U.resolve_url(F.col("b"), F.col("h")), b=base, h=href) == want


def test_page_images_and_relative_links(spark):
    html = '<body><h2>T&amp;x</h2><a class="k" href="p?id=7&amp;q=1">One <b>two</b></a><img src="i/logo.png"><img alt="A" width="90" src="/p.jpg?v=2"></body>'
    pages = spark.createDataFrame([(1, "http://h.org/d/e", html)], "page_id int, url string, html string")
    link = PG.page_links(pages).first()
    assert (link["text"], link["href"]) == ("One two", "http://h.org/d/p?id=7&q=1")
    assert one(spark, PG.item_id(F.col("u"), F.lit("h")), u=link["href"]) == "7"
    imgs = PG.page_images(pages)
    assert imgs.count() == 2
    kept = imgs.where(U.is_content_image(F.col("src"), F.col("width"), F.col("height"))).collect()
    assert [(r["src"], r["alt"], r["width"]) for r in kept] == [("http://h.org/p.jpg?v=2", "A", 90)]
    assert PG.page_heads(pages).first()["heading"] == "T&x"


def test_keywords_and_text():
    assert TX.parse_keywords(" a, ,b ") == ["a", "b"]
    with pytest.raises(ValueError):
        TX.parse_keywords(" , ")


def test_label_index_needs_two_classes(spark):
    df = spark.createDataFrame([(1, 3), (2, 5), (3, 9)], "id int, label int")
    with pytest.raises(Exception, match="expected 2 classes"):
        with_label_index(df, "label").collect()
    assert [r["label_idx"] for r in with_label_index(df, "label", None).orderBy("id").collect()] == [0, 1, 2]


def test_votes_without_models_are_null(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    labels = spark.createDataFrame([(1, "a", 1), (1, "b", -1), (1, "c", 0)], "id int, model string, label int")
    rows = {r["id"]: r for r in J.label_votes(ids, labels).collect()}
    assert (rows[1]["pos_votes"], rows[1]["model_count"], rows[1]["pos_frac"], rows[1]["neg_votes"]) == (1, 2, 0.5, 1)
    assert (rows[2]["model_count"], rows[2]["pos_frac"]) == (0, None)


def test_pseudo_labels_keep_their_schema_when_empty(spark):
    df = spark.createDataFrame([(1, 0.6)], "id int, prob_pos_corrected double")
    out = FL.pseudo_labels(df, 0.9)
    assert out.count() == 0 and out.columns == ["id", "label", "label_idx", "prob_pos_corrected", "pseudo_confidence", "source"]
    with pytest.raises(ValueError):
        FL.pseudo_labels(df, 0.4)


def test_empty_rule_selects_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "id int, x double")
    assert FL.matched_rules(df, {"never": F.lit(False), "low": F.coalesce(F.col("x") < 0.6, F.lit(False))}).select("rule", "id").collect() == [("low", 2)]


def test_tier_order_and_rank_direction(spark):
    rows = [(1, 0.9, 0.9, 0.0), (2, 0.1, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "id int, risk double, ver double, f double").select("*", F.lit(0.5).alias("p"))
    good = {r["id"]: r["consensus"] for r in consensus_scores(df, "risk", "ver", "f", "f", "f", "f", "p").collect()}
    bad = {r["id"]: r["consensus"] for r in consensus_scores(df, "risk", "ver", "f", "f", "f", "f", "p", risk_high_is_bad=False).collect()}
    assert good[1] > good[2] and bad[1] < bad[2]
    tier = R.assign_tier(F.lit(0.9), F.lit("inferred_fp"), F.lit(0.0), F.lit(0.1))
    assert spark.range(1).select(tier.alias("t")).first()["t"] == "A_lb_inferred"


def test_early_stop(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.4], 1)], "epoch int, val_f1 double")
    hist = L.running_best(df, patience=2)
    assert [r["since_best"] for r in hist.orderBy("epoch").collect()] == [0, 0, 1, 2, 0]
    assert L.early_stop_epoch(hist).first()["stop_epoch"] == 4 and L.best_epoch(df).first()["best_epoch"] == 5


def test_readers(spark, tmp_path):
    led = tmp_path / "l.tsv"
    led.write_text("\t".join(RD.LEDGER_COLUMNS) + "\nab\t0.5\tk=1\t2m\tkeep\tfine\n7\tab\t0.9\tk=2\t3m\tkeep\n")
    rows = RD.read_ledger(spark, str(led)).orderBy("commit").collect()
    assert [r["_corrupt"] is not None for r in rows] == [True, False] and rows[1]["primary_metric"] == 0.5
    probs = tmp_path / "p.csv"
    probs.write_text("id,prob_pos\na,0.2\na,0.3\n")
    with pytest.raises(Exception, match="duplicate id"):
        RD.read_probs(spark, str(probs)).collect()
    (tmp_path / "q.csv").write_text("id,other\na,1\n")
    with pytest.raises(ValueError):
        RD.read_probs(spark, str(tmp_path / "q.csv"))
    (tmp_path / "s.json").write_text('{"a": 1,\n "b": {"c": [1, 2]}}')
    assert RD.read_json_sidecar(spark, str(tmp_path / "s.json")).first()["b"]["c"] == [1, 2]
    (tmp_path / "arr.json").write_text("[1, 2]")
    with pytest.raises(ValueError):
        RD.read_json_sidecar(spark, str(tmp_path / "arr.json"))


def test_incremental_scoring_skips_seen_ids(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = spark.range(10).withColumn("v", F.col("id") % 3)
    rows.coalesce(1).write.parquet(src)

    def score(df):
        return df.where("v > 0").select("id", (F.col("v") / 10).alias("p"))

    first = X.score_new_files(spark, src, rows.schema, out, ck, score)
    assert first.count() == 10 and first.where("status = 'empty'").count() == 4
    spark.range(5, 15).withColumn("v", F.lit(1).cast("bigint")).coalesce(1).write.mode("append").parquet(src)
    second = X.score_new_files(spark, src, rows.schema, out, ck, score)
    assert second.count() == 15 and second.select("id").distinct().count() == 15
    assert second.where("id = 6").first()["status"] == "empty"


def test_feature_cache_computes_only_missing(spark, tmp_path):
    cache, seen = str(tmp_path / "cache"), []

    def compute(df):
        seen.append(sorted(r["sample_id"] for r in df.select("sample_id").collect()))
        return df.select("sample_id", F.array(F.col("sample_id").cast("double")).alias("embedding"))

    WR.cached_features(spark, cache, spark.range(3).withColumnRenamed("id", "sample_id"), "b", compute)
    out = WR.cached_features(spark, cache, spark.range(1, 5).withColumnRenamed("id", "sample_id"), "b", compute)
    assert seen == [[0, 1, 2], [3, 4]] and out.count() == 4


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
