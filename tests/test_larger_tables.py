"""What larger tables showed: tables in many files, ties at a threshold, signs of zero, wide rows in batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievecrest.functions.vectors import round_half_up
from sievecrest.operators import images as I
from sievecrest.operators import metrics as M
from sievecrest.operators import pooling as P
from sievecrest.plans import views as V
from sievecrest.streaming import incremental as X


@pytest.mark.parametrize("parts", [1, 3])
def test_running_sums_of_a_table_in_one_file_or_a_folder(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, [i, 2 * i]) for i in range(30)], "id bigint, r array<int>")
    if parts == 1:
        rows.toPandas().to_parquet(f"{tmp_path}/t.parquet")
    else:
        rows.repartition(parts).write.parquet(f"{tmp_path}/t.parquet")
    rows.write.parquet(f"{tmp_path}/other.parquet")
    schema = spark.read.parquet(f"{tmp_path}/t.parquet").schema
    got = X.running_channel_sums(spark, str(tmp_path), schema, f"{tmp_path}/out", f"{tmp_path}/ck", lambda d: d.select("r"), {"r": "r"}, "t.parquet").first()
    assert (got.n_images, got.n_pixels, got.sum_r) == (30, 60, 3.0 * sum(range(30)))


def test_percentile_on_a_gate_is_not_below_it(spark):
    df = spark.createDataFrame([(0.5,)] * 53 + [(962 / 1001,), (988 / 1001,)], "x double")
    assert M.exact_percentiles(df, "x", [0.995], names=["top"]).first().top == 0.98


def test_rounded_elements_keep_the_sign_of_zero(spark):
    got = spark.range(1).select(round_half_up(F.array(*[F.lit(v) for v in (-4e-7, 4e-7, -0.0, -1.2345678, 2.5)]), 6).alias("v")).first().v
    assert str(got) == "[-0.0, 0.0, -0.0, -1.234568, 2.5]"


def test_mean_on_the_threshold_is_positive_in_any_order(spark):
    probs = [689, 552, 131, 630]
    df = spark.createDataFrame([(1, f"m{i}", p / 1001) for i, p in enumerate(probs)], "id bigint, model string, prob double").coalesce(1)
    assert P.bag_probabilities(df, len(probs)).first().label == 1


def test_fingerprints_leave_in_small_batches():
    class Frame:
        dtypes = [("id", "bigint")]

        def select(self, *_):
            return self

        def mapInPandas(self, run, _schema):
            image = {"data": bytes(range(48)), "height": 4, "width": 4, "nChannels": 3}
            return list(run(iter([pd.DataFrame({"id": np.arange(600), "image": [image] * 600})])))

    made = I.fingerprints(Frame(), ("id",))
    assert max(map(len, made)) <= 256 and pd.concat(made)["id"].tolist() == list(range(600))


def test_one_models_scores_are_made_alone(spark, sf):
    for m in (0, 4):
        alone, all_rows = V.model_scores(spark, sf, m), V.scored_long(spark, sf).where(F.col("model") == f"m{m}")
        assert alone.count() == all_rows.count() and alone.exceptAll(all_rows.select(alone.columns)).isEmpty()
        assert "Generate" not in alone._jdf.queryExecution().toString()


def test_equal_coefficients_at_the_median_of_a_perceptual_hash():
    """Coefficients (0, 4) and (4, 0) are equal and the median; the SQL sets the first with 1, 4 and 8 threads."""
    px = np.array([
        108, 147, 129, 130, 105, 108, 100, 159, 160, 116, 158, 102, 236, 115, 107, 152,
        96, 174, 108, 116, 144, 128, 115, 96, 153, 133, 164, 90, 149, 172, 100, 148,
        132, 121, 182, 137, 42, 124, 206, 128, 126, 128, 113, 120, 144, 94, 144, 132,
        162, 143, 138, 62, 122, 131, 127, 166, 102, 98, 170, 66, 134, 124, 143, 113,
    ], dtype=np.uint8)
    rgb = np.stack([px, np.roll(px, -1), np.roll(px, -2)], axis=1).reshape(8, 8, 3)
    assert I._finger(rgb, I._dct(32))["phash"] % 2**64 == 0xB8CD0CA7333D2A73
