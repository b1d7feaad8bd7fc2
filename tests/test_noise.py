"""Draws of whole blocks and noise level by level: beside the Spark expressions and the single fits."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohort.functions import hashing
from cohort.operators import many, models as M, robustness
from cohort.operators.evaluate import binary_metrics
from cohort.operators.many import Fit, fit_many, score_many


def _table(spark, n=700, seed=5):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=n), draw.normal(size=n) * 3, draw.integers(0, 2, n), draw.integers(0, 2, n)])
    y = (draw.random(n) < 1 / (1 + np.exp(-(x @ np.array([1.0, -0.4, 0.8, 0.0]))))).astype(int)
    return spark.createDataFrame([(i * 37 - 90, int(v), Vectors.dense(r)) for i, (r, v) in enumerate(zip(x, y))], ["row_id", "y_true", "features"])


@pytest.mark.parametrize("tail", ["", ":3", ":12-more"])
def test_draws_of_a_block_are_those_of_the_rows(spark, tail):
    keys = ["1", "22", "-7", "", "é€", "x" * 50, "y" * 64, "z" * 130, "22", "1234567"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    key = F.concat("k", F.lit(tail))
    want = rows.select("i", hashing.uniform(key, "t").alias("u"), hashing.normal(key, "t").alias("z")).orderBy("i").collect()
    blobs = [k.encode() for k in keys]
    held = hashing.Keys(b"".join(blobs), np.array([len(b) for b in blobs], np.int32))
    assert held.uniforms([f"{tail}-t"])[0].tolist() == [r.u for r in want]
    assert held.normals(tail, "t") == pytest.approx([r.z for r in want], rel=1e-13, abs=1e-15)


def test_noise_is_made_level_by_level(spark, monkeypatch):
    table, levels, wide = _table(spark).persist(), [0.1, 3.0], []
    pack = many._blocks
    monkeypatch.setattr(many, "_blocks", lambda t, features, labels: wide.append(len(features)) or pack(t, features, labels))
    found = {r.noise_level: r for r in robustness.noise_test(table, M.logistic_trainer(), levels).collect()}
    assert wide == [1]  # no copy of the features per level beside the others
    for v in levels:
        fitted = fit_many(robustness.noisy(table, v, f"noise{v}", "loud"), [Fit("m", features="loud")], tol=1e-9)
        want = binary_metrics(score_many(table, fitted)).first()
        assert (found[v].roc_auc, found[v].f1) == pytest.approx((want.roc_auc, want.f1), abs=2e-5)


def test_a_row_without_a_key_has_no_draws(spark):
    table = _table(spark, 60).withColumn("row_id", F.when(F.col("row_id") > 0, F.col("row_id")))
    with pytest.raises(Exception, match="null"):
        robustness.noise_test(table, M.logistic_trainer(), [0.5])
