"""AUC and F1 from packed counts, and flipped labels: beside the plain metrics and the single fits."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohort.operators import many, models as M, robustness
from cohort.operators.evaluate import binary_metrics
from cohort.operators.many import Fit, fit_many, ranked_fits, score_many


def _table(spark, n=700, seed=5):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=n), draw.normal(size=n) * 3, draw.integers(0, 2, n), draw.integers(0, 2, n)])
    y = (draw.random(n) < 1 / (1 + np.exp(-(x @ np.array([1.0, -0.4, 0.8, 0.0]))))).astype(int)
    return spark.createDataFrame([(i * 37 - 90, int(v), Vectors.dense(r)) for i, (r, v) in enumerate(zip(x, y))], ["row_id", "y_true", "features"])


@pytest.mark.parametrize("grid", [None, 0])
def test_auc_and_f1_from_packed_counts(spark, grid, monkeypatch):
    table = _table(spark)
    if grid is not None:  # few different scores, and a label that is not known
        table = table.withColumn("features", F.udf(lambda v: Vectors.dense([round(float(v[0])), 0.0, v[2], v[3]]), table.schema["features"].dataType)("features"))
        table = table.withColumn("y_true", F.when(F.col("row_id") % 11 != 0, F.col("y_true")))
    monkeypatch.setattr(many, "BLOCK_ROWS", 50)
    monkeypatch.setattr(many, "CHUNK_ROWS", 90)
    table = table.persist()
    fits = [Fit("a"), Fit("b", C=0.001), Fit("c", keep=(2,))]
    want = {r.model: (r.roc_auc, r.f1) for r in binary_metrics(score_many(table, fit_many(table, fits)), ["model"]).collect()}
    assert ranked_fits(table, fits) == [pytest.approx(want[f.name]) for f in fits]


def test_a_ranking_of_labels_does_not_hold_the_ones_before(spark, monkeypatch):
    held, rank = [], robustness.hash_rank

    def watched(df, *args):
        held.append(df._jdf.queryExecution().analyzed().toString().count("Window"))
        return rank(df, *args)

    monkeypatch.setattr(robustness, "hash_rank", watched)
    table = _table(spark)
    out = robustness.label_flip_test(table, M.logistic_trainer()).collect()
    assert held == [0] * len(robustness.FLIP_RATIOS)  # each ranking reads its rows twice
    for r in out[-2:]:
        fitted = fit_many(robustness.flipped(table, r.flip_ratio, f"flip{r.flip_ratio}"), [Fit("m")], tol=1e-9)
        assert r.roc_auc == pytest.approx(binary_metrics(score_many(table, fitted)).first().roc_auc, abs=2e-5)
