"""Many logistic models from one scan: the optimum of each, beside plain numpy and MLlib."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohort.operators import leakage, many, models as M, robustness
from cohort.operators.many import Fit, fit_many, metrics_of, score_many
from cohort.roles import ColumnRoles


def _rows(n=900, p=6, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, p)) * np.array([1, 1, 5, 0.2, 1, 1])
    x[:, 5] = (x[:, 4] > 0).astype(float)
    y = (draw.random(n) < 1 / (1 + np.exp(-(x @ np.array([1.2, -0.7, 0.2, 2.0, 0.4, 0.0]) - 1.0)))).astype(int)
    return x, y


def _table(spark, x, y, fold=None):
    fold = np.arange(len(y)) % 3 if fold is None else fold
    return spark.createDataFrame(
        [(i, int(v) if v is not None else None, Vectors.dense(r), int(f)) for i, (r, v, f) in enumerate(zip(x, y, fold))],
        ["row_id", "y_true", "features", "fold"])


def _gradient(x, y, b, C):
    """Of the mean weighted loss and penalty, written out."""
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    r = w * (1 / (1 + np.exp(-(x @ b[:-1] + b[-1]))) - y) / n
    return np.append(x.T @ r + b[:-1] / (C * n), r.sum())


def test_every_model_is_at_its_own_optimum(spark):
    x, y = _rows()
    table = _table(spark, x, y).withColumn("other", (1 - F.col("y_true")).cast("int"))
    fits = [Fit("all"), Fit("strong", C=0.01), Fit("few", keep=(0, 3)), Fit("turned", label="other")] + [Fit("fold", left_out=i) for i in range(3)]
    fitted = fit_many(table, fits, tol=1e-8)
    fold = np.arange(len(y)) % 3
    for fit, b, n in zip(fits, fitted.coefficients, fitted.rows):
        used = np.ones(len(y), bool) if fit.left_out is None else fold != fit.left_out
        assert n == used.sum()
        labels = 1 - y if fit.label == "other" else y
        g = _gradient(x[used], labels[used], b, fit.C)
        free = list(range(6) if fit.keep is None else fit.keep) + [6]
        assert np.abs(g[free]).max() < 2e-8
        assert all(b[i] == 0 for i in range(7) if i not in free)
    assert fitted.coefficients[3] == pytest.approx(-fitted.coefficients[0], abs=1e-5)
    report = fitted.report(spark).collect()
    assert len(report) == 7 and all(r.converged for r in report)


def test_agrees_with_the_single_trainer(spark):
    x, y = _rows()
    table = _table(spark, x, y).persist()
    fitted = fit_many(table, [Fit("m", left_out=0)])
    ours = {r.row_id: r.y_score for r in score_many(table, fitted).collect()}
    theirs = {r.row_id: r.y_score for r in M.logistic_trainer()(table.filter("fold <> 0"), table.filter("fold = 0")).collect()}
    assert ours.keys() == theirs.keys() == {i for i in range(len(y)) if i % 3 == 0}
    assert max(abs(ours[k] - theirs[k]) for k in ours) < 2e-3


def test_small_blocks_and_many_partitions_change_nothing(spark, monkeypatch):
    x, y = _rows(400)
    table = _table(spark, x, y)
    whole = fit_many(table, [Fit("a"), Fit("b", left_out=1)], tol=1e-9).coefficients
    monkeypatch.setattr(many, "BLOCK_ROWS", 7)
    monkeypatch.setattr(many, "ROWS_PER_PARTITION", 30)
    monkeypatch.setattr(many, "WIDEST_GRAM", 0)  # steps from the diagonal too
    assert fit_many(table, [Fit("a"), Fit("b", left_out=1)], tol=1e-9).coefficients == pytest.approx(whole, abs=1e-6)


def test_null_labels_one_class_and_no_rows(spark):
    x, y = _rows(60)
    table = _table(spark, x, y)
    holes = table.withColumn("y_true", F.when(F.col("row_id") < 50, F.col("y_true")))
    fitted = fit_many(holes, [Fit("a")], tol=1e-8)
    assert fitted.rows[0] == 50 and np.abs(_gradient(x[:50], y[:50], fitted.coefficients[0], 1.0)).max() < 2e-8
    one = fit_many(table.withColumn("y_true", F.lit(1)), [Fit("a")])
    assert np.isfinite(one.coefficients).all() and one.coefficients[0][-1] > 5
    empty = fit_many(table.filter("row_id < 0"), [Fit("a")])
    assert empty.rows[0] == 0 and not empty.coefficients.any()
    assert score_many(table.filter("row_id < 0"), empty).count() == 0


def test_metrics_are_those_of_each_model(spark):
    x, y = _rows()
    table = _table(spark, x, y).persist()
    found = {(r.model, r.fold): r for r in metrics_of(table, [Fit("all"), Fit("cv", left_out=0), Fit("cv", left_out=1)]).collect()}
    assert set(found) == {("all", None), ("cv", 0), ("cv", 1)} and found["all", None].n_samples == 900 and found["cv", 0].n_samples == 300


def test_leakage_and_robustness_take_the_shared_scan(spark):
    x, y = _rows(600)
    table = _table(spark, x, y).drop("fold").persist()

    def refit(train, test):  # not known as logistic, so fitted one by one
        return M.logistic_trainer()(train, test)

    for together, apart in (
        (robustness.noise_test(table, M.logistic_trainer(), [0.1, 0.5]), robustness.noise_test(table, refit, [0.1, 0.5])),
        (robustness.label_flip_test(table, M.logistic_trainer(), [0.05, 0.3]), robustness.label_flip_test(table, refit, [0.05, 0.3])),
    ):
        key = together.columns[0]
        want = {r[key]: r.roc_auc for r in apart.collect()}
        assert {r[key]: r.roc_auc for r in together.collect()} == pytest.approx(want, abs=2e-3)
    raw = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, s double, t int")
    roles = ColumnRoles("t", "id", ["a", "b", "c", "d", "e"], [], [], "s", [])
    together, apart = (leakage.drop_one_column(raw, roles, 3, t).collect() for t in (M.logistic_trainer(), refit))
    assert {r.dropped: r.roc_auc for r in together} == pytest.approx({r.dropped: r.roc_auc for r in apart}, abs=2e-3)
    trials, best = M.search_params(table, M.logistic_trainer, {"C": (0.001, 10.0, "log")}, n_trials=4, k=3, metric="roc_auc")
    assert trials.count() == 4 and trials.first().params["C"] == best["C"]
