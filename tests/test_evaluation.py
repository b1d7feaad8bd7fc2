"""Scored-table operators on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from cohort import fixtures
from cohort.operators import compare, evaluate as E, thresholds as Th


def frame(spark, rows):
    return spark.createDataFrame([(i, y, s, int(s >= 0.5)) for i, (y, s) in enumerate(rows)], "row_id long, y_true int, y_score double, y_pred int")


def test_all_scores_equal(spark):
    m = E.binary_metrics(frame(spark, [(1, 0.4)] * 3 + [(0, 0.4)] * 7)).first()
    assert m["roc_auc"] == 0.5 and m["pr_auc"] == pytest.approx(0.3)


def test_single_class_has_no_auc(spark):
    m = E.binary_metrics(frame(spark, [(1, 0.2), (1, 0.9)])).first()
    assert m["roc_auc"] is None and m["pr_auc"] is None and m["recall"] == 0.5


def test_known_auc(spark):
    m = E.binary_metrics(frame(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])).first()
    assert m["roc_auc"] == pytest.approx(0.75) and m["pr_auc"] == pytest.approx(0.8333333333)


def test_reversed_scores_reverse_auc(spark, sf):
    scored = fixtures.scored(spark, sf)
    a = E.binary_metrics(scored).first()
    b = E.binary_metrics(scored.withColumn("y_score", 1 - F.col("y_score"))).first()
    assert a["roc_auc"] + b["roc_auc"] == pytest.approx(1.0)
    assert a["tp"] + a["fp"] + a["fn"] + a["tn"] == a["n_samples"]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, sf, parts):
    scored = fixtures.scored(spark, sf)
    assert E.binary_metrics(scored.repartition(parts)).first() == E.binary_metrics(scored).first()


def test_bin_edges(spark):
    scored = frame(spark, [(0, 0.0), (1, 0.1), (0, 0.7), (1, 1.0)])
    right = {r["bin"]: r["n"] for r in E.calibration_bins(scored, closed="right").collect()}
    left = {r["bin"]: r["n"] for r in E.calibration_bins(scored, closed="left").collect()}
    open_ = {r["bin"]: r["n"] for r in E.calibration_bins(scored, closed="right-open-zero").collect()}
    assert right == {1: 2, 7: 1, 10: 1} and left == {1: 1, 2: 1, 8: 1, 10: 1} and open_ == {1: 1, 7: 1, 10: 1}


def test_score_on_threshold_is_flagged(spark):
    rows = Th.threshold_sweep(frame(spark, [(1, 0.15), (0, 0.1)]), [0.1, 0.15, 0.16]).orderBy("threshold").collect()
    assert [r["n_flagged"] for r in rows] == [2, 1, 0]


def test_lowest_threshold_wins_ties(spark):
    sweep = Th.threshold_sweep(frame(spark, [(1, 0.9), (1, 0.8), (0, 0.2)]), Th.hundredths(10, 89))
    picks = {r["policy"]: r["threshold"] for r in Th.threshold_picks(sweep).collect()}
    assert picks["best_f1"] == 0.21 and picks["screening"] == 0.10


def test_grids_have_the_stated_sizes():
    assert [len(g) for g in (Th.SWEEP_GRID, Th.SERVICE_GRID, Th.SUBGROUP_GRID, Th.DECISION_GRID)] == [80, 17, 91, 100]


def metrics(spark, rows):
    return spark.createDataFrame([(p, m, a, pr, f) for p, m, a, pr, f in rows], "profile string, model string, roc_auc double, pr_auc double, f1 double")


def test_best_choice_takes_auc_and_warns(spark):
    m = metrics(spark, [("safe", "catboost", 0.84, 0.8, 0.7), ("full", "gam", 0.86, 0.8, 0.7)])
    t = spark.createDataFrame([("full", "gam", "screening", 0.27)], "profile string, model string, policy string, threshold double")
    best = compare.best_deployable(m, t).first()
    assert (best["profile"], best["model"], best["threshold"], best["profile_warning"]) == ("full", "gam", 0.27, True)


def test_exact_tie_takes_preferred_model(spark):
    m = metrics(spark, [("safe", "logistic", 0.84, 0.8, 0.7), ("safe", "catboost", 0.84, 0.8, 0.7)])
    t = spark.createDataFrame([("safe", "catboost", "best_f1", 0.35)], "profile string, model string, policy string, threshold double")
    best = compare.best_deployable(m, t).first()
    assert (best["model"], best["threshold"], best["threshold_source"], best["threshold_warning"]) == ("catboost", 0.35, "best_f1", True)


def test_report_choice_prefers_safe(spark):
    m = metrics(spark, [("safe", "catboost", 0.84, 0.8, 0.7), ("full", "gam", 0.9, 0.8, 0.7)])
    assert compare.best_for_report(m).first()["model"] == "catboost"


def test_mcnemar_identical_models(spark):
    one = frame(spark, [(1, 0.9), (0, 0.2)])
    both = one.withColumn("model", F.lit("a")).unionByName(one.withColumn("model", F.lit("b")))
    r = compare.mcnemar(both).first()
    assert r["chi2"] == 0 and r["p"] == 1 and not r["significant"]


def test_models_must_score_the_same_rows(spark):
    a = frame(spark, [(1, 0.9), (0, 0.2)]).withColumn("model", F.lit("a"))
    b = frame(spark, [(1, 0.9)]).withColumn("model", F.lit("b"))
    with pytest.raises(Exception, match="same rows"):
        compare.align_models(a.unionByName(b)).collect()


def test_bootstrap_is_reproducible_and_covers(spark, sf):
    scored = fixtures.scored(spark, sf)
    a = {r["metric"]: r for r in compare.bootstrap_ci(scored, 200).collect()}
    b = {r["metric"]: r for r in compare.bootstrap_ci(scored.repartition(5), 200).collect()}
    point = E.binary_metrics(scored).first()
    for m, r in a.items():
        assert r["lower"] < point[m] < r["upper"] and r["mean"] == pytest.approx(b[m]["mean"], abs=1e-12)
