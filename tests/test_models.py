"""Models, deployment and runs on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import explain, gam, leakage, models as M, robustness
from cohort.operators.evaluate import binary_metrics
from cohort.plans import deploy, runs
from cohort.roles import ColumnRoles
from cohort.sources import tables as T
from cohort.streaming import trend

ROLES = ColumnRoles("y", "id", ["a", "b"], [], ["g"], None, [])


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        a, b, g = rng.normal(), rng.normal(), "uvw"[rng.integers(0, 3)]
        p = 1 / (1 + np.exp(-(1.5 * a + (g == "u") - 0.5)))
        rows.append((i, float(a) if i % 50 else None, float(b), g, int(rng.random() < p)))
    return spark.createDataFrame(rows, "id long, a double, b double, g string, y int").persist()


def test_logistic_reaches_the_penalised_optimum(table):
    model = M.fit_logistic(table, ROLES)
    design = model.design.assembled(table).collect()
    x, y = np.array([r["features"].toArray() for r in design]), np.array([r["y_true"] for r in design])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, mu = model.model.coefficients.toArray(), None
    mu = 1 / (1 + np.exp(-(x @ beta + model.model.intercept)))
    gradient = x.T @ (w * (mu - y)) + beta  # C = 1
    assert np.max(np.abs(gradient)) < 0.05
    assert model.design.feature_names == ["a", "b", "g_u", "g_v", "g_w"]


def test_unseen_level_and_nulls_are_scored(spark, table):
    odd = spark.createDataFrame([(1, None, 0.1, "new", 1), (2, 0.2, None, None, 0)], "id long, a double, b double, g string, y int")
    for name, params in (("logistic", {}), ("gam", {"n_splines": 5, "optimize": False})):
        scores = [r["y_score"] for r in M.fit_model(name, table, ROLES, **params).score(odd).collect()]
        assert all(0 < s < 1 for s in scores)


def test_gam_separates_classes_and_importance(spark):
    rows = [(i, 3 * i / 40, int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    model = gam.fit_gam(df, ColumnRoles("y", "id", ["x"], [], [], None, []), 8, False)
    means = {r["y"]: r["m"] for r in model.score(df).groupBy("y").agg(F.avg("y_score").alias("m")).collect()}
    assert means[0] < 0.5 < means[1]
    again = gam.GamModel.from_json(model.to_json())
    assert [r["y_score"] for r in again.score(df).collect()] == [r["y_score"] for r in model.score(df).collect()]
    assert model.interpretation(spark).first()["direction"] == "positive"


def test_gam_solves_the_penalised_equations(table):
    model = gam.fit_gam(table, ROLES, 6, True)
    pdf = table.toPandas()
    x = np.hstack([np.ones((len(pdf), 1))] + [t.design(pdf[t.name].where(pdf[t.name].notna(), None).tolist()) for t in model.terms])
    mu = 1 / (1 + np.exp(-x @ model.beta))
    penalty = np.zeros((x.shape[1], x.shape[1]))
    for t, s in zip(model.terms, model.slices()):
        penalty[s, s] = t.penalty()
    ridge = gam.RIDGE * len(pdf) * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    gradient = x.T @ (pdf["y"].to_numpy() - mu) - (model.lam * penalty + ridge) @ model.beta
    assert np.max(np.abs(gradient)) < 0.05 and model.stats["converged"]


def test_gam_sums_by_tree(table, monkeypatch):
    flat = gam.fit_gam(table, ROLES, 5, False)
    monkeypatch.setattr(gam, "FAN_IN", 3)
    assert np.allclose(gam.fit_gam(table, ROLES, 5, False).beta, flat.beta, atol=1e-8)


def test_contributions_add_up(table):
    model = M.fit_logistic(table, ROLES)
    phi, names = explain.model_contributions(model, table)
    total = phi.select("row_id", (F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)).alias("eta"))
    scored = model.scored(table).join(total, "row_id")
    worst = scored.agg(F.max(F.abs(F.col("y_score") - 1 / (1 + F.exp(-F.col("eta"))))).alias("d")).first()["d"]
    assert worst < 1e-9
    top = explain.top_contributions(phi, names, 5)
    assert top.groupBy("row_id").count().agg(F.max("count")).first()[0] == 5


def test_out_of_fold_covers_every_row_once(table):
    assembled = M.fit_design(table, ROLES).assembled(table)
    oof = M.out_of_fold(assembled, M.logistic_trainer(), 3).persist()
    assert oof.count() == 400 and oof.select("row_id").distinct().count() == 400
    assert binary_metrics(oof).first()["roc_auc"] > 0.7


def test_permuted_column_keeps_its_values(table):
    out = explain.permuted_column(table, "id", "b")
    assert sorted(r["b"] for r in out.collect()) == sorted(r["b"] for r in table.collect())
    assert out.join(table.select("id", F.col("b").alias("b0")), "id").filter("b = b0").count() < 40


def test_noise_and_flips(table):
    assembled = M.fit_design(table, ROLES).assembled(table)
    quiet = robustness.noise_test(assembled, M.logistic_trainer(), [0.01])
    assert abs(quiet.first()["auc_drop"]) < 0.02 and robustness.robustness_grade(quiet).first()["grade"] == "A"
    changed = robustness.flipped(assembled, 0.1).join(assembled.select("row_id", F.col("y_true").alias("old")), "row_id").filter("y_true <> old")
    assert changed.count() == 40
    assert robustness.feature_group("City_X") == "City" and robustness.feature_group("Work/Study Hours") == "Work_Study"


def test_verdict_levels(spark):
    out = [r["v"] for r in spark.createDataFrame([(0.5,), (2.0,), (4.0,)], "auc_drop_pct double").select(leakage.verdict().alias("v")).collect()]
    assert out == ["low", "medium", "high"]


@pytest.mark.parametrize("name, params", [("logistic", {}), ("gam", {"n_splines": 5, "optimize": False}), ("boosted", {"iterations": 3, "depth": 2, "early_stopping_rounds": None})])
def test_save_load_predict(spark, table, name, params):
    deployment = deploy.fit_deployment(table, ROLES, name, "safe", 0.4, **params)
    path = T.scratch_path(spark, name)
    deploy.save_deployment(spark, deployment, path)
    loaded = deploy.load_deployment(spark, path)
    a, b = (d.predict(table).orderBy("id").collect() for d in (deployment, loaded))
    assert a == b and {r["risk_label"] for r in a} == {"screening_flag", "not_flagged"} and a[0]["threshold"] == 0.4
    with pytest.raises(ValueError, match="missing required columns: b"):
        loaded.predict(table.drop("b"))


def test_both_profiles_share_the_split(table):
    flagged = table.withColumn("s", F.when(F.col("y") == 1, "Yes").otherwise(F.when(F.col("id") % 5 == 0, "Yes").otherwise("No")))
    roles = ColumnRoles("y", "id", ["a", "b"], [], ["g"], "s", [])
    out = runs.compare_profiles(flagged, roles, models=("logistic",), params={"logistic": {"max_iter": 50}}, oof=False)
    delta = out["delta"].filter("model = 'logistic'").first()
    assert delta["roc_auc_delta"] > 0.05
    assert out["split"].filter("split = 'test'").count() == 80


def test_training_params():
    assert M.training_params(300)["logistic"]["max_iter"] == 900
    assert M.training_params(2000, "research")["gam"] == {"n_splines": 14, "optimize": True}
    assert M.training_params()["boosted"]["iterations"] == 300


def test_late_rows_are_left_out(spark):
    source, out, progress = (T.scratch_path(spark, n) for n in ("in", "out", "progress"))
    schema = "ts timestamp, v double"
    batches = [["2024-01-01 10:00:00", "2024-01-02 10:00:00"], ["2024-01-05 00:00:00"], ["2024-01-01 11:00:00", "2024-01-09 00:00:00"], ["2024-01-20 00:00:00"]]
    for i, times in enumerate(batches):
        T.write_parquet(spark.createDataFrame([(t, 1.0) for t in times], "t string, v double").select(F.to_timestamp("t").alias("ts"), "v"), f"{source}/b{i}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        trend.run_to_parquet(trend.stream_trend(stream, "ts", "v"), out, progress)
    rows = {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(out).collect()}
    assert rows["2024-01-01"] == 1 and rows["2024-01-05"] == 1 and "2024-01-20" not in rows
