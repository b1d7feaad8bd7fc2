"""Training, explanation, leakage and robustness queries over the survey table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SURVEY, query, u
from catalog.tables import ROLES
from cohort import fixtures
from cohort.functions.columns import column, rounded
from cohort.operators import compare, evaluate, explain, leakage, many, models as M, robustness, split

S = f"WITH {SURVEY}"
SAFE = ROLES.for_profile("safe")
FULL = ROLES.for_profile("full")
# feature groups of the survey fixture
GROUPS = [("City", {"starts": ["city_"]}), ("Gender", {"starts": ["gender_"]}), ("Priority", {"starts": ["priority_"]}), ("Family", {"starts": ["family_history"]}),
          ("Sensitive", {"starts": ["sensitive"]}), ("Numeric", {"starts": ["age", "balance", "price", "pressure"]})]


def _survey(spark, sf):
    return fixtures.survey(spark, sf).persist()


def _assembled(spark, sf, roles=FULL, one_hot=True, scale=True):
    df = _survey(spark, sf)
    design = M.fit_design(df, roles, one_hot, scale)
    return design, design.assembled(df).persist()


def _parts(spark, sf):
    marked = split.target_split(_survey(spark, sf), "id", "target").persist()
    return marked.filter("split = 'train'").drop("split"), marked.filter("split = 'test'").drop("split")


@query("baseline_prior", f"""{S} SELECT id AS row_id, target AS y_true, (SELECT avg(target) FROM survey) AS y_score,
   (round((SELECT avg(target) FROM survey)*1000000) >= 500000)::INTEGER AS y_pred FROM survey""", "y_score")
def _(spark, sf):
    df = _survey(spark, sf)
    return rounded(M.baseline_scores(df, df, "id", "target"))


@query("baseline_stratified", f"""{S} SELECT id AS row_id, target AS y_true, ({u('id', 'dummy')} < (SELECT avg(target) FROM survey))::INTEGER::DOUBLE AS y_score,
   ({u('id', 'dummy')} < (SELECT avg(target) FROM survey))::INTEGER AS y_pred FROM survey""")
def _(spark, sf):
    df = _survey(spark, sf)
    return M.baseline_scores(df, df, "id", "target", "stratified")


@query("design_matrix_means", f"""{S}, f AS (SELECT (age - avg(age) OVER ())/stddev_pop(age) OVER () AS a, (coalesce(pressure, m) - avg(coalesce(pressure, m)) OVER ())/stddev_pop(coalesce(pressure, m)) OVER () AS p,
   gender, family_history, target FROM survey, (SELECT pressure AS m FROM survey WHERE pressure IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
   SELECT target, avg(a) AS age, avg(p) AS pressure, avg((gender='AUTOMOBILE')::INT) AS automobile, avg((family_history='Yes')::INT) AS family_yes FROM f GROUP BY target""", "age pressure automobile family_yes")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = _survey(spark, sf)
    roles = FULL.__class__("target", "id", ["age"], ["pressure"], ["gender", "family_history"], None, [])
    design = M.fit_design(df, roles)
    at = {n: i for i, n in enumerate(design.feature_names)}
    x = design.assembled(df).withColumn("x", vector_to_array("features"))
    pick = {"age": "age", "pressure": "pressure", "automobile": "gender_AUTOMOBILE", "family_yes": "family_history_Yes"}
    return rounded(x.groupBy(F.col("y_true").alias("target")).agg(*[F.avg(F.col("x")[at[n]]).alias(k) for k, n in pick.items()]))


@query("logistic_holdout")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return rounded(M.train_test_metrics(M.fit_logistic(train, FULL), train, test))


@query("logistic_coefficients")
def _(spark, sf):
    return rounded(M.coefficient_table(M.fit_logistic(_survey(spark, sf), FULL)))


@query("boosted_holdout")
def _(spark, sf):
    train, test = _parts(spark, sf)
    model = M.fit_boosted(train, FULL, iterations=20, depth=4, learning_rate=0.1)
    return rounded(M.train_test_metrics(model, train, test))


@query("boosted_importance")
def _(spark, sf):
    model = M.fit_boosted(_survey(spark, sf), FULL, iterations=10, depth=4, learning_rate=0.1, early_stopping_rounds=None)
    return rounded(M.feature_importance(model, 5))


@query("boosted_regression")
def _(spark, sf):
    lines = fixtures.table(spark, sf, "lineitem").persist()
    roles = FULL.__class__("l_extendedprice", "l_orderkey", ["l_quantity", "l_discount", "l_tax"], [], ["l_returnflag"], None, [])
    design, model = M.fit_boosted_regression(lines, roles, iterations=10, depth=4)
    return rounded(M.regression_report(design, model, lines), 4)


@query("perceptron_holdout")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return rounded(M.train_test_metrics(M.fit_perceptron(train, FULL, hidden=16, max_iter=30), train, test), 4)


@query("gam_holdout")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return rounded(M.train_test_metrics(M.fit_gam_model(train, FULL), train, test), 4)


@query("gam_importance")
def _(spark, sf):
    df = _survey(spark, sf)
    model = M.fit_gam_model(df, FULL, n_splines=8, optimize=False).model
    return rounded(model.importance(df), 4)


@query("gam_partial_dependence")
def _(spark, sf):
    model = M.fit_gam_model(_survey(spark, sf), FULL, n_splines=8, optimize=False).model
    return rounded(model.partial_dependence(spark), 4)


@query("gam_interpretation")
def _(spark, sf):
    model = M.fit_gam_model(_survey(spark, sf), FULL, n_splines=8, optimize=False).model
    return rounded(model.interpretation(spark), 4)


@query("out_of_fold_metrics")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    return rounded(M.fold_metrics(M.out_of_fold(table, M.logistic_trainer())))


@query("cross_validation")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    return rounded(M.cross_validate(table, M.logistic_trainer()))


@query("parameter_search")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    space = {"C": (0.01, 10.0, "log"), "max_iter": (50, 200, "int")}
    trials, _best = M.search_params(table, M.logistic_trainer, space)
    return rounded(trials.select("trial", F.col("params")["C"].alias("C"), F.col("params")["max_iter"].alias("max_iter"), "mean_score", "std_score"))


@query("default_and_tuned")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    return rounded(M.compare_default_and_tuned(table, M.logistic_trainer, {"C": 1.0}, {"C": 0.1}))


_COEF = {"l_quantity": 0.0413, "l_discount": -3.0717, "l_tax": 1.5239}
_PHI = " UNION ALL ".join(f"SELECT k, '{c}' AS feature, {b}::DOUBLE*({c} - avg({c}) OVER ()) AS phi FROM l" for c, b in _COEF.items())
_L = "l AS (SELECT *, l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||l_extendedprice::BIGINT AS k FROM lineitem)"


def _lines(spark, sf):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice").cast("long"))
    return fixtures.table(spark, sf, "lineitem").withColumn("k", key)


@query("linear_contributions", f"""WITH {_L.replace('l_extendedprice::BIGINT', 'round(l_extendedprice)::BIGINT')}, p AS ({_PHI})
   SELECT k AS row_id, feature, phi FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(phi) DESC, feature) = 1""", "phi")
def _(spark, sf):
    phi = explain.linear_contributions(_lines(spark, sf), "k", _COEF)
    return rounded(explain.top_contributions(phi, list(_COEF), 1).select("row_id", "feature", "phi"))


@query("global_importance", f"WITH {_L}, p AS ({_PHI}) SELECT feature, avg(abs(phi)) AS importance, avg(phi) AS mean_phi, stddev_pop(phi) AS std_phi FROM p GROUP BY feature", "importance mean_phi std_phi")
def _(spark, sf):
    phi = explain.linear_contributions(_lines(spark, sf), "k", _COEF)
    return rounded(explain.global_importance(phi, list(_COEF))).withColumn("mean_phi", F.abs("mean_phi"))


@query("model_explanations")
def _(spark, sf):
    df = _survey(spark, sf)
    phi, names = explain.model_contributions(M.fit_logistic(df, FULL), df)
    return rounded(explain.global_importance(phi, names))


@query("permutation_importance")
def _(spark, sf):
    df = _survey(spark, sf)
    model = M.fit_boosted(df, FULL, iterations=5, depth=3, learning_rate=0.1, early_stopping_rounds=None)
    return rounded(explain.permutation_importance(model, df, ["sensitive", "age"]))


@query("sensitive_association", f"""{S}, o AS (SELECT sensitive AS l, target AS t, count(*)::DOUBLE AS n FROM survey GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY l)*sum(n) OVER (PARTITION BY t)/sum(n) OVER () AS e, sum(n) OVER () AS total FROM o),
   c AS (SELECT sum(pow(abs(n-e)-least(0.5,abs(n-e)),2)/e) AS chi2, any_value(total) AS total FROM e)
   SELECT total::BIGINT AS n, chi2, sqrt(chi2/total) AS cramers_v, CASE WHEN sqrt(chi2/total) > 0.5 THEN 'very strong' WHEN sqrt(chi2/total) > 0.3 THEN 'strong' WHEN sqrt(chi2/total) > 0.1 THEN 'moderate' ELSE 'weak' END AS strength FROM c""", "chi2 cramers_v")
def _(spark, sf):
    return rounded(leakage.sensitive_association(_survey(spark, sf), ROLES)["association"].select("n", "chi2", "cramers_v", "strength"))


@query("with_and_without_sensitive")
def _(spark, sf):
    return rounded(leakage.with_and_without(_survey(spark, sf), ROLES))


@query("leakage_coefficients")
def _(spark, sf):
    return rounded(leakage.top_coefficients(_survey(spark, sf), ROLES))


@query("fold_fit_gradients")
def _(spark, sf):
    design, table = _assembled(spark, sf)
    folds = split.stratified_folds(table, "row_id", "y_true", 5).persist()
    kept = tuple(i for i, owner in enumerate(design.owners) if owner != ROLES.sensitive)
    fits = [many.Fit(name, keep, fold) for name, keep in (("full", None), ("safe", kept)) for fold in range(5)]
    report = many.fit_many(folds, fits).report(spark)
    return rounded(report.select("model", "left_out", "n", "loss", (F.col("max_gradient") <= 1e-6).alias("at_optimum")))


@query("drop_one_column")
def _(spark, sf):
    return rounded(leakage.drop_one_column(_survey(spark, sf), ROLES))


@query("leakage_verdict")
def _(spark, sf):
    return rounded(leakage.investigate(_survey(spark, sf), ROLES, age="age", score="balance", city="city", binary="family_history"))


@query("cv_stability")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    return rounded(robustness.cv_stability(table, M.logistic_trainer()))


@query("noise_injection")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    return rounded(robustness.noise_test(table, M.logistic_trainer()))


@query("robustness_grade")
def _(spark, sf):
    _, table = _assembled(spark, sf, SAFE)
    return rounded(robustness.robustness_grade(robustness.noise_test(table, M.logistic_trainer())))


@query("feature_ablation")
def _(spark, sf):
    design, table = _assembled(spark, sf)
    return rounded(robustness.feature_ablation(table, design.feature_names, M.logistic_trainer(), GROUPS))


@query("label_flip")
def _(spark, sf):
    _, table = _assembled(spark, sf)
    return rounded(robustness.label_flip_test(table, M.logistic_trainer()))


@query("flipped_labels", f"""{S}, r AS (SELECT id, target, row_number() OVER (ORDER BY {u('id', 'flip')}, id) AS r FROM survey) SELECT id AS row_id, CASE WHEN r <= floor((SELECT count(*) FROM survey)*0.1) THEN 1-target ELSE target END::INTEGER AS y_true FROM r""")
def _(spark, sf):
    rows = fixtures.survey(spark, sf).select(F.col("id").alias("row_id"), F.col("target").alias("y_true"))
    return robustness.flipped(rows, 0.1)
