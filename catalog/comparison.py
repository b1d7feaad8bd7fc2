"""Split, fold, sampling and model-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import METRIC_FLOATS, MODELS, SCORED, SURVEY, metrics_sql, query, u
from cohort import fixtures
from cohort.functions.columns import rounded
from cohort.operators import compare, evaluate, split, stats

S = f"WITH {SURVEY}"
_SPLIT = f"""base AS (SELECT *, target::VARCHAR||'_'||gender||'_'||family_history AS full_ FROM survey),
  strat AS (SELECT b.*, CASE WHEN count(*) OVER (PARTITION BY full_) = 1 THEN target::VARCHAR ELSE full_ END AS stratum FROM base b),
  sizes AS (SELECT stratum, count(*) AS n, (SELECT count(*) FROM survey) AS total, ceil(round(0.2*(SELECT count(*) FROM survey),9))::BIGINT AS test FROM strat GROUP BY stratum),
  quota AS (SELECT stratum, (n*test)//total + (row_number() OVER (ORDER BY (n*test)%total DESC, stratum) <= any_value(test) OVER () - sum((n*test)//total) OVER ())::INT AS q FROM sizes),
  split AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.stratum ORDER BY {u('id', 'split')}, id) <= q THEN 'test' ELSE 'train' END AS split FROM strat s JOIN quota USING (stratum))"""


def _split(spark, sf):
    return split.stratified_split(fixtures.survey(spark, sf), "id", "target", None)


@query("stratified_split", f"{S}, {_SPLIT} SELECT id, split FROM split")
def _(spark, sf):
    return _split(spark, sf).select("id", "split")


@query("target_split", f"""{S}, sizes AS (SELECT target, count(*) AS n, (SELECT count(*) FROM survey) AS total, ceil(round(0.25*(SELECT count(*) FROM survey),9))::BIGINT AS test FROM survey GROUP BY target),
  quota AS (SELECT target, (n*test)//total + (row_number() OVER (ORDER BY (n*test)%total DESC, target) <= any_value(test) OVER () - sum((n*test)//total) OVER ())::INT AS q FROM sizes)
  SELECT id, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY {u('id', 'split')}, id) <= q THEN 'test' ELSE 'train' END AS split FROM survey JOIN quota USING (target)""")
def _(spark, sf):
    return split.target_split(fixtures.survey(spark, sf), "id", "target", 0.25).select("id", "split")


@query("rows_by_membership", f"{S}, {_SPLIT} SELECT id, price, city FROM split WHERE split='test'")
def _(spark, sf):
    members = _split(spark, sf).filter("split = 'test'")
    return split.take_rows(fixtures.survey(spark, sf), "id", members).select("id", "price", "city")


@query("stratified_folds", f"{S} SELECT id, ((row_number() OVER (PARTITION BY target ORDER BY {u('id', 'fold')}, id) - 1) % 5)::INTEGER AS fold FROM survey")
def _(spark, sf):
    return split.stratified_folds(fixtures.survey(spark, sf), "id", "target").select("id", "fold")


@query("undersample", f"""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {u('doc_id', 'under')}, doc_id) AS r FROM labels)
   WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def _(spark, sf):
    return split.undersample(fixtures.table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "quality")


_BAL = lambda c: f"""SELECT '{c}' AS "column", {c}::VARCHAR AS level, count(*) AS n_total, count(*) FILTER (split='train') AS n_train, count(*) FILTER (split='test') AS n_test,
   100.0*count(*)/(SELECT count(*) FROM split) AS total_pct, 100.0*count(*) FILTER (split='train')/(SELECT count(*) FROM split WHERE split='train') AS train_pct,
   100.0*count(*) FILTER (split='test')/(SELECT count(*) FROM split WHERE split='test') AS test_pct FROM split GROUP BY 2"""  # noqa: E731


@query("split_balance", f"""{S}, {_SPLIT} SELECT *, greatest(abs(train_pct-total_pct), abs(test_pct-total_pct)) AS max_diff FROM ({_BAL('target')} UNION ALL {_BAL('gender')} UNION ALL {_BAL('family_history')})""",
       "total_pct train_pct test_pct max_diff")
def _(spark, sf):
    return rounded(split.split_balance(_split(spark, sf), ["target", "gender", "family_history"]))


@query("split_ks")
def _(spark, sf):
    return rounded(split.split_report(_split(spark, sf), "target", ["gender"], ["age", "balance", "price"])["ks"])


@query("align_models", f"""WITH {MODELS} SELECT a.row_id, a.y_true, a.y_score AS score_0, b.y_score AS score_1, a.y_pred AS pred_0, b.y_pred AS pred_1 FROM scored a JOIN scored2 b USING (row_id)""")
def _(spark, sf):
    return compare.align_models(fixtures.scored_models(spark, sf))


@query("mcnemar", f"""WITH {MODELS}, c AS (SELECT 'first' AS model1, 'second' AS model2, count(*) FILTER (a.y_pred=a.y_true AND b.y_pred=b.y_true) AS both_correct, count(*) FILTER (a.y_pred<>a.y_true AND b.y_pred<>b.y_true) AS both_wrong,
   count(*) FILTER (a.y_pred=a.y_true AND b.y_pred<>b.y_true) AS only_first, count(*) FILTER (a.y_pred<>a.y_true AND b.y_pred=b.y_true) AS only_second FROM scored a JOIN scored2 b USING (row_id))
   SELECT *, pow(abs(only_first-only_second)-1,2)/(only_first+only_second) AS chi2 FROM c""", "chi2")
def _(spark, sf):
    return rounded(compare.mcnemar(fixtures.scored_models(spark, sf)).drop("p", "significant"))


@query("auc_bootstrap_test")
def _(spark, sf):
    return rounded(compare.auc_bootstrap_test(fixtures.scored_models(spark, sf), "first", "second"))


@query("bootstrap_intervals")
def _(spark, sf):
    return rounded(compare.bootstrap_ci(fixtures.scored(spark, sf)))


_PLACED = """SELECT *, (sum((y_true=0)::INT) OVER (PARTITION BY model ORDER BY y_score) - sum((y_true=0)::INT) OVER (PARTITION BY model, y_score)/2.0)/sum((y_true=0)::INT) OVER (PARTITION BY model) AS below,
   (sum(y_true) OVER (PARTITION BY model) - sum(y_true) OVER (PARTITION BY model ORDER BY y_score) + sum(y_true) OVER (PARTITION BY model, y_score)/2.0)/sum(y_true) OVER (PARTITION BY model) AS above FROM models"""


@query("auc_variance", f"""WITH {MODELS}, p AS ({_PLACED}), s AS (SELECT sum(y_true)::BIGINT AS n_pos, sum(1-y_true)::BIGINT AS n_neg, avg(below) FILTER (y_true=1) AS auc,
   var_samp(below) FILTER (y_true=1)/sum(y_true) + var_samp(above) FILTER (y_true=0)/sum(1-y_true) AS variance FROM p WHERE model='first')
   SELECT n_pos, n_neg, auc, variance*1e6 AS variance_ppm, sqrt(variance) AS se, greatest(auc-1.959963984540054*sqrt(variance), 0.0) AS ci_lower, least(auc+1.959963984540054*sqrt(variance), 1.0) AS ci_upper FROM s""",
   "auc variance_ppm se ci_lower ci_upper")
def _(spark, sf):
    out = compare.auc_variance(fixtures.scored(spark, sf))
    return rounded(out.withColumn("variance_ppm", F.col("variance") * 1e6).drop("variance"))


@query("auc_difference", f"""WITH {MODELS}, p AS ({_PLACED}), w AS (SELECT a.y_true, a.below AS b1, b.below AS b2, a.above AS a1, b.above AS a2 FROM p a JOIN p b USING (row_id) WHERE a.model='first' AND b.model='second')
   SELECT 'first' AS model1, 'second' AS model2, avg(b1) FILTER (y_true=1) AS auc1, avg(b2) FILTER (y_true=1) AS auc2, avg(b1-b2) FILTER (y_true=1) AS auc_diff,
     (var_samp(b1-b2) FILTER (y_true=1)/sum(y_true) + var_samp(a1-a2) FILTER (y_true=0)/sum(1-y_true))*1e6 AS variance_ppm,
     avg(b1-b2) FILTER (y_true=1)/sqrt(var_samp(b1-b2) FILTER (y_true=1)/sum(y_true) + var_samp(a1-a2) FILTER (y_true=0)/sum(1-y_true)) AS z FROM w""", "auc1 auc2 auc_diff variance_ppm z")
def _(spark, sf):
    out = compare.auc_difference_test(fixtures.scored_models(spark, sf), "first", "second")
    return rounded(out.withColumn("variance_ppm", F.col("variance") * 1e6).drop("variance", "p"))


_SWEEP = """sweep AS (SELECT model, t/100.0::DOUBLE AS threshold, 2.0*count(*) FILTER (y_true=1 AND round(y_score*100)>=t)/(sum(y_true)+count(*) FILTER (round(y_score*100)>=t)) AS f1 FROM models, range(10,90) g(t) GROUP BY model, t)"""


@query("model_comparison", f"""WITH {MODELS}, m AS ({metrics_sql('models', 'model')}), {_SWEEP}, best AS (SELECT model, threshold AS f1_threshold, f1 AS best_f1 FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold)=1)
   SELECT (row_number() OVER (ORDER BY roc_auc DESC, model))::INTEGER AS rank, model, roc_auc, pr_auc, f1, brier_score, recall, precision, accuracy, specificity, fpr, fnr, npv, prevalence, n_samples, n_positive, f1_threshold, best_f1
   FROM m JOIN best USING (model)""", METRIC_FLOATS.replace("positive_rate ", "") + " f1_threshold best_f1")
def _(spark, sf):
    return rounded(compare.compare_models(fixtures.scored_models(spark, sf)))


def _profile_metrics(spark, sf):
    """Both score columns as a safe and a full profile of two models, per nation half."""
    rows = fixtures.scored_models(spark, sf).withColumn("profile", F.when(F.col("row_id") % 2 == 0, "safe").otherwise("full"))
    renamed = rows.withColumn("model", F.when(F.col("model") == "first", "logistic").otherwise("gam"))
    return evaluate.binary_metrics(renamed, ["profile", "model"])


_PM = f"""WITH {MODELS}, tagged AS (SELECT CASE WHEN row_id % 2 = 0 THEN 'safe' ELSE 'full' END AS profile, CASE model WHEN 'first' THEN 'logistic' ELSE 'gam' END AS model, y_true, y_score, y_pred FROM models),
   pm AS ({metrics_sql('tagged', 'profile, model')})"""


@query("profile_delta", f"""{_PM} SELECT model, s.roc_auc AS safe_roc_auc, s.f1 AS safe_f1, f.roc_auc AS full_roc_auc, f.f1 AS full_f1, f.roc_auc-s.roc_auc AS roc_auc_delta, f.f1-s.f1 AS f1_delta
   FROM (SELECT * FROM pm WHERE profile='safe') s JOIN (SELECT * FROM pm WHERE profile='full') f USING (model)""", "safe_roc_auc safe_f1 full_roc_auc full_f1 roc_auc_delta f1_delta")
def _(spark, sf):
    return rounded(compare.profile_delta(_profile_metrics(spark, sf)))


@query("best_deployable", f"""{_PM} SELECT profile, model, roc_auc, pr_auc, f1, 0.5::DOUBLE AS threshold, 'default_0.5' AS threshold_source, true AS threshold_warning, profile='full' AS profile_warning
   FROM pm ORDER BY roc_auc DESC, pr_auc DESC, f1 DESC, CASE model WHEN 'logistic' THEN 1 ELSE 2 END DESC, CASE profile WHEN 'full' THEN 1 ELSE 2 END DESC LIMIT 1""", "roc_auc pr_auc f1")
def _(spark, sf):
    return rounded(compare.best_deployable(_profile_metrics(spark, sf)))


@query("best_for_report", f"{_PM} SELECT profile, model, roc_auc, pr_auc, f1 FROM pm WHERE profile='safe' ORDER BY roc_auc DESC, pr_auc DESC, f1 DESC, model DESC LIMIT 1", "roc_auc pr_auc f1")
def _(spark, sf):
    return rounded(compare.best_for_report(_profile_metrics(spark, sf)))
