"""Evaluation, threshold and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AGE_BAND, FAMILIES, METRIC_FLOATS, MODELS, SCORED, metrics_sql, query
from cohort import fixtures
from cohort.functions.columns import rounded
from cohort.operators import evaluate, fairness, thresholds
from cohort.operators.clean import AGE_BANDS, band



def family_columns():
    """Attributes of the scored table that the subgroup queries look at."""
    return {"gender": "gender", "age": band("age", AGE_BANDS), "family_history": "family_history", "city": "city"}


W = f"WITH {SCORED}, {FAMILIES}"
_RATES = f"""rates AS (SELECT family, label, count(*) AS n, avg(y_pred) AS positive_rate,
   coalesce(sum(y_true*y_pred)/nullif(sum(y_true),0),0) AS tpr,
   coalesce(sum((1-y_true)*y_pred)/nullif(sum(1-y_true),0),0) AS fpr,
   coalesce(sum(y_true*y_pred)/nullif(sum(y_pred),0),0) AS precision
   FROM families WHERE label IS NOT NULL GROUP BY family, label HAVING count(*) >= 30)"""


@query("confusion_rates", f"""WITH {SCORED} SELECT gender, tp, fp, fn, tn, tp/(tp+fn) AS sensitivity, tn/(tn+fp) AS specificity,
    tp/(tp+fp) AS ppv, tn/(tn+fn) AS npv, fp/(fp+tn) AS fpr, fn/(fn+tp) AS fnr, (tp+tn)/(tp+fp+fn+tn) AS accuracy,
    (tp+fn)/(tp+fp+fn+tn) AS prevalence FROM (
    SELECT gender, count(*) FILTER (y_true=1 AND y_pred=1) AS tp, count(*) FILTER (y_true=0 AND y_pred=1) AS fp,
      count(*) FILTER (y_true=1 AND y_pred=0) AS fn, count(*) FILTER (y_true=0 AND y_pred=0) AS tn
    FROM scored GROUP BY gender)""", "sensitivity specificity ppv npv fpr fnr accuracy prevalence")
def _(spark, sf):
    return rounded(evaluate.confusion(fixtures.scored(spark, sf), ["gender"]))


@query("binary_metrics", f"WITH {SCORED} {metrics_sql('scored', '')}", METRIC_FLOATS)
def _(spark, sf):
    return rounded(evaluate.binary_metrics(fixtures.scored(spark, sf)))


@query("ranking_metrics_by_group", f"""WITH {SCORED} SELECT gender, n_samples, n_positive, roc_auc, pr_auc, brier_score
    FROM ({metrics_sql('scored', 'gender')})""", "roc_auc pr_auc brier_score")
def _(spark, sf):
    return rounded(evaluate.ranking_metrics(fixtures.scored(spark, sf), ["gender"]))


_CLASS = f"""WITH {SCORED}, labels_ AS (SELECT DISTINCT label FROM (SELECT y_true AS label FROM scored UNION SELECT y_pred FROM scored)),
  per AS (SELECT label::VARCHAR AS label, (SELECT count(*) FROM scored WHERE y_true=label) AS support,
    (SELECT count(*) FROM scored WHERE y_pred=label) AS predicted,
    (SELECT count(*) FROM scored WHERE y_true=label AND y_pred=label) AS hits FROM labels_),
  rep AS (SELECT label, hits/predicted AS precision, hits/support AS recall, 2.0*hits/(predicted+support) AS f1, support, predicted, hits FROM per)"""


@query("class_report", f"{_CLASS} SELECT * FROM rep", "precision recall f1")
def _(spark, sf):
    return rounded(evaluate.class_report(fixtures.scored(spark, sf)))


@query("averaged_metrics", f"""{_CLASS}, acc AS (SELECT sum(hits)/sum(support) AS accuracy FROM rep)
  SELECT 'binary' AS average, accuracy, precision, recall, f1 FROM rep, acc WHERE label='1'
  UNION ALL SELECT 'micro', accuracy, accuracy, accuracy, accuracy FROM acc
  UNION ALL SELECT 'macro', any_value(accuracy), avg(precision), avg(recall), avg(f1) FROM rep, acc
  UNION ALL SELECT 'weighted', any_value(accuracy), sum(precision*support)/sum(support), sum(recall*support)/sum(support),
    sum(f1*support)/sum(support) FROM rep, acc""", "accuracy precision recall f1")
def _(spark, sf):
    return rounded(evaluate.averaged_metrics(fixtures.scored(spark, sf)))


@query("regression_metrics", """SELECT l_returnflag, count(*) AS n, avg(e*e) AS mse, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae,
    1 - sum(e*e)/sum((l_quantity-m)*(l_quantity-m)) AS r2, 100*avg(CASE WHEN l_quantity<>0 THEN abs(e/l_quantity) END) AS mape,
    avg(e) AS residual_mean, stddev_pop(e) AS residual_std, min(e) AS residual_min, max(e) AS residual_max
  FROM (SELECT *, l_quantity - l_extendedprice/1500 AS e, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
  GROUP BY l_returnflag""", "mse rmse mae r2 mape residual_mean residual_std residual_min residual_max")
def _(spark, sf):
    lines = fixtures.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", (F.col("l_extendedprice") / F.lit(1500.0)).alias("guess"))
    return rounded(evaluate.regression_metrics(lines, "l_quantity", "guess", ["l_returnflag"]))


@query("calibration_curve", f"""WITH {SCORED} SELECT greatest(ceil(round(y_score*100)/10),1)::INTEGER AS bin, count(*) AS n,
    avg(y_true) AS prob_true, avg(y_score) AS prob_pred FROM scored GROUP BY ALL""", "prob_true prob_pred")
def _(spark, sf):
    return rounded(evaluate.calibration_bins(fixtures.scored(spark, sf)))


@query("calibration_error", f"""WITH {MODELS}, bins AS (SELECT model, least(floor(round(y_score*100)/10),9) AS b, count(*) AS n,
    abs(sum(y_true)/count(*) - sum(round(y_score*1000000))/1000000.0/count(*)) AS gap FROM models GROUP BY ALL)
  SELECT model, sum(n)::BIGINT AS n_samples, count(*) AS bins_used, sum(n*gap)/sum(n) AS ece, max(gap) AS mce FROM bins GROUP BY model""", "ece mce")
def _(spark, sf):
    return rounded(evaluate.calibration_error(fixtures.scored_models(spark, sf), ["model"]))


@query("calibration_error_right_closed", f"""WITH {MODELS}, bins AS (SELECT model, ceil(round(y_score*100)/10) AS b, count(*) AS n,
    abs(sum(y_true)/count(*) - sum(round(y_score*1000000))/1000000.0/count(*)) AS gap FROM models WHERE y_score > 0 GROUP BY ALL)
  SELECT model, (SELECT count(*) FROM scored) AS n_samples, count(*) AS bins_used,
    sum(n*gap)/(SELECT count(*) FROM scored) AS ece, max(gap) AS mce FROM bins GROUP BY model""", "ece mce")
def _(spark, sf):
    return rounded(evaluate.calibration_error(fixtures.scored_models(spark, sf), ["model"], closed="right-open-zero"))


def _sweep_sql(source: str, by: str, low: int, high: int, step: int = 1) -> str:
    comma = f"{by}," if by else ""
    cut = "(round(y_score*100) >= t)"
    return f"""SELECT {comma} t/100.0::DOUBLE AS threshold, tp, fp, fn, tn, coalesce(tp/nullif(tp+fn,0),0) AS recall,
        coalesce(tn/nullif(tn+fp,0),0) AS specificity, coalesce(tp/nullif(tp+fp,0),0) AS precision,
        coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0) AS f1, coalesce(fp/nullif(tn+fp,0),0) AS fpr, coalesce(fn/nullif(tp+fn,0),0) AS fnr,
        coalesce(tp/nullif(tp+fn,0),0) + coalesce(tn/nullif(tn+fp,0),0) - 1 AS youden_j, (2.0*fn+fp)::DOUBLE AS total_cost,
        (2.0*fn+fp)/(tp+fp+fn+tn) AS cost_per_sample, tp+fp AS n_flagged, 100.0*(tp+fp)/(tp+fp+fn+tn) AS flagged_pct
      FROM (SELECT {comma} t, count(*) FILTER (y_true=1 AND {cut}) AS tp, count(*) FILTER (y_true=0 AND {cut}) AS fp,
              count(*) FILTER (y_true=1 AND NOT {cut}) AS fn, count(*) FILTER (y_true=0 AND NOT {cut}) AS tn
            FROM {source}, range({low},{high + 1},{step}) g(t) GROUP BY ALL)"""


_SWEEP_FLOATS = "threshold recall specificity precision f1 fpr fnr youden_j total_cost cost_per_sample flagged_pct"


@query("threshold_sweep", f"WITH {MODELS} {_sweep_sql('models', 'model', 10, 89)}", _SWEEP_FLOATS)
def _(spark, sf):
    return rounded(thresholds.threshold_sweep(fixtures.scored_models(spark, sf), by=["model"]))


@query("threshold_sweep_coarse", f"WITH {SCORED} {_sweep_sql('scored', '', 10, 90, 5)}", _SWEEP_FLOATS)
def _(spark, sf):
    return rounded(thresholds.threshold_sweep(fixtures.scored(spark, sf), thresholds.SERVICE_GRID))


def _pick(policy: str, order: str, where: str = "true") -> str:
    return f"""SELECT model, '{policy}' AS policy, threshold, recall, precision, f1, fnr, youden_j, cost_per_sample FROM (
      SELECT *, row_number() OVER (PARTITION BY model ORDER BY {order}, threshold) AS rn FROM sweep WHERE {where}) WHERE rn=1"""


@query("threshold_picks", f"""WITH {MODELS}, sweep AS ({_sweep_sql('models', 'model', 10, 89)})
  {_pick('best_f1', 'round(f1,4) DESC')} UNION ALL {_pick('best_youden', 'round(youden_j,4) DESC')}
  UNION ALL {_pick('min_cost', 'round(cost_per_sample,4)')} UNION ALL {_pick('screening', 'round(recall,4) DESC')}
  UNION ALL {_pick('recall_first', 'round(f1,4) DESC', 'fnr < 0.15')}""", "threshold recall precision f1 fnr youden_j cost_per_sample")
def _(spark, sf):
    return rounded(thresholds.threshold_report(fixtures.scored_models(spark, sf), by=["model"])["picks"])


@query("decision_curve", f"""WITH {MODELS}, grid AS (SELECT 0.01::DOUBLE + i*0.98::DOUBLE/99 AS threshold FROM range(100) r(i))
  SELECT model, threshold, count(*) FILTER (y_true=1 AND flag)/count(*) - count(*) FILTER (y_true=0 AND flag)/count(*)*threshold/(1-threshold) AS net_benefit,
    avg(y_true) - (1-avg(y_true))*threshold/(1-threshold) AS treat_all, 0.0::DOUBLE AS treat_none
  FROM (SELECT *, round(y_score*1000000) >= threshold*1000000 - 0.000001::DOUBLE AS flag FROM models, grid) GROUP BY model, threshold""", "threshold net_benefit treat_all")
def _(spark, sf):
    return rounded(thresholds.decision_curve(fixtures.scored_models(spark, sf), ["model"]))


@query("optimal_thresholds", f"""WITH {MODELS}, sweep AS ({_sweep_sql('models', 'model', 10, 89)})
  SELECT model, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn FROM sweep) WHERE rn=1""", "threshold f1")
def _(spark, sf):
    return rounded(thresholds.optimal_threshold(fixtures.scored_models(spark, sf)))


@query("subgroup_metrics", f"""{W} SELECT * FROM ({metrics_sql('(SELECT * FROM families WHERE label IS NOT NULL)', 'family, label')}) WHERE n_samples >= 30""", METRIC_FLOATS)
def _(spark, sf):
    return rounded(evaluate.subgroup_metrics(fixtures.scored(spark, sf), family_columns()))


@query("subgroup_ranges", f"""{W}, m AS (SELECT * FROM ({metrics_sql('(SELECT * FROM families WHERE label IS NOT NULL)', 'family, label')}) WHERE n_samples >= 30),
   r AS (SELECT family, count(*) AS groups, max(roc_auc)-min(roc_auc) AS roc_auc_range, max(fpr)-min(fpr) AS fpr_range, max(fnr)-min(fnr) AS fnr_range FROM m GROUP BY family)
   SELECT *, roc_auc_range > 0.05 AS roc_auc_flag, fpr_range > 0.1 AS fpr_flag, fnr_range > 0.1 AS fnr_flag FROM r""", "roc_auc_range fpr_range fnr_range")
def _(spark, sf):
    return rounded(evaluate.group_ranges(evaluate.subgroup_metrics(fixtures.scored(spark, sf), family_columns())))


@query("subgroup_calibration", f"""{W}, bins AS (SELECT family, label, least(floor(round(y_score*100)/10),9) AS b, count(*) AS n,
    abs(sum(y_true)/count(*) - sum(round(y_score*1000000))/1000000.0/count(*)) AS gap FROM families WHERE label IS NOT NULL GROUP BY ALL)
  SELECT family, label, sum(n)::BIGINT AS n_samples, count(*) AS bins_used, sum(n*gap)/sum(n) AS ece, max(gap) AS mce
  FROM bins GROUP BY family, label HAVING sum(n) >= 30""", "ece mce")
def _(spark, sf):
    return rounded(evaluate.subgroup_calibration(fixtures.scored(spark, sf), family_columns()))


@query("subgroup_thresholds", f"""{W}, src AS (SELECT 'Overall' AS family, 'Overall' AS label, y_true, y_score FROM scored
    UNION ALL SELECT family, label, y_true, y_score FROM families WHERE label IS NOT NULL),
  sweep AS ({_sweep_sql('src', 'family, label', 5, 95)}),
  a AS (SELECT family, label, tp+fp+fn+tn AS n_samples, threshold, f1 FROM sweep QUALIFY row_number() OVER (PARTITION BY family, label ORDER BY f1 DESC, threshold)=1),
  b AS (SELECT family, label, threshold, cost_per_sample FROM sweep QUALIFY row_number() OVER (PARTITION BY family, label ORDER BY total_cost, threshold)=1)
  SELECT a.family, a.label, n_samples, a.threshold AS f1_optimal_threshold, f1 AS f1_optimal_value, b.threshold AS cost_optimal_threshold,
    cost_per_sample AS cost_optimal_value FROM a JOIN b ON a.family=b.family AND a.label=b.label WHERE n_samples >= 30""",
       "f1_optimal_threshold f1_optimal_value cost_optimal_threshold cost_optimal_value")
def _(spark, sf):
    return rounded(thresholds.subgroup_thresholds(fixtures.scored(spark, sf), family_columns()))


@query("demographic_parity", f"""{W}, {_RATES} SELECT family, count(*) AS groups, min(positive_rate) AS min_rate, max(positive_rate) AS max_rate,
   stddev_pop(positive_rate) AS rate_std, max(positive_rate)-min(positive_rate) AS max_difference,
   max(positive_rate)-min(positive_rate) < 0.1 AS passes FROM rates GROUP BY family""", "min_rate max_rate rate_std max_difference")
def _(spark, sf):
    return rounded(fairness.demographic_parity(fairness.group_rates(fixtures.scored(spark, sf), family_columns())))


@query("equalized_odds", f"""{W}, {_RATES}, g AS (SELECT family, max(tpr)-min(tpr) AS tpr_max_diff, max(fpr)-min(fpr) AS fpr_max_diff FROM rates GROUP BY family)
   SELECT *, tpr_max_diff < 0.1 AS passes_tpr, fpr_max_diff < 0.1 AS passes_fpr, tpr_max_diff < 0.1 AND fpr_max_diff < 0.1 AS passes FROM g""", "tpr_max_diff fpr_max_diff")
def _(spark, sf):
    return rounded(fairness.equalized_odds(fairness.group_rates(fixtures.scored(spark, sf), family_columns())))


@query("predictive_parity", f"""{W}, {_RATES} SELECT family, max(precision)-min(precision) AS max_difference,
   max(precision)-min(precision) < 0.1 AS passes FROM rates GROUP BY family""", "max_difference")
def _(spark, sf):
    return rounded(fairness.predictive_parity(fairness.group_rates(fixtures.scored(spark, sf), family_columns())))


_IMPACT = f"""{_RATES}, impact AS (SELECT family, min(positive_rate) AS min_rate, max(positive_rate) AS max_rate,
   (list(label ORDER BY positive_rate, label))[1] AS min_group, (list(label ORDER BY positive_rate DESC, label))[1] AS max_group,
   coalesce(min(positive_rate)/nullif(max(positive_rate),0),1) AS impact_ratio FROM rates GROUP BY family)"""


@query("disparate_impact", f"{W}, {_IMPACT} SELECT *, impact_ratio >= 0.8 AS passes FROM impact", "min_rate max_rate impact_ratio")
def _(spark, sf):
    return rounded(fairness.disparate_impact(fairness.group_rates(fixtures.scored(spark, sf), family_columns())))


@query("theil_index", f"""{W}, src AS (SELECT 'overall' AS family, 'all' AS label, y_score FROM scored UNION ALL
     SELECT family, label, y_score FROM families WHERE label IS NOT NULL),
   r AS (SELECT family, label, greatest(y_score/avg(y_score) OVER (PARTITION BY family, label), CASE WHEN y_score > 0 THEN 0 ELSE 1e-10 END) AS r FROM src),
   t AS (SELECT family, label, count(*) AS n, avg(r*ln(r)) AS theil FROM r GROUP BY family, label)
   SELECT *, CASE WHEN theil < 0.1 THEN 'Low' WHEN theil < 0.3 THEN 'Moderate' ELSE 'High' END AS level FROM t WHERE n >= 30 OR family='overall'""", "theil")
def _(spark, sf):
    return rounded(fairness.theil_index(fixtures.scored(spark, sf), family_columns()))


@query("fairness_warnings", f"""{W}, {_IMPACT}, g AS (SELECT family, max(tpr)-min(tpr) AS tpr, max(fpr)-min(fpr) AS fpr, max(positive_rate)-min(positive_rate) AS dp FROM rates GROUP BY family)
   SELECT 'disparate_impact' AS type, family AS attribute, 'high' AS severity, impact_ratio AS value FROM impact WHERE impact_ratio < 0.8
   UNION ALL SELECT 'equalized_odds_fpr', family, 'medium', fpr FROM g WHERE fpr >= 0.1
   UNION ALL SELECT 'equalized_odds_tpr', family, 'medium', tpr FROM g WHERE tpr >= 0.1
   UNION ALL SELECT 'demographic_parity', family, 'low', dp FROM g WHERE dp >= 0.1""", "value")
def _(spark, sf):
    return rounded(fairness.fairness_warnings(fairness.group_rates(fixtures.scored(spark, sf), family_columns())))


@query("fairness_table", f"""{W}, m AS (SELECT * FROM ({metrics_sql('(SELECT * FROM families WHERE label IS NOT NULL)', 'family, label')}) WHERE n_samples >= 30)
  SELECT family, label, n_samples, n_positive, prevalence, roc_auc, pr_auc, accuracy, precision, recall, f1, specificity, fpr, fnr, npv, brier_score, positive_rate,
   max(positive_rate) OVER f - min(positive_rate) OVER f AS parity_gap, max(recall) OVER f - min(recall) OVER f AS tpr_gap,
   max(fpr) OVER f - min(fpr) OVER f AS fpr_gap, max(precision) OVER f - min(precision) OVER f AS precision_gap,
   coalesce(min(positive_rate) OVER f/nullif(max(positive_rate) OVER f,0),1) AS impact_ratio
  FROM m WINDOW f AS (PARTITION BY family)""", METRIC_FLOATS + " parity_gap tpr_gap fpr_gap precision_gap impact_ratio")
def _(spark, sf):
    return rounded(fairness.fairness_table(fixtures.scored(spark, sf), family_columns()))


@query("error_counts", f"""WITH {SCORED} SELECT outcome, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY outcome IN ('TP','FN')) AS rate FROM (
   SELECT CASE WHEN y_true=1 THEN CASE WHEN y_pred=1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN y_pred=1 THEN 'FP' ELSE 'TN' END END AS outcome FROM scored)
   GROUP BY outcome""", "rate")
def _(spark, sf):
    return rounded(evaluate.error_counts(fixtures.scored(spark, sf)))


@query("error_scores", f"""WITH {SCORED} SELECT CASE WHEN y_true=1 THEN 'FN' ELSE 'FP' END AS outcome, count(*) AS n, avg(y_score) AS mean, stddev_pop(y_score) AS std,
   min(y_score) AS min, max(y_score) AS max, quantile_cont(y_score, 0.5) AS median FROM scored WHERE y_true <> y_pred GROUP BY 1""", "mean std min max median")
def _(spark, sf):
    return rounded(evaluate.error_scores(fixtures.scored(spark, sf)))


@query("error_profiles", f"""WITH {SCORED}, e AS (SELECT *, CASE WHEN y_true=1 THEN 'FN' ELSE 'FP' END AS outcome FROM scored WHERE y_true <> y_pred)
   SELECT outcome, 'gender' AS "column", gender AS value, count(*) AS n FROM e GROUP BY ALL UNION ALL
   SELECT outcome, 'age', age::VARCHAR, count(*) FROM e GROUP BY ALL UNION ALL
   SELECT outcome, 'family_history', family_history, count(*) FROM e GROUP BY ALL""")
def _(spark, sf):
    return evaluate.error_profiles(fixtures.scored(spark, sf), ["gender", "age", "family_history"])
