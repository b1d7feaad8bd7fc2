"""Group fairness of a scored table; every measure reads the same per-group counts."""

from __future__ import annotations

from collections.abc import Mapping
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.columns import by_families, column, count_if, labelled, ratio
from cohort.operators.evaluate import subgroup_metrics

# fixed limits of the pass rules
PARITY_LIMIT = 0.10
ODDS_LIMIT = 0.10
PRECISION_LIMIT = 0.10
IMPACT_FLOOR = 0.80
MIN_GROUP = 30


def group_rates(scored: DataFrame, families: Mapping[str, str | Column], min_size: int = MIN_GROUP) -> DataFrame:
    """Counts and rates per (family, label) with at least ``min_size`` rows."""
    long = by_families(scored, families, ["y_true", "y_pred"])
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    counts = long.groupBy("family", "label").agg(
        F.count(F.lit(1)).alias("n"), count_if(p).alias("flagged"), count_if(y).alias("positives"),
        count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"),
    ).filter(F.col("n") >= min_size)
    return counts.select(
        "family", "label", "n",
        ratio(F.col("flagged"), F.col("n")).alias("positive_rate"),
        ratio(F.col("tp"), F.col("positives"), 0.0).alias("tpr"),
        ratio(F.col("fp"), F.col("n") - F.col("positives"), 0.0).alias("fpr"),
        ratio(F.col("tp"), F.col("flagged"), 0.0).alias("precision"),
    )


def demographic_parity(rates: DataFrame, limit: float = PARITY_LIMIT) -> DataFrame:
    return rates.groupBy("family").agg(
        F.count(F.lit(1)).alias("groups"), F.min("positive_rate").alias("min_rate"),
        F.max("positive_rate").alias("max_rate"), F.stddev_pop("positive_rate").alias("rate_std"),
    ).select("*", (F.col("max_rate") - F.col("min_rate")).alias("max_difference"),
             (F.col("max_rate") - F.col("min_rate") < F.lit(limit)).alias("passes"))


def equalized_odds(rates: DataFrame, limit: float = ODDS_LIMIT) -> DataFrame:
    gaps = rates.groupBy("family").agg(
        (F.max("tpr") - F.min("tpr")).alias("tpr_max_diff"), (F.max("fpr") - F.min("fpr")).alias("fpr_max_diff")
    )
    tpr_ok, fpr_ok = F.col("tpr_max_diff") < F.lit(limit), F.col("fpr_max_diff") < F.lit(limit)
    return gaps.select("*", tpr_ok.alias("passes_tpr"), fpr_ok.alias("passes_fpr"), (tpr_ok & fpr_ok).alias("passes"))


def predictive_parity(rates: DataFrame, limit: float = PRECISION_LIMIT) -> DataFrame:
    gaps = rates.groupBy("family").agg((F.max("precision") - F.min("precision")).alias("max_difference"))
    return gaps.select("*", (F.col("max_difference") < F.lit(limit)).alias("passes"))


def disparate_impact(rates: DataFrame, floor: float = IMPACT_FLOOR) -> DataFrame:
    """Lowest over highest positive rate (the four-fifths rule); label order breaks ties."""
    ends = rates.groupBy("family").agg(
        F.min(F.struct("positive_rate", "label")).alias("lo"),
        F.min(F.struct((-F.col("positive_rate")).alias("neg"), F.col("label"))).alias("hi"),
    )
    impact = F.coalesce(ratio(F.col("lo.positive_rate"), -F.col("hi.neg")), F.lit(1.0))
    return ends.select(
        "family", F.col("lo.positive_rate").alias("min_rate"), (-F.col("hi.neg")).alias("max_rate"),
        F.col("lo.label").alias("min_group"), F.col("hi.label").alias("max_group"),
        impact.alias("impact_ratio"), (impact >= F.lit(floor)).alias("passes"),
    )


def theil_index(scored: DataFrame, families: Mapping[str, str | Column], min_size: int = MIN_GROUP) -> DataFrame:
    """Inequality of scores overall and per group: mean of r ln r with r = score / mean."""
    long = by_families(scored, {"overall": F.lit("all"), **families}, ["y_score"])
    score = column("y_score").cast("double")
    sums = long.groupBy("family", "label").agg(
        F.count(score).alias("n"), F.sum(score).alias("_s"), F.sum(F.when(score > 0, score)).alias("_over"),
        F.sum(F.when(score > 0, score * F.log(score))).alias("_log"), F.count(F.when(score <= 0, 1)).alias("_none"))
    mean = F.col("_s") / F.col("n")
    tiny = 1e-10  # a ratio of zero counts as this
    above = F.coalesce((F.col("_log") - F.log(mean) * F.col("_over")) / mean, F.lit(0.0))
    index = (above + F.col("_none") * F.lit(tiny * log(tiny))) / F.col("n")
    out = sums.select("family", "label", "n", F.when(mean > 0, index).otherwise(F.lit(0.0)).alias("theil"))
    return out.filter((F.col("n") >= min_size) | (F.col("family") == "overall")).select(
        "*", labelled(F.col("theil"), [(0.1, "Low"), (0.3, "Moderate")], "High").alias("level")
    )


def fairness_warnings(rates: DataFrame) -> DataFrame:
    """Failed rules with their severity."""
    spread = lambda c: F.max(c) - F.min(c)
    gaps = rates.groupBy("family").agg(
        F.coalesce(ratio(F.min("positive_rate"), F.max("positive_rate")), F.lit(1.0)).alias("impact_ratio"),
        spread("tpr").alias("tpr_max_diff"), spread("fpr").alias("fpr_max_diff"), spread("positive_rate").alias("max_difference"),
    )
    table = gaps.select(
        "*", (F.col("impact_ratio") >= IMPACT_FLOOR).alias("di_ok"), (F.col("tpr_max_diff") < ODDS_LIMIT).alias("passes_tpr"),
        (F.col("fpr_max_diff") < ODDS_LIMIT).alias("passes_fpr"), (F.col("max_difference") < PARITY_LIMIT).alias("dp_ok"))
    rules = [
        ("disparate_impact", "high", "di_ok", "impact_ratio"),
        ("equalized_odds_fpr", "medium", "passes_fpr", "fpr_max_diff"),
        ("equalized_odds_tpr", "medium", "passes_tpr", "tpr_max_diff"),
        ("demographic_parity", "low", "dp_ok", "max_difference"),
    ]
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.col(ok).alias("ok"), F.col(v).alias("value"))
                for t, s, ok, v in rules
            ]
        )
    )
    return table.select("family", rows.alias("r")).filter(~F.col("r.ok")).select(
        "r.type", F.col("family").alias("attribute"), "r.severity", "r.value"
    )


def fairness_table(scored: DataFrame, families: Mapping[str, str | Column], min_size: int = MIN_GROUP) -> DataFrame:
    """Per-group metrics beside the family's fairness measures, one row per (family, label)."""
    metrics = subgroup_metrics(scored, families, min_size).select(
        "family", "label", "n_samples", "n_positive", "prevalence", "roc_auc", "pr_auc", "accuracy",
        "precision", "recall", "f1", "specificity", "fpr", "fnr", "npv", "brier_score", "positive_rate",
    )
    family = Window.partitionBy("family")  # one row per group
    gap = lambda c: F.max(c).over(family) - F.min(c).over(family)
    return metrics.select(
        "*", gap("positive_rate").alias("parity_gap"), gap("recall").alias("tpr_gap"), gap("fpr").alias("fpr_gap"), gap("precision").alias("precision_gap"),
        F.coalesce(ratio(F.min("positive_rate").over(family), F.max("positive_rate").over(family)), F.lit(1.0)).alias("impact_ratio"))
