"""Evaluation of scored tables: ``row_id, y_true, y_score, y_pred`` plus attributes.

Scores are compared as they are, without rounding. Rows are first counted per (group, score)
on the map side; distinct scores are then cut into range buckets, so no window sorts more than
a bucket of one group however many different scores there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.columns import by_families, column, count_if, ratio
from cohort.operators.rank import bucket_sql, quantiles, range_bounds, running_totals

def score_cells(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row counts per (by, score): ``pos neg`` and the confusion cells at the given ``y_pred``."""
    y = F.col("y_true") == 1
    aggs = [count_if(y).alias("pos"), count_if(~y).alias("neg")]
    if "y_pred" in scored.columns:
        p = F.col("y_pred") == 1
        aggs += [
            count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"),
            count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn"),
        ]
    return scored.groupBy(*[column(c) for c in by], (column("y_score").cast("double") + F.lit(0.0)).alias("score")).agg(*aggs)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column, empty: float | None = 0.0) -> dict[str, Column]:
    n = tp + fp + fn + tn
    precision, recall = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return {
        "accuracy": ratio(tp + tn, n, empty),
        "precision": precision,
        "recall": recall,
        "specificity": ratio(tn, tn + fp, empty),
        "f1": ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn, 0.0),
        "fpr": ratio(fp, fp + tn, empty),
        "fnr": ratio(fn, fn + tp, empty),
        "npv": ratio(tn, tn + fn, empty),
    }


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix and the rates read off it, one row per group."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    counts = scored.groupBy(*[column(c) for c in by]).agg(
        count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"),
        count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn"),
    )
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    rates = _rates(*cells)
    return counts.select(
        *[column(c) for c in by], *["tp", "fp", "fn", "tn"],
        rates["recall"].alias("sensitivity"), rates["specificity"].alias("specificity"),
        rates["precision"].alias("ppv"), rates["npv"].alias("npv"),
        rates["fpr"].alias("fpr"), rates["fnr"].alias("fnr"), rates["accuracy"].alias("accuracy"),
        ratio(F.col("tp") + F.col("fn"), sum(cells[1:], cells[0])).alias("prevalence"),
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = (), min_size: int = 0) -> DataFrame:
    """All scalar metrics of a scored table per group, from one shuffle of score counts.

    ``roc_auc`` counts a tied pair as one half, ``pr_auc`` takes a block of tied scores as
    one step; both are null where only one class is present.
    """
    keys = [column(c) for c in by]
    cells = score_cells(scored, by)
    bounds = range_bounds(scored, ["y_score"])["y_score"]
    walked = running_totals(cells, "score", ["pos", "neg"], by, F.expr(bucket_sql("score", bounds)))
    # rows flagged at this score or above
    tp_here = (F.col("tot_pos") - F.col("cum_pos") + F.col("pos")).cast("double")
    fp_here = (F.col("tot_neg") - F.col("cum_neg") + F.col("neg")).cast("double")
    score = F.col("score")
    below = (F.col("cum_neg") - F.col("neg")).cast("double") + F.col("neg").cast("double") / F.lit(2.0)
    sums = walked.groupBy(*keys).agg(
        F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("tn").alias("tn"),
        F.sum(F.col("pos").cast("double") * below).alias("_wins"),
        F.sum(F.col("pos").cast("double") * tp_here / (tp_here + fp_here)).alias("_ap"),
        F.sum(
            F.col("pos").cast("double") * F.pow(F.lit(1.0) - score, F.lit(2.0))
            + F.col("neg").cast("double") * F.pow(score, F.lit(2.0))
        ).alias("_sq"),
    )
    n = F.col("n_positive") + F.col("n_negative")
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    out = sums.select(
        *keys, n.alias("n_samples"), "n_positive", "n_negative",
        ratio(F.col("n_positive"), n).alias("prevalence"),
        ratio(F.col("tp") + F.col("fp"), n).alias("positive_rate"),
        F.when(both, F.col("_wins") / (F.col("n_positive").cast("double") * F.col("n_negative"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("n_positive")).alias("pr_auc"),
        ratio(F.col("_sq"), n).alias("brier_score"),
        *[c.alias(k) for k, c in rates.items()],
        "tp", "fp", "fn", "tn",
    )
    return out.filter(F.col("n_samples") >= min_size) if min_size else out


def with_predictions(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("y_pred", (column("y_score").cast("double") >= F.lit(float(threshold))).cast("int"))


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, PR-AUC and Brier score for a table without predictions."""
    source = scored if "y_pred" in scored.columns else with_predictions(scored, 0.5)
    return binary_metrics(source, by).select(
        *[column(c) for c in by], "n_samples", "n_positive", "roc_auc", "pr_auc", "brier_score"
    )


def subgroup_metrics(
    scored: DataFrame, families: Mapping[str, str | Column], min_size: int = 30
) -> DataFrame:
    """``binary_metrics`` for every label of every attribute, all attributes in one pass."""
    long = by_families(scored, families, ["y_true", "y_score", "y_pred"])
    return binary_metrics(long, ["family", "label"], min_size)


def group_ranges(metrics: DataFrame, by: Sequence[str] = ("family",)) -> DataFrame:
    """Spread of AUC, FPR and FNR between the groups of a family, with review flags."""
    limits = {"roc_auc": 0.05, "fpr": 0.10, "fnr": 0.10}
    spread = {m: F.max(m) - F.min(m) for m in limits}
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        *[c.alias(f"{m}_range") for m, c in spread.items()],
    ).select("*", *[(F.col(f"{m}_range") > F.lit(v)).alias(f"{m}_flag") for m, v in limits.items()])


# ---------------------------------------------------------------- multi-class and regression

def class_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class from the k x k count table."""
    pairs = df.groupBy(column(y_true).cast("string").alias("t"), column(y_pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    return sums.select(
        "label",
        ratio(F.col("hits"), F.col("predicted"), 0.0).alias("precision"),
        ratio(F.col("hits"), F.col("support"), 0.0).alias("recall"),
        ratio(F.lit(2.0) * F.col("hits"), F.col("predicted") + F.col("support"), 0.0).alias("f1"),
        "support", "predicted", "hits",
    )


def averaged_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", positive: str = "1") -> DataFrame:
    """Accuracy, precision, recall and F1 under binary, micro, macro and weighted averaging."""
    report = class_report(df, y_true, y_pred)
    pos = F.col("label") == positive
    total, hits, predicted = F.sum("support"), F.sum("hits"), F.sum("predicted")
    names = ("precision", "recall", "f1")
    one = report.agg(
        ratio(hits, total).alias("accuracy"),
        *[F.coalesce(F.max(F.when(pos, F.col(m))), F.lit(0.0)).alias(f"binary_{m}") for m in names],
        ratio(hits, predicted, 0.0).alias("micro_precision"), ratio(hits, total, 0.0).alias("micro_recall"),
        ratio(F.lit(2.0) * hits, predicted + total, 0.0).alias("micro_f1"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[ratio(F.sum(F.col(m) * F.col("support")), total, 0.0).alias(f"weighted_{m}") for m in names],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("average"), F.col("accuracy"), *[F.col(f"{a}_{m}").alias(m) for m in names])
                for a in ("binary", "micro", "macro", "weighted")
            ]
        )
    )
    return one.select(rows.alias("r")).select("r.*")


def regression_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2, MAPE (rows with a zero target left out) and residual spread."""
    y, p = column(y_true).cast("double"), column(y_pred).cast("double")
    e = y - p
    sums = df.groupBy(*[column(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("_var"), F.avg(F.when(y != 0, F.abs(e / y))).alias("_mape"),
        F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"),
        F.min(e).alias("residual_min"), F.max(e).alias("residual_max"),
    )
    return sums.select(
        *[column(c) for c in by], "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
        (F.lit(1.0) - ratio(F.col("mse"), F.col("_var"))).alias("r2"),
        (F.col("_mape") * F.lit(100.0)).alias("mape"),
        "residual_mean", "residual_std", "residual_min", "residual_max",
    )


# ---------------------------------------------------------------- calibration

def _binned(scored: DataFrame, by: Sequence[str], n_bins: int, closed: str) -> DataFrame:
    """Bin sums per group; bin 0 holds scores that belong to no bin."""
    edges, score = [k / n_bins for k in range(n_bins)], F.col("score")
    if closed == "left":
        bin_no = F.expr(bucket_sql("score", edges))  # edges at or below the score
    else:
        bin_no = F.lit(n_bins) - F.expr(bucket_sql("-score", [-e for e in edges]))  # edges below the score
        if closed == "right":
            bin_no = F.greatest(bin_no, F.lit(1))
    cells = score_cells(scored.drop("y_pred"), by).withColumn("bin", bin_no.cast("int"))
    n = F.sum(F.col("pos") + F.col("neg"))
    return cells.groupBy(*[column(c) for c in by], "bin").agg(
        n.alias("n"), (F.sum("pos") / n).alias("prob_true"),
        (F.sum(score * (F.col("pos") + F.col("neg"))) / n).alias("prob_pred"),
    )


def calibration_bins(scored: DataFrame, by: Sequence[str] = (), n_bins: int = 10, closed: str = "right") -> DataFrame:
    """Observed rate and mean score per uniform bin.

    ``closed="right"``: (lo, hi], zero in the first bin; ``"left"``: [lo, hi), one in the
    last bin; ``"right-open-zero"``: as right, but a score of exactly zero belongs to no bin.
    """
    return _binned(scored, by, n_bins, closed).filter("bin >= 1")


def calibration_error(scored: DataFrame, by: Sequence[str] = (), n_bins: int = 10, closed: str = "left", min_size: int = 0) -> DataFrame:
    """Expected and maximum calibration error per group."""
    gap = F.when(F.col("bin") >= 1, F.abs(F.col("prob_true") - F.col("prob_pred")))
    out = _binned(scored, by, n_bins, closed).groupBy(*[column(c) for c in by]).agg(
        F.sum("n").alias("n_samples"), F.count(gap).alias("bins_used"),
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
    )
    return out.filter(F.col("n_samples") >= min_size) if min_size else out


def subgroup_calibration(scored: DataFrame, families: Mapping[str, str | Column], min_size: int = 30) -> DataFrame:
    long = by_families(scored, families, ["y_true", "y_score"])
    return calibration_error(long, ["family", "label"], closed="left", min_size=min_size)


# ---------------------------------------------------------------- errors

def _outcome() -> Column:
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return F.when(y & p, "TP").when(~y & p, "FP").when(y & ~p, "FN").otherwise("TN")


def error_counts(scored: DataFrame) -> DataFrame:
    """Rows and rate per outcome; the rate is taken within the true class."""
    counts = scored.groupBy(_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    actual = F.col("outcome").isin("TP", "FN")
    per_class = Window.partitionBy(actual)  # four rows
    return counts.select("outcome", "n", (F.col("n") / F.sum("n").over(per_class)).alias("rate"))


def error_scores(scored: DataFrame) -> DataFrame:
    """Score statistics of the missed positives and of the false alarms."""
    errors = scored.withColumn("outcome", _outcome()).filter(F.col("outcome").isin("FN", "FP"))
    stats = errors.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_score").alias("mean"), F.stddev_pop("y_score").alias("std"),
        F.min("y_score").alias("min"), F.max("y_score").alias("max"),
    )
    middle = quantiles(errors, ["y_score"], [0.5], ["outcome"]).select("outcome", F.col("q50").alias("median"))
    return stats.join(middle, "outcome")


def error_profiles(scored: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Value counts of each attribute among missed positives and false alarms."""
    errors = scored.withColumn("outcome", _outcome()).filter(F.col("outcome").isin("FN", "FP"))
    long = by_families(errors, {a: a for a in attributes}, ["outcome"])
    return long.groupBy("outcome", F.col("family").alias("column"), F.col("label").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
