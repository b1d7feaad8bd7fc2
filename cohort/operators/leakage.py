"""Does one sensitive column carry the label?"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from cohort.functions.columns import column
from cohort.operators import models as M
from cohort.operators.profile import crosstab, synthetic_check, target_rate
from cohort.operators.split import stratified_folds
from cohort.operators.stats import association_strength, chi_square
from cohort.roles import ColumnRoles


def sensitive_association(df: DataFrame, roles: ColumnRoles) -> dict[str, DataFrame]:
    """Crosstab, target rate and Cramer's V of the sensitive column."""
    chi = chi_square(df, [roles.sensitive], roles.target)
    return {
        "crosstab": crosstab(df, [roles.sensitive], roles.target),
        "target_rate": target_rate(df, [roles.sensitive], roles.target),
        "association": chi.withColumn("strength", association_strength(F.col("cramers_v"))),
    }


def _folded(df: DataFrame, roles: ColumnRoles, k: int) -> tuple[M.Design, DataFrame]:
    """The encoded table with its folds, kept for the many fits that follow."""
    design = M.fit_design(df, roles)
    folds = stratified_folds(design.assembled(df), "row_id", "y_true", k)
    return design, folds.persist(StorageLevel.MEMORY_AND_DISK)


def _cv_auc(design: M.Design, folds: DataFrame, trainer: M.Trainer, k: int, dropped: list[str | None], workers: int = 4) -> list[tuple[float, float]]:
    """Mean and SD over folds of the AUC without each column (None: with all); logistic models are fitted together."""
    keeps = [tuple(i for i, owner in enumerate(design.owners) if owner != d) for d in dropped]
    if isinstance(trainer, M.LogisticTrainer):
        fits = [M.Fit(str(j), keep, fold, C=trainer.C) for j, keep in enumerate(keeps) for fold in range(k)]
        scores = M.metrics_of(folds, fits).groupBy("model").agg(F.avg("roc_auc").alias("m"), F.stddev_pop("roc_auc").alias("s"))
        found = {r["model"]: (r["m"], r["s"]) for r in scores.collect()}  # one row per column
        return [found[str(j)] for j in range(len(dropped))]

    def one(keep):
        table = M.slice_features(folds, design.feature_names, keep)
        row = M.fold_metrics(M.out_of_fold(table, trainer, k)).agg(F.avg("roc_auc").alias("m"), F.stddev_pop("roc_auc").alias("s")).first()
        return row["m"], row["s"]

    return M.run_parallel([lambda keep=keep: one(keep) for keep in keeps], workers)


def with_and_without(df: DataFrame, roles: ColumnRoles, k: int = 5, trainer: M.Trainer | None = None) -> DataFrame:
    """Cross-validated AUC with and without the sensitive column on the same folds."""
    design, folds = _folded(df, roles, k)
    trainer = trainer or M.logistic_trainer()
    (full, full_sd), (safe, safe_sd) = _cv_auc(design, folds, trainer, k, [None, roles.sensitive])
    folds.unpersist()
    row = (full, full_sd, safe, safe_sd, full - safe, (full - safe) / full * 100.0)
    return df.sparkSession.createDataFrame(
        [row], "with_auc double, with_std double, without_auc double, without_std double, auc_drop double, auc_drop_pct double")


def top_coefficients(df: DataFrame, roles: ColumnRoles, top: int = 10) -> DataFrame:
    """Largest coefficients of the fit with and of the fit without the sensitive column."""
    parts = []
    for label, profile in (("with_sensitive", "full"), ("without_sensitive", "safe")):
        model = M.fit_logistic(df, roles.for_profile(profile), max_iter=1000)
        parts.append(M.coefficient_table(model).limit(top).withColumn("model", F.lit(label)))
    return reduce(DataFrame.unionByName, parts)


def drop_one_column(df: DataFrame, roles: ColumnRoles, k: int = 5, trainer: M.Trainer | None = None, workers: int = 4) -> DataFrame:
    """AUC lost when each column is left out, most damaging first."""
    design, folds = _folded(df, roles, k)
    trainer = trainer or M.logistic_trainer()
    columns = design.roles.features("full")
    base, *rest = [mean for mean, _ in _cv_auc(design, folds, trainer, k, [None, *columns], workers)]
    folds.unpersist()
    rows = [("baseline", None, base, 0.0, 0.0)] + [("drop", c, a, base - a, (base - a) / base * 100.0) for c, a in zip(columns, rest)]
    return df.sparkSession.createDataFrame(
        rows, "test string, dropped string, roc_auc double, auc_delta double, auc_delta_pct double").orderBy(F.desc("auc_delta"), "dropped")


def verdict(auc_drop_pct: str | Column = "auc_drop_pct") -> Column:
    value = column(auc_drop_pct)
    return F.when(value > 3, "high").when(value > 1, "medium").otherwise("low")


def investigate(df: DataFrame, roles: ColumnRoles, k: int = 5, **names) -> DataFrame:
    """One row: association, AUC drop, synthetic-data flags and the risk verdict."""
    association = sensitive_association(df, roles)["association"].select(F.lit(1).alias("_k"), "chi2", "cramers_v", "strength")
    drop = with_and_without(df, roles, k).withColumn("_k", F.lit(1))
    synthetic = synthetic_check(df, roles.target, roles.sensitive, **names).select(F.lit(1).alias("_k"), "total_warnings", "likely_synthetic")
    joined = association.join(drop, "_k").join(synthetic, "_k").drop("_k")  # one row each
    return joined.withColumn("risk", verdict())
