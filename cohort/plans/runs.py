"""Whole runs: split, fit, evaluate, compare profiles, choose and refit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from cohort.functions.columns import column
from cohort.operators import compare, models as M
from cohort.operators.evaluate import binary_metrics, calibration_bins, subgroup_metrics, with_predictions
from cohort.operators.split import stratified_folds, target_split
from cohort.operators.thresholds import SERVICE_GRID, threshold_picks, threshold_sweep
from cohort.plans.deploy import Deployment, fit_deployment, save_deployment
from cohort.roles import ColumnRoles

MIN_SUBGROUP = 20


def _oof(name: str, train: DataFrame, roles: ColumnRoles, params: dict, folds: DataFrame, k: int) -> DataFrame:
    def one(i: int):
        part = lambda cond: folds.filter(cond).drop("fold")
        return lambda: M.fit_model(name, part(F.col("fold") != i), roles, **params).scored(part(F.col("fold") == i))

    return reduce(DataFrame.unionByName, M.run_parallel([one(i) for i in range(k)]))


def holdout_run(
    df: DataFrame, roles: ColumnRoles, profile: str = "safe", models: Sequence[str] = ("logistic", "gam", "boosted"),
    params: Mapping[str, dict] | None = None, test_size: float = 0.2, k: int = 5, oof: bool = True, split: DataFrame | None = None,
    attributes: Mapping[str, str | Column] | None = None, preset: str = "quick",
    budget: str = "default", top: int | None = None,
) -> dict[str, DataFrame]:
    """Fit every model on the train part and judge it on rows it never saw.

    Returns long tables keyed by model: ``metrics`` (splits oof and holdout), ``thresholds``,
    ``calibration``, ``subgroups``, ``importance`` and the scored ``predictions``. Preprocessing,
    folds and early stopping use the train part only. ``budget="auto"`` scales iterations and splines
    to the training rows; ``top`` cuts the importance tables.
    """
    roles = roles.for_profile(profile).present(df)
    marked = target_split(df, roles.row_id, roles.target, test_size) if split is None else df.join(split, roles.row_id)
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
    train, test = marked.filter("split = 'train'").drop("split"), marked.filter("split = 'test'").drop("split")
    if budget not in ("default", "auto"):
        raise ValueError(f"unknown budget {budget!r}")
    chosen = {**M.training_params(train.count() if budget == "auto" else None, preset), **(params or {})}
    folds = stratified_folds(train, roles.row_id, roles.target, k).persist(StorageLevel.MEMORY_AND_DISK)

    scored, importance = [], []
    prior = M.baseline_scores(train, test, roles.row_id, roles.target)
    scored.append(prior.select(F.lit("baseline").alias("model"), F.lit("holdout").alias("split"), "*"))
    for name in models:
        settings = chosen.get(name, {})
        fitted = M.fit_model(name, train, roles, **settings)
        scored.append(fitted.scored(test).select(F.lit(name).alias("model"), F.lit("holdout").alias("split"), "*"))
        if oof:
            scored.append(_oof(name, train, roles, settings, folds, k).select(F.lit(name).alias("model"), F.lit("oof").alias("split"), "*"))
        if name == "gam":
            table = fitted.model.importance(train).select("feature", F.col("variance_importance").alias("importance"))
        elif name in ("logistic", "boosted"):
            table = M.feature_importance(fitted)
        else:
            continue
        importance.append((table if top is None else table.limit(top)).withColumn("model", F.lit(name)))
    predictions = reduce(DataFrame.unionByName, scored).persist(StorageLevel.MEMORY_AND_DISK)
    holdout = predictions.filter("split = 'holdout'")
    picks = threshold_picks(threshold_sweep(holdout, SERVICE_GRID, ["model"]), ["model"])
    out = {
        "metrics": binary_metrics(predictions, ["model", "split"]).withColumn("profile", F.lit(profile)),
        "thresholds": picks.withColumn("profile", F.lit(profile)),
        "calibration": calibration_bins(holdout, ["model"]),
        "predictions": predictions,
        "split": marked.select(column(roles.row_id), "split"),
    }
    if importance:
        out["importance"] = reduce(DataFrame.unionByName, importance)
    if attributes:
        groups = test.select(column(roles.row_id).alias("row_id"), *[
            (column(c) if isinstance(c, str) else c).cast("string").alias(f) for f, c in attributes.items()])
        best = picks.filter("policy = 'best_f1'").select("model", F.col("threshold").alias("_t"))
        rows = holdout.join(F.broadcast(best), "model").join(groups, "row_id")  # one threshold per model
        rows = rows.withColumn("y_pred", (F.col("y_score") >= F.col("_t")).cast("int")).drop("_t")
        tables = [subgroup_metrics(rows.filter(F.col("model") == m), {f: f for f in attributes}, MIN_SUBGROUP).withColumn("model", F.lit(m)) for m in models]
        out["subgroups"] = reduce(DataFrame.unionByName, tables)
    return out


def compare_profiles(df: DataFrame, roles: ColumnRoles, **options) -> dict[str, DataFrame]:
    """Both profiles on the same split; ``delta`` is full minus safe per model."""
    safe = holdout_run(df, roles, "safe", **options)
    full = holdout_run(df, roles, "full", **{**options, "split": safe["split"]})
    metrics = safe["metrics"].unionByName(full["metrics"])
    return {
        "metrics": metrics,
        "thresholds": safe["thresholds"].unionByName(full["thresholds"]),
        "delta": compare.profile_delta(metrics.filter("split = 'holdout'")),
        "split": safe["split"],
    }


def train_best(df: DataFrame, roles: ColumnRoles, path: str | None = None, policy: str = "screening", params: Mapping[str, dict] | None = None, **options) -> tuple[Deployment, DataFrame]:
    """Compare, choose, refit on all rows, and save."""
    report = compare_profiles(df, roles, params=params, **options)
    choice = compare.best_deployable(report["metrics"].filter("split = 'holdout'"), report["thresholds"], policy)
    best = choice.first()  # one row
    if best is None:
        raise ValueError("no model can be deployed: no candidate has a ROC-AUC on the holdout rows")
    settings = (params or {}).get(best["model"], {})
    deployment = fit_deployment(df, roles, best["model"], best["profile"], best["threshold"], policy, **settings)
    if path:
        save_deployment(df.sparkSession, deployment, path)
    return deployment, choice
