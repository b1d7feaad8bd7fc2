"""Composite analyses; each returns small tables built on one kept scored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame

from cohort.functions.columns import column
from cohort.operators import evaluate as E, fairness as Fa, thresholds as Th
from cohort.operators.compare import compare_all


def fairness_analysis(scored: DataFrame, families: Mapping[str, str | Column], min_size: int = 30) -> dict[str, DataFrame]:
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    rates = Fa.group_rates(scored, families, min_size).persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "groups": E.subgroup_metrics(scored, families, min_size), "demographic_parity": Fa.demographic_parity(rates),
        "equalized_odds": Fa.equalized_odds(rates), "predictive_parity": Fa.predictive_parity(rates),
        "disparate_impact": Fa.disparate_impact(rates), "theil": Fa.theil_index(scored, families, min_size),
        "overall": E.confusion(scored), "warnings": Fa.fairness_warnings(rates),
    }


def subgroup_analysis(
    scored: DataFrame, families: Mapping[str, str | Column], threshold_families: Mapping[str, str | Column] | None = None,
    profile_columns: Sequence[str] = (), min_size: int = 30,
) -> dict[str, DataFrame]:
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    metrics = E.subgroup_metrics(scored, families, min_size)
    out = {
        "metrics": metrics, "ranges": E.group_ranges(metrics), "errors": E.error_counts(scored), "error_scores": E.error_scores(scored),
        "calibration": E.subgroup_calibration(scored, families, min_size),
        "thresholds": Th.subgroup_thresholds(scored, families if threshold_families is None else threshold_families, min_size),
    }
    if profile_columns:
        out["error_profiles"] = E.error_profiles(scored, profile_columns)
    return out


def model_comparison(predictions: DataFrame, n_boot: int = 2000) -> dict[str, DataFrame]:
    return compare_all(predictions.persist(StorageLevel.MEMORY_AND_DISK), n_boot)
