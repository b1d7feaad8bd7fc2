"""Threshold sweeps, picks and decision curves.

Scores are counted per grid slot first; a sweep then accumulates a table of
``groups x thresholds`` rows, so no row is repeated per threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.columns import by_families, column, count_if, ratio
from cohort.operators.rank import bucket_sql


def hundredths(low: int, high: int, step: int = 1) -> list[float]:
    """Exact thresholds ``low/100 .. high/100``."""
    return [i / 100.0 for i in range(low, high + 1, step)]


# grids used by the four threshold reports, in hundredths
SWEEP_GRID = hundredths(10, 89)
SERVICE_GRID = hundredths(10, 90, 5)
SUBGROUP_GRID = hundredths(5, 95)
DECISION_GRID = [0.01 + i * 0.98 / 99 for i in range(100)]


def _flagged(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``(by, slot, tp, fp, P, N)``: rows at or above each threshold."""
    keys = [column(c) for c in by]
    slot = F.expr(bucket_sql("score", thresholds))  # how many thresholds lie at or below the score
    y = F.col("y_true") == 1
    counts = (
        scored.select(*keys, "y_true", column("y_score").cast("double").alias("score")).groupBy(*keys, slot.alias("slot"))
        .agg(count_if(y).alias("pos"), count_if(~y).alias("neg"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(set(thresholds))))).alias("slot"))
    filled = grid.join(counts, [*by, "slot"], "left").fillna(0, ["pos", "neg"])
    down = Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    return filled.select(
        *keys, F.element_at(values, F.col("slot")).alias("threshold"),
        F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), "P", "N",
    )


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float] = SWEEP_GRID, by: Sequence[str] = (), fn_cost: float = 2.0
) -> DataFrame:
    """Recall, specificity, precision, F1, error rates, Youden J, cost and flagged share."""
    flagged = _flagged(scored, thresholds, by)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    n = F.col("P") + F.col("N")
    recall, spec = ratio(tp, F.col("P"), 0.0), ratio(tn, F.col("N"), 0.0)
    cost = F.lit(float(fn_cost)) * fn + fp
    return flagged.select(
        *[column(c) for c in by], "threshold", "tp", "fp", fn.alias("fn"), tn.alias("tn"),
        recall.alias("recall"), spec.alias("specificity"), ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn, 0.0).alias("f1"),
        ratio(fp, F.col("N"), 0.0).alias("fpr"), ratio(fn, F.col("P"), 0.0).alias("fnr"),
        (recall + spec - F.lit(1.0)).alias("youden_j"), cost.alias("total_cost"),
        (cost / n).alias("cost_per_sample"), (tp + fp).alias("n_flagged"),
        ((tp + fp) / n * F.lit(100.0)).alias("flagged_pct"),
    )


def threshold_picks(sweep: DataFrame, by: Sequence[str] = (), max_fnr: float = 0.15) -> DataFrame:
    """The recommended threshold under each policy; the lowest threshold wins a tie.

    A policy with no eligible row (recall-first when every FNR is too high) is absent.
    """
    f1 = F.round("f1", 4)
    policies = {
        "best_f1": (F.lit(True), -f1),
        "best_youden": (F.lit(True), -F.round("youden_j", 4)),
        "min_cost": (F.lit(True), F.round("cost_per_sample", 4)),
        "screening": (F.lit(True), -F.round("recall", 4)),
        "recall_first": (F.col("fnr") < F.lit(float(max_fnr)), -f1),
    }
    kept = ["threshold", "recall", "precision", "f1", "fnr", "youden_j", "cost_per_sample"]
    picks = [
        F.min(F.when(ok, F.struct(key.alias("key"), *[F.col(c) for c in kept]))).alias(name)
        for name, (ok, key) in policies.items()
    ]
    best = sweep.groupBy(*[column(c) for c in by]).agg(*picks)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("pick")) for p in policies]))
    return (
        best.select(*[column(c) for c in by], rows.alias("r")).filter("r.pick IS NOT NULL")
        .select(*[column(c) for c in by], "r.policy", *[f"r.pick.{c}" for c in kept])
    )


def threshold_report(scored: DataFrame, thresholds: Sequence[float] = SWEEP_GRID, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    sweep = threshold_sweep(scored, thresholds, by)
    return {"sweep": sweep, "picks": threshold_picks(sweep, by)}


def subgroup_thresholds(
    scored: DataFrame, families: Mapping[str, str | Column], min_size: int = 30, thresholds: Sequence[float] = SUBGROUP_GRID
) -> DataFrame:
    """F1-optimal and cost-optimal threshold overall and per subgroup (0.5 if F1 is always 0)."""
    long = by_families(scored, {"Overall": F.lit("Overall"), **families}, ["y_true", "y_score"])
    by = ["family", "label"]
    sweep = threshold_sweep(long, thresholds, by)
    # a constant class with constant predictions has no two-by-two table, hence no cost
    mixed = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    spread = (F.col("n_flagged") > 0) & (F.col("n_flagged") < F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    best = sweep.groupBy(*by).agg(
        F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_samples"),
        F.min(F.struct((-F.col("f1")).alias("k"), F.col("threshold"))).alias("_f"),
        F.min(F.when(mixed | spread, F.struct(F.col("total_cost").alias("k"), F.col("threshold")))).alias("_c"),
    )
    some = F.col("_f.k") < 0
    return best.filter(F.col("n_samples") >= min_size).select(
        *by, "n_samples",
        F.when(some, F.col("_f.threshold")).otherwise(F.lit(0.5)).alias("f1_optimal_threshold"),
        (-F.col("_f.k")).alias("f1_optimal_value"),
        F.coalesce(F.col("_c.threshold"), F.lit(0.5)).alias("cost_optimal_threshold"),
        (F.col("_c.k") / F.col("n_samples")).alias("cost_optimal_value"),
    )


def decision_curve(scored: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = DECISION_GRID) -> DataFrame:
    """Net benefit of the model, of flagging everyone and of flagging no one."""
    flagged = _flagged(scored, thresholds, by)
    n = (F.col("P") + F.col("N")).cast("double")
    odds = F.col("threshold") / (F.lit(1.0) - F.col("threshold"))
    share = F.col("P") / n
    return flagged.select(
        *[column(c) for c in by], "threshold",
        (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit"),
        (share - (F.lit(1.0) - share) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"),
    )


def optimal_threshold(scored: DataFrame, by: Sequence[str] = ("model",), thresholds: Sequence[float] = SWEEP_GRID) -> DataFrame:
    """F1-optimal threshold per model."""
    sweep = threshold_sweep(scored, thresholds, by)
    best = F.min(F.struct((-F.col("f1")).alias("k"), F.col("threshold"))).alias("_b")
    return sweep.groupBy(*by).agg(best).select(
        *by, F.col("_b.threshold").alias("threshold"), (-F.col("_b.k")).alias("f1")
    )
