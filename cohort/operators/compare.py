"""Comparison of models: pairing, paired tests, bootstrap, ranking and the final choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions import distributions as D
from cohort.functions.columns import column, count_if, ratio
from cohort.operators.evaluate import binary_metrics
from cohort.operators.rank import bucket_sql, range_bounds, running_totals
from cohort.operators.thresholds import optimal_threshold


def model_names(predictions: DataFrame) -> list[str]:
    """Sorted names of the compared models (a handful)."""
    return sorted(r["model"] for r in predictions.select("model").distinct().collect())


def align_models(predictions: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One row per ``row_id`` with ``y_true`` and each model's score and prediction.

    One shuffle on the key. Models must score the same rows with the same truth.
    """
    models = model_names(predictions) if models is None else list(models)
    rows = predictions.filter(F.col("model").isin(models))
    pick = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = rows.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("_k"), F.min("y_true").alias("y_true"), F.max("y_true").alias("_other"),
        *[pick("y_score", m).alias(f"score_{i}") for i, m in enumerate(models)],
        *[pick("y_pred", m).alias(f"pred_{i}") for i, m in enumerate(models)],
    )
    clash = (F.col("_k") != len(models)) | (F.col("y_true") != F.col("_other"))
    checked = F.when(clash, F.raise_error(F.lit("models were not scored on the same rows"))).otherwise(F.col("y_true"))
    return wide.select("row_id", checked.cast("int").alias("y_true"),
                       *[f"score_{i}" for i in range(len(models))], *[f"pred_{i}" for i in range(len(models))])


def mcnemar(predictions: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Continuity-corrected McNemar test for every pair of models, all pairs in one aggregate."""
    models = model_names(predictions) if models is None else list(models)
    wide = align_models(predictions, models)
    right = [F.col(f"pred_{i}") == F.col("y_true") for i in range(len(models))]
    pairs = list(combinations(range(len(models)), 2))
    aggs = []
    for i, j in pairs:
        aggs += [
            count_if(right[i] & right[j]).alias(f"bc_{i}_{j}"), count_if(~right[i] & ~right[j]).alias(f"bw_{i}_{j}"),
            count_if(right[i] & ~right[j]).alias(f"b_{i}_{j}"), count_if(~right[i] & right[j]).alias(f"c_{i}_{j}"),
        ]
    one = wide.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(models[i]).alias("model1"), F.lit(models[j]).alias("model2"), F.col(f"bc_{i}_{j}").alias("both_correct"),
                 F.col(f"bw_{i}_{j}").alias("both_wrong"), F.col(f"b_{i}_{j}").alias("only_first"), F.col(f"c_{i}_{j}").alias("only_second"))
        for i, j in pairs
    ]))
    b, c = F.col("only_first"), F.col("only_second")
    chi2 = ratio(F.pow((F.abs(b - c) - 1).cast("double"), F.lit(2.0)), b + c, 0.0)
    out = one.select(rows.alias("r")).select("r.*").withColumn("chi2", chi2)
    p = F.when(b + c == 0, F.lit(1.0)).otherwise(D.chi2_p(F.col("chi2"), F.lit(1.0)))
    return out.withColumn("p", p).withColumn("significant", F.col("p") < 0.05)


# ---------------------------------------------------------------- bootstrap

#: Cells whose weights are drawn at once, times replicates.
DRAWS = 1 << 22
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _hashed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson(keys: np.ndarray, n: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson(n) weights, a row per key and a column per replicate; functions of key and replicate alone."""
    with np.errstate(over="ignore"):
        bits = _hashed(keys[:, None] + _GOLD * np.arange(1, n_boot + 1, dtype=np.uint64)[None, :])
    uniform = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
    out = np.empty(uniform.shape, np.int64)
    for size in np.unique(n):
        rows = n == size
        reach = int(size + 12 * np.sqrt(size) + 30)
        steps = np.arange(1, reach + 1)
        below = max(0, int(size - 12 * np.sqrt(size) - 30))
        logs = np.r_[0.0, np.cumsum(np.log(size) - np.log(steps))] - size
        out[rows] = below + np.searchsorted(np.cumsum(np.exp(logs[below:])), uniform[rows], side="right")
    return out


#: What a score range hands on, a row of replicates each: sums, and both classes at its first and at its last score.
_SUMS = ("P", "N", "tp", "fp", "wins", "first_pos", "first_neg", "last_pos", "last_neg")


def _merged(parts: list[tuple[float, float, np.ndarray]]) -> np.ndarray:
    """Sums of neighbouring score ranges ``(first score, last score, sums)`` in ascending order."""
    _, high, total = parts[0][0], parts[0][1], parts[0][2].copy()
    for low, top, part in parts[1:]:
        total[4] += part[4] + part[0] * total[1]  # positives here beat all negatives below
        if low == high:  # a score that the cut goes through: ties count half, both ways
            total[4] += total[7] * part[6] / 2 - part[5] * total[8] / 2
        total[:4] += part[:4]
        total[7:] = part[7:] + (total[7:] if low == top == high else 0)
        high = top
    return total


def _walked(score: np.ndarray, y: np.ndarray, pred: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Sums of cells in ascending order of their scores."""
    pos, neg = weights * (y == 1)[:, None], weights * (y == 0)[:, None]
    first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    pos_at, neg_at = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
    below = np.cumsum(neg_at, axis=0) - neg_at
    chosen = (pred == 1)[:, None]
    return float(score[0]), float(score[-1]), np.array([
        pos_at.sum(axis=0), neg_at.sum(axis=0), (pos * chosen).sum(axis=0), (neg * chosen).sum(axis=0), (pos_at * (below + neg_at / 2)).sum(axis=0), pos_at[0], neg_at[0], pos_at[-1], neg_at[-1]])


def _replicates(cells: DataFrame, n_models: int, n_boot: int, seed: int) -> DataFrame:
    """``(model, rep, P, N, tp, fp, wins)`` of every bootstrap replicate.

    A cell of ``n`` equal rows draws a Poisson(n) weight per replicate from a hash of the cell's content,
    so the draw does not depend on partitioning or retries, and is the same for all models. Cells are sorted by
    score across the cluster; a task walks its range and hands on one row of sums per model, whatever the
    number of cells. Ranges are joined in order: the sums of two neighbours give those of both.
    """
    key = F.xxhash64(F.lit(seed), "y_true", "scores", "preds")
    found = None

    def walk(batches):
        held, model, place = None, 0, 0
        for frame in batches:
            if not len(frame):
                continue
            model, place = int(frame["model"].iloc[0]), int(frame["part"].iloc[0])
            n, keys = frame["n"].to_numpy(np.int64), frame["key"].to_numpy(np.int64).view(np.uint64)
            y, pred, score = frame["y_true"].to_numpy(), frame["pred"].to_numpy(), frame["score"].to_numpy(float)
            step = max(1, DRAWS // n_boot)
            for a in range(0, len(frame), step):
                cut = slice(a, a + step)
                more = _walked(score[cut], y[cut], pred[cut], _poisson(keys[cut], n[cut], n_boot).astype(np.float64))
                held = more if held is None else (held[0], more[1], _merged([held, more]))
        if held is not None:
            yield pd.DataFrame({"model": np.int32([model]), "part": np.int32([place]), "low": [held[0]], "high": [held[1]], "sums": [held[2].tobytes()]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = _merged([(low, high, np.frombuffer(x).reshape(len(_SUMS), n_boot)) for low, high, x in zip(frame["low"], frame["high"], frame["sums"])])
        return pd.DataFrame({"model": frame["model"].iloc[0], "rep": np.arange(n_boot, dtype=np.int32), **dict(zip(_SUMS[:5], total))})

    for m in range(n_models):
        own = cells.select(F.lit(m).alias("model"), F.col("scores")[m].alias("score"), F.col("preds")[m].alias("pred"), "y_true", "n", key.alias("key"))
        ranged = own.repartitionByRange("score", "key").sortWithinPartitions("score", "key").withColumn("part", F.spark_partition_id())
        sums = ranged.mapInPandas(walk, "model int, part int, low double, high double, sums binary")
        found = sums if found is None else found.unionByName(sums)
    return found.groupBy("model").applyInPandas(join, "model int, rep int, P double, N double, tp double, fp double, wins double")  # a row per range


def _replicate_metrics(sums: DataFrame) -> DataFrame:
    """AUC, F1, precision and recall per (model, rep); replicates with one class drop out."""
    s = sums.filter((F.col("P") > 0) & (F.col("N") > 0))
    return s.select(
        "model", "rep", (F.col("wins") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        ratio(F.lit(2.0) * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P"), 0.0).alias("f1"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"), ratio(F.col("tp"), F.col("P"), 0.0).alias("recall"),
    )


# ---------------------------------------------------------------- variance in closed form

def _placements(scored: DataFrame, score: str) -> DataFrame:
    """``(score, above, below)`` per distinct score: what share of positives it does not beat, and of negatives it beats (ties half)."""
    value = column(score).cast("double")
    cells = scored.filter(value.isNotNull()).groupBy(value.alias("score")).agg(count_if(F.col("y_true") == 1).alias("pos"), count_if(F.col("y_true") == 0).alias("neg"))
    bounds = range_bounds(scored, [score])[score]
    walked = running_totals(cells, "score", ["pos", "neg"], bucket=F.expr(bucket_sql("score", bounds)))
    return walked.select(
        "score", ratio(F.col("tot_pos") - F.col("cum_pos") + F.col("pos") / 2.0, F.col("tot_pos")).alias("above"),
        ratio(F.col("cum_neg") - F.col("neg") / 2.0, F.col("tot_neg")).alias("below"), "pos", "neg")


def auc_variance(scored: DataFrame) -> DataFrame:
    """AUC with the placement-value variance, standard error and normal 95 % interval; one row.

    The variance is that of the positives' placements among negatives over their number, plus the
    same for negatives; null with fewer than two rows of a class. From counts per distinct score.
    """
    cells = _placements(scored, "y_score")
    one = cells.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * F.col("below")).alias("up"),
        F.sum(F.col("pos") * (F.col("below") - 0.5) ** 2).alias("up2"), F.sum(F.col("neg") * (F.col("above") - 0.5) ** 2).alias("down2"))
    auc = ratio(F.col("up"), F.col("n_pos"))
    one = one.withColumn("auc", auc)

    def spread(squares: str, n: str) -> Column:  # sums are taken about a half, so little is lost
        return F.when(F.col(n) > 1, (F.col(squares) - F.col(n) * (F.col("auc") - 0.5) ** 2) / (F.col(n) - 1) / F.col(n))

    both = spread("up2", "n_pos") + spread("down2", "n_neg")
    one = one.withColumn("variance", F.when(both < 0, 0.0).otherwise(both))
    half = F.lit(1.959963984540054) * F.sqrt("variance")
    return one.select("n_pos", "n_neg", "auc", "variance", F.sqrt("variance").alias("se"), *[
        F.when(half.isNotNull(), side).alias(name) for side, name in ((F.greatest(F.col("auc") - half, F.lit(0.0)), "ci_lower"), (F.least(F.col("auc") + half, F.lit(1.0)), "ci_upper"))])


def auc_difference_test(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """Two models on the same rows: AUC difference, its placement-value variance, z and two-sided p; one row.

    Rows with equal truth and equal scores are one cell; each cell looks up the placements of its two scores.
    """
    wide = align_models(predictions, [first, second])
    cells = wide.groupBy("y_true", F.col("score_0").cast("double").alias("score_0"), F.col("score_1").cast("double").alias("score_1")).agg(F.count(F.lit(1)).alias("n"))
    for k in range(2):
        found = _placements(wide, f"score_{k}").select(F.col("score").alias(f"_s{k}"), F.col("above").alias(f"above_{k}"), F.col("below").alias(f"below_{k}"))
        cells = cells.join(found, F.col(f"score_{k}") == F.col(f"_s{k}"))
    place = [F.when(F.col("y_true") == 1, F.col(f"below_{k}")).otherwise(F.col(f"above_{k}")) for k in range(2)]
    gap = place[0] - place[1]
    by_class = cells.groupBy("y_true").agg(
        F.sum("n").alias("n"), *[(F.sum(F.col("n") * place[k]) / F.sum("n")).alias(f"auc_{k}") for k in range(2)],
        F.sum(F.col("n") * gap).alias("gap"), F.sum(F.col("n") * gap * gap).alias("gap2"))
    spread = F.when(F.col("n") > 1, (F.col("gap2") - F.col("gap") ** 2 / F.col("n")) / (F.col("n") - 1) / F.col("n"))
    one = by_class.agg(
        *[F.max(F.when(F.col("y_true") == 1, F.col(f"auc_{k}"))).alias(f"auc{k + 1}") for k in range(2)],
        F.when(F.count(spread) == 2, F.greatest(F.sum(spread), F.lit(0.0))).alias("variance"))
    difference = F.col("auc1") - F.col("auc2")
    z = ratio(difference, F.sqrt("variance"))
    out = one.select(F.lit(first).alias("model1"), F.lit(second).alias("model2"), "auc1", "auc2", difference.alias("auc_diff"), "variance", z.alias("z"))
    return out.withColumn("p", F.when(F.col("z").isNotNull(), D.normal_two_sided_p(F.col("z"))))


def bootstrap_ci(scored: DataFrame, n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean, SD and percentile interval of AUC, F1, precision and recall."""
    cells = scored.groupBy("y_true", F.array(column("y_score").cast("double")).alias("scores"), F.array(column("y_pred").cast("int")).alias("preds")).agg(
        F.count(F.lit(1)).alias("n"))
    metrics = _replicate_metrics(_replicates(cells, 1, n_boot, seed))
    low, high = (1 - level) / 2, (1 + level) / 2
    names = ("roc_auc", "f1", "precision", "recall")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]))
    long = metrics.select(rows.alias("r")).select("r.*")
    return long.groupBy("metric").agg(  # at most n_boot values per metric
        F.count(F.lit(1)).alias("replicates"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(high)).alias("upper"),
    ).withColumn("ci_width", F.col("upper") - F.col("lower"))


def auc_bootstrap_test(predictions: DataFrame, first: str, second: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the AUC difference: mean, percentile CI95 and two-sided p."""
    wide = align_models(predictions, [first, second])
    cells = wide.groupBy(
        "y_true", F.array(F.col("score_0").cast("double"), F.col("score_1").cast("double")).alias("scores"),
        F.array(F.col("pred_0").cast("int"), F.col("pred_1").cast("int")).alias("preds"),
    ).agg(F.count(F.lit(1)).alias("n"))
    reps = _replicate_metrics(_replicates(cells, 2, n_boot, seed)).groupBy("rep").agg(
        (F.max(F.when(F.col("model") == 0, F.col("roc_auc"))) - F.max(F.when(F.col("model") == 1, F.col("roc_auc")))).alias("d"))
    s = reps.agg(
        F.count("d").alias("replicates"), F.avg("d").alias("auc_diff"), F.percentile("d", F.lit(0.025)).alias("ci_lower"),
        F.percentile("d", F.lit(0.975)).alias("ci_upper"),
        (F.lit(2.0) * F.least(F.avg((F.col("d") > 0).cast("double")), F.avg((F.col("d") < 0).cast("double")))).alias("p"),
    )
    point = binary_metrics(predictions.filter(F.col("model").isin([first, second])), ["model"]).agg(
        F.max(F.when(F.col("model") == first, F.col("roc_auc"))).alias("auc1"), F.max(F.when(F.col("model") == second, F.col("roc_auc"))).alias("auc2"))
    both = s.withColumn("_k", F.lit(1)).join(point.withColumn("_k", F.lit(1)), "_k")  # one row each
    significant = (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)
    return both.select(F.lit(first).alias("model1"), F.lit(second).alias("model2"), "auc1", "auc2", "auc_diff", "ci_lower", "ci_upper", "p",
                       significant.alias("significant"), "replicates")


# ---------------------------------------------------------------- ranking and choice

def rank_models(metrics: DataFrame, metric: str = "roc_auc", higher_is_better: bool = True) -> DataFrame:
    order = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(order, "model")))  # one row per model


def compare_models(predictions: DataFrame) -> DataFrame:
    """Metric table of all models with rank by AUC and the F1-optimal threshold."""
    metrics = rank_models(binary_metrics(predictions, ["model"]))
    best = optimal_threshold(predictions).select("model", F.col("threshold").alias("f1_threshold"), F.col("f1").alias("best_f1"))
    return metrics.join(best, "model").select(
        "rank", "model", "roc_auc", "pr_auc", "f1", "brier_score", "recall", "precision", "accuracy", "specificity", "fpr", "fnr", "npv",
        "prevalence", "n_samples", "n_positive", "f1_threshold", "best_f1")


def compare_all(predictions: DataFrame, n_boot: int = 2000) -> dict[str, DataFrame]:
    """Metrics, paired tests, calibration and decision curves of a predictions table."""
    from cohort.operators.evaluate import calibration_bins, calibration_error
    from cohort.operators.thresholds import decision_curve

    models = model_names(predictions)
    tests = [auc_bootstrap_test(predictions, a, b, n_boot) for a, b in combinations(models, 2)]
    out = {
        "metrics": compare_models(predictions),
        "calibration": calibration_bins(predictions, ["model"]),
        "calibration_error": calibration_error(predictions, ["model"], closed="right-open-zero"),
        "decision_curve": decision_curve(predictions, ["model"]),
    }
    if tests:
        out["mcnemar"] = mcnemar(predictions, models)
        bootstrap = tests[0]
        for t in tests[1:]:
            bootstrap = bootstrap.unionByName(t)
        out["auc_bootstrap"] = bootstrap
    return out


def profile_delta(metrics: DataFrame) -> DataFrame:
    """AUC and F1 of the full profile minus the safe one, per model present in both."""
    pick = lambda c, p: F.max(F.when(F.col("profile") == p, F.col(c)))
    wide = metrics.groupBy("model").agg(*[pick(c, p).alias(f"{p}_{c}") for p in ("safe", "full") for c in ("roc_auc", "f1")])
    return wide.filter(F.col("safe_roc_auc").isNotNull() & F.col("full_roc_auc").isNotNull()).select(
        "*", (F.col("full_roc_auc") - F.col("safe_roc_auc")).alias("roc_auc_delta"), (F.col("full_f1") - F.col("safe_f1")).alias("f1_delta"))


# Order of preference on equal metrics, and threshold policy names.
MODEL_PREFERENCE = {"logistic": 1, "gam": 2, "boosted": 3, "catboost": 3}
PROFILE_PREFERENCE = {"full": 1, "safe": 2}
POLICIES = {"screening": "screening", "best_f1": "best_f1", "f1": "best_f1", "youden": "best_youden", "youden_j": "best_youden"}
FALLBACK_POLICIES = ["best_f1", "best_youden"]
DEFAULT_THRESHOLD = 0.5


def best_deployable(
    metrics: DataFrame, thresholds: DataFrame | None = None, policy: str = "screening", profiles: Sequence[str] = ("safe", "full"),
    preference: Mapping[str, int] = MODEL_PREFERENCE,
) -> DataFrame:
    """The chosen (profile, model) with its threshold.

    Order: AUC, PR-AUC, F1, model preference, profile preference. ``thresholds`` holds
    ``(profile, model, policy, threshold)``; a missing policy falls back to best F1, then
    best Youden, then 0.5. ``profile_warning`` marks a choice that uses the sensitive column.
    """
    lookup = lambda m, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c)), F.lit(0))
    candidates = metrics.filter(
        F.col("roc_auc").isNotNull() & F.col("profile").isin(list(profiles)) & F.col("model").isin(list(preference)))
    best = candidates.orderBy(
        F.desc("roc_auc"), F.desc(F.coalesce("pr_auc", F.lit(0.0))), F.desc(F.coalesce("f1", F.lit(0.0))),
        F.desc(lookup(preference, "model")), F.desc(lookup(PROFILE_PREFERENCE, "profile")),
    ).limit(1)
    preferred = POLICIES.get(policy, "screening")
    order = list(dict.fromkeys([preferred, *FALLBACK_POLICIES]))
    if thresholds is None:
        found = best.withColumns({f"_t_{p}": F.lit(None).cast("double") for p in order})
    else:
        wide = thresholds.groupBy("profile", "model").agg(
            *[F.max(F.when(F.col("policy") == p, F.col("threshold"))).alias(f"_t_{p}") for p in order])
        found = best.join(wide, ["profile", "model"], "left")
    source = F.coalesce(*[F.when(F.col(f"_t_{p}").isNotNull(), F.lit(p)) for p in order], F.lit("default_0.5"))
    return found.select(
        "profile", "model", "roc_auc", "pr_auc", "f1",
        F.coalesce(*[F.col(f"_t_{p}") for p in order], F.lit(DEFAULT_THRESHOLD)).alias("threshold"), source.alias("threshold_source"),
        (source != preferred).alias("threshold_warning"), (F.col("profile") == "full").alias("profile_warning"))


def best_for_report(metrics: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Best model of the safe profile (name breaks ties); the fallback table only if there is none."""
    order = [F.desc("roc_auc"), F.desc(F.coalesce("pr_auc", F.lit(0.0))), F.desc(F.coalesce("f1", F.lit(0.0))), F.desc("model")]
    cols = ["profile", "model", "roc_auc", "pr_auc", "f1"]
    safe = metrics.filter((F.col("profile") == "safe") & F.col("roc_auc").isNotNull()).select(*cols, F.lit(1).alias("_k"))
    if fallback is not None:
        legacy = fallback.select(F.lit("legacy").alias("profile"), *cols[1:], F.lit(2).alias("_k"))
        safe = safe.unionByName(legacy)
    return safe.orderBy("_k", *order).limit(1).select(*cols)
