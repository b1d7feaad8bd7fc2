"""How stable is a trainer under folds, noise, missing features and wrong labels?

All experiments take an assembled ``row_id, y_true, features`` table and a trainer
``Callable[[train, test], scored]``. Logistic refits share one scan per iteration; those of other
trainers are independent Spark jobs run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohort.functions.hashing import normal
from cohort.operators import models as M
from cohort.operators.compare import bootstrap_ci
from cohort.operators.evaluate import binary_metrics
from cohort.operators.split import hash_rank
from cohort.session import written

# Fixed values of the experiments.
NOISE_LEVELS = [0.01, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50]
FLIP_RATIOS = [0.01, 0.05, 0.10, 0.15, 0.20, 0.30]
BREAKING_AUC = 0.70
STABLE_RANGE = 0.05
GRADES = [(0.05, "A"), (0.10, "B"), (0.20, "C"), (0.30, "D")]
LAST_GRADE = "F"
# In order: what starts a name, what it holds, what it holds in any case, or what it is.
FEATURE_GROUPS = [
    ("City", {"starts": ["City_"]}),
    ("Degree", {"starts": ["Degree_"]}),
    ("Gender", {"starts": ["Gender_"]}),
    ("Sleep", {"starts": ["Sleep Duration_"]}),
    ("Dietary", {"starts": ["Dietary Habits_"]}),
    ("Family_History", {"starts": ["Family History"]}),
    ("Academic", {"holds": ["Academic Pressure", "Academic_Pressure"]}),
    ("Financial", {"folded": ["financial"]}),
    ("Work_Study", {"holds": ["Work", "Hours"]}),
    ("Numeric", {"is": ["Age", "CGPA", "Study Satisfaction"]}),
]


def cv_stability(table: DataFrame, trainer: M.Trainer, k: int = 5) -> DataFrame:
    """Spread of AUC, F1, precision and recall over folds; stable if AUC and F1 ranges are small."""
    summary = M.cross_validate(table, trainer, k, metrics=("roc_auc", "f1", "precision", "recall")).withColumn("range", F.col("max") - F.col("min"))
    judged = F.col("metric").isin("roc_auc", "f1")
    wide = summary.agg(F.min(F.when(judged, F.col("range") < STABLE_RANGE)).alias("stable"), F.lit(1).alias("_k"))
    return summary.withColumn("_k", F.lit(1)).join(F.broadcast(wide), "_k").drop("_k")  # a one-row side


def _auc_f1(scored: DataFrame) -> tuple[float, float]:
    row = binary_metrics(scored).first()
    return row["roc_auc"], row["f1"]


def noisy(table: DataFrame, level: float, tag: str = "noise", out: str = "features") -> DataFrame:
    """Gaussian noise of SD ``level`` on every feature, drawn from (row, feature) hashes."""
    x = F.col("_x")
    draws = F.transform(x, lambda v, i: v + F.lit(float(level)) * normal(F.concat(F.col("row_id").cast("string"), F.lit(":"), i.cast("string")), tag))
    return table.withColumn("_x", vector_to_array("features")).withColumn(out, array_to_vector(draws)).drop("_x")


def noise_test(table: DataFrame, trainer: M.Trainer, levels: Sequence[float] = NOISE_LEVELS, workers: int = 4) -> DataFrame:
    """Train on noisy features, score the clean ones: AUC and F1 drop per level, breaking point, grade."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    if isinstance(trainer, M.LogisticTrainer):
        (base, base_f1), *rest = M.ranked_fits(table, [M.Fit("clean", C=trainer.C)], [(v, f"noise{v}") for v in levels])
    else:
        tasks = [lambda: _auc_f1(trainer(table, table))] + [lambda v=v: _auc_f1(trainer(noisy(table, v, f"noise{v}"), table)) for v in levels]
        (base, base_f1), *rest = M.run_parallel(tasks, workers)
    rows = [(float(v), a, f, base, base_f1, base - a, base_f1 - f, (base - a) / base if base else 0.0) for v, (a, f) in zip(levels, rest)]
    out = table.sparkSession.createDataFrame(
        rows, "noise_level double, roc_auc double, f1 double, baseline_auc double, baseline_f1 double, auc_drop double, f1_drop double, auc_relative_drop double")
    return out


def robustness_grade(noise: DataFrame) -> DataFrame:
    """Score, grade and first level with AUC below 0.70."""
    drop = F.avg("auc_relative_drop")
    grade = F.lit(LAST_GRADE)
    for bound, name in reversed(GRADES):
        grade = F.when(F.col("avg_relative_drop") < bound, name).otherwise(grade)
    return noise.agg(
        drop.alias("avg_relative_drop"), F.min(F.when(F.col("roc_auc") < BREAKING_AUC, F.col("noise_level"))).alias("breaking_point")
    ).select("*", (1.0 - F.col("avg_relative_drop")).alias("score"), grade.alias("grade"))


def feature_group(name: str, groups=FEATURE_GROUPS, other: str = "Other") -> str:
    """First group with a rule that the feature's name meets."""
    tests = {"starts": name.startswith, "holds": name.__contains__, "folded": name.lower().__contains__, "is": name.__eq__}
    for group, rules in groups:
        if any(tests[kind](text) for kind, texts in rules.items() for text in texts):
            return group
    return other


def feature_ablation(table: DataFrame, names: Sequence[str], trainer: M.Trainer, groups=FEATURE_GROUPS, workers: int = 4) -> DataFrame:
    """AUC and F1 without each feature group, most damaging first."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    owners = [feature_group(n, groups) for n in names]
    found = [g for g in dict.fromkeys(owners) if any(o != g for o in owners)]

    def without(g: str):
        part = M.slice_features(table, names, [i for i, o in enumerate(owners) if o != g])
        return _auc_f1(trainer(part, part))

    if isinstance(trainer, M.LogisticTrainer):
        fits = [M.Fit(g, tuple(i for i, o in enumerate(owners) if o != g), C=trainer.C) for g in found]
        (base, base_f1), *rest = M.ranked_fits(table, [M.Fit("", C=trainer.C), *fits])
    else:
        (base, base_f1), *rest = M.run_parallel([lambda: _auc_f1(trainer(table, table))] + [lambda g=g: without(g) for g in found], workers)
    rows = [
        (g, owners.count(g), len(owners) - owners.count(g), a, f, base - a, base_f1 - f, (base - a) / base if base else 0.0)
        for g, (a, f) in zip(found, rest)
    ]
    return table.sparkSession.createDataFrame(
        rows, "group string, n_removed int, n_remaining int, roc_auc double, f1 double, auc_drop double, f1_drop double, auc_relative_drop double"
    ).orderBy(F.desc("auc_drop"), "group")


def flipped(table: DataFrame, ratio: float, tag: str = "flip") -> DataFrame:
    """Exactly floor(n * ratio) labels inverted, chosen by row hash."""
    n = table.count()
    ranked = hash_rank(table, "row_id", tag, [])
    y = F.when(F.col("_rank") <= int(n * ratio), 1 - F.col("y_true")).otherwise(F.col("y_true"))
    return ranked.withColumn("y_true", y.cast("int")).drop("_rank")


def label_flip_test(table: DataFrame, trainer: M.Trainer, ratios: Sequence[float] = FLIP_RATIOS, workers: int = 4) -> DataFrame:
    """Train on partly wrong labels, score against the true ones; drops from the clean fit and from the first level."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    n = table.count()
    if isinstance(trainer, M.LogisticTrainer):
        labels = table.select("row_id", "y_true")
        for i, r in enumerate(ratios):  # ranks of the narrow table; the features are joined once
            turned = F.when(F.col("_rank") <= int(n * r), 1 - F.col("y_true")).otherwise(F.col("y_true"))
            ranked = hash_rank(labels, "row_id", f"flip{r}", []).withColumn(f"y_{i}", turned.cast("int")).drop("_rank")
            labels = written(ranked)  # a ranking reads its rows twice: six in one plan would read them 64 times
        fits = [M.Fit("true", C=trainer.C)] + [M.Fit(f"flip{i}", label=f"y_{i}", C=trainer.C) for i in range(len(ratios))]
        (base, _), *rest = M.ranked_fits(table.join(labels.drop("y_true"), "row_id"), fits)
    else:
        tasks = [lambda: _auc_f1(trainer(table, table))] + [lambda r=r: _auc_f1(trainer(flipped(table, r, f"flip{r}"), table)) for r in ratios]
        (base, _), *rest = M.run_parallel(tasks, workers)
    first = rest[0][0]
    rows = [(float(r), int(n * r), a, f, base - a, first - a, a < BREAKING_AUC) for r, (a, f) in zip(ratios, rest)]
    return table.sparkSession.createDataFrame(
        rows, "flip_ratio double, n_flipped long, roc_auc double, f1 double, auc_drop_from_clean double, auc_drop_from_first double, broken boolean")


def robustness(
    table: DataFrame, names: Sequence[str], trainer: M.Trainer, k: int = 5, n_boot: int = 1000, groups=FEATURE_GROUPS
) -> dict[str, DataFrame]:
    """Every check for one trainer."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    noise = noise_test(table, trainer)
    return {
        "bootstrap": bootstrap_ci(trainer(table, table), n_boot),
        "cv_stability": cv_stability(table, trainer, k),
        "noise": noise,
        "grade": robustness_grade(noise),
        "ablation": feature_ablation(table, names, trainer, groups),
        "label_flip": label_flip_test(table, trainer),
    }
