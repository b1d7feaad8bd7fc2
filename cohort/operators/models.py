"""Training and scoring.

Every model is fitted by MLlib (or by the distributed solver in ``gam``) and scored as a
DataFrame transform. Two layers: ``fit_*`` take raw columns and learn their preprocessing
on the training rows only; ``*_trainer`` take an assembled ``features`` vector and return
``Callable[[train, test], scored]`` for cross-validation and robustness work.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from cohort.functions.columns import column, quoted
from cohort.functions.hashing import uniform
from cohort.operators.clean import learn_fills, learn_scaling
from cohort.operators.evaluate import binary_metrics, regression_metrics, with_predictions
from cohort.operators.many import Fit, fit_many, metrics_of, ranked_fits, score_many
from cohort.operators.rank import text_literal
from cohort.operators.split import hash_rank, stratified_folds
from cohort.roles import ColumnRoles
from cohort.session import ensure_checkpoint_dir

Trainer = Callable[[DataFrame, DataFrame], DataFrame]

# Training defaults by preset and by row count (breaks at 400 and 1500 rows).
DEFAULTS = {
    "logistic": {"max_iter": 1500, "C": 1.0},
    "boosted": {"iterations": 300, "early_stopping_rounds": 30, "learning_rate": 0.05, "depth": 6},
    "gam": {"n_splines": 10, "optimize": False},
}
RESEARCH = {"gam": {"n_splines": 12, "optimize": True}}
AUTO = {
    "logistic": {"max_iter": [900, 1300, 1800]},
    "boosted": {"iterations": [220, 320, 420], "early_stopping_rounds": [20, 30, 40]},
}
AUTO_SPLINES = {"quick": [8, 10, 12], "research": [10, 12, 14]}


def training_params(train_rows: int | None = None, preset: str = "quick") -> dict[str, dict]:
    """Default parameters per model; with a row count, scaled to it."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    if preset == "research":
        out["gam"].update(RESEARCH["gam"])
    if train_rows is not None:
        size = 0 if train_rows < 400 else 1 if train_rows < 1500 else 2
        for model, values in AUTO.items():
            out[model].update({k: v[size] for k, v in values.items()})
        out["gam"].update(n_splines=AUTO_SPLINES[preset][size], optimize=preset == "research" or size >= 1)
    return out


def run_parallel(tasks: Sequence[Callable], workers: int = 4) -> list:
    """Independent Spark jobs submitted side by side; results in order."""
    if len(tasks) == 1:
        return [tasks[0]()]
    with ThreadPoolExecutor(min(workers, len(tasks))) as pool:
        carry = inheritable_thread_target(_session())
        return [f.result() for f in [pool.submit(carry(t)) for t in tasks]]


def positive_probability(name: str = "probability") -> Column:
    return F.element_at(vector_to_array(F.col(name)), 2)


ROWS_PER_PARTITION = 250_000


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """Even partitions, kept, for a table that an iterative fit reads again and again.

    ``source`` has as many rows as ``df`` and is cheaper to count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-source.count() // ROWS_PER_PARTITION))).persist(StorageLevel.MEMORY_AND_DISK)


# ---------------------------------------------------------------- preprocessing

@dataclass
class Design:
    """A fitted preprocessing pipeline that ends in a ``features`` vector."""

    pipeline: PipelineModel
    feature_names: list[str]
    roles: ColumnRoles
    max_levels: int = 0
    owners: list[str] | None = None  # the source column of each feature

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def assembled(self, df: DataFrame) -> DataFrame:
        """``row_id, y_true, features`` of a labelled table."""
        out = self.transform(df)
        return out.select(column(self.roles.row_id).alias("row_id"), column(self.roles.target).cast("int").alias("y_true"), "features")


def fit_design(train: DataFrame, roles: ColumnRoles, one_hot: bool = True, scale: bool = True) -> Design:
    """Median or mode fills, z-scores, and one-hot (or index) codes learnt on ``train``.

    A level not seen in training becomes all zeros. State is one number or word per column;
    the level tables live inside the string indexer.
    """
    roles = roles.present(train)
    numbers = [*roles.numeric, *roles.ordinal]
    nominal = list(roles.nominal) + ([roles.sensitive] if roles.sensitive else [])
    fills = learn_fills(train, numeric=roles.numeric, mode_numeric=roles.ordinal, text=nominal)
    numbers = [c for c in numbers if c not in fills.dropped]
    parts = []
    scaling = learn_scaling(fills.transform(train), numbers) if scale and numbers else None
    for i, c in enumerate(numbers):
        filled = f"coalesce(try_cast({quoted(c)} AS DOUBLE), {fills.numeric[c]!r}D)"
        if scaling:
            filled = f"({filled} - ({scaling.mean[c]!r}D)) / {scaling.std[c]!r}D"
        parts.append(f"{filled} AS num_{i}")
    for i, c in enumerate(nominal):
        parts.append(f"coalesce(cast({quoted(c)} AS STRING), {text_literal(fills.text[c])}) AS nom_{i}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    names, inputs = list(numbers), [f"num_{i}" for i in range(len(numbers))]
    owners, max_levels = list(numbers), 0
    if nominal:
        raw = [f"nom_{i}" for i in range(len(nominal))]
        indexed = [f"idx_{i}" for i in range(len(nominal))]
        stages.append(StringIndexer(inputCols=raw, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"))
        if one_hot:
            hot = [f"hot_{i}" for i in range(len(nominal))]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True))
            inputs += hot
        else:
            inputs += indexed
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    model = Pipeline(stages=stages).fit(train)
    if nominal:
        levels = model.stages[1].labelsArray
        max_levels = max(len(lv) for lv in levels) + 1
        names += [f"{c}_{v}" for c, lv in zip(nominal, levels) for v in lv] if one_hot else nominal
        owners += [c for c, lv in zip(nominal, levels) for _ in lv] if one_hot else nominal
    return Design(model, names, roles, max_levels, owners)


def with_class_weights(df: DataFrame, label: str = "y_true") -> tuple[DataFrame, float]:
    """Add ``weight`` = n / (2 n_class); returns the weight sum too."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(column(label).cast("double")).alias("p")).first()
    n, p = row["n"], row["p"] or 0.0
    heavy, light = (n / (2.0 * p) if p else 1.0), (n / (2.0 * (n - p)) if n > p else 1.0)
    return df.withColumn("weight", F.when(column(label) == 1, F.lit(heavy)).otherwise(F.lit(light))), float(n)


# ---------------------------------------------------------------- estimators on vectors

def logistic_estimator(weight_sum: float, C: float = 1.0, max_iter: int = 1500) -> LogisticRegression:
    """L2 penalty 1/(2C)·|b|² against the summed log-loss; the intercept is free."""
    return LogisticRegression(
        labelCol="y_true", featuresCol="features", weightCol="weight", maxIter=max_iter, tol=1e-6,
        regParam=1.0 / (C * weight_sum), elasticNetParam=0.0, standardization=False)


def boosted_estimator(
    iterations: int = 300, depth: int = 6, learning_rate: float = 0.05, max_bins: int = 32, seed: int = 42,
    validation: str | None = None, subsample: float = 1.0, min_leaf: int = 1,
) -> GBTClassifier:
    est = GBTClassifier(
        labelCol="y_true", featuresCol="features", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=learning_rate,
        maxBins=max(32, max_bins), seed=seed, subsamplingRate=subsample, minInstancesPerNode=min_leaf, checkpointInterval=10,
        cacheNodeIds=True)
    return est.setValidationIndicatorCol(validation) if validation else est


def validation_rows(df: DataFrame, key: str, label: str, share: float = 0.1) -> DataFrame:
    """Mark a class-balanced share of the training rows for early stopping."""
    ranked = hash_rank(df, key, "validation", [label])
    return ranked.withColumn("is_validation", (F.col("_rank") % max(2, round(1 / share))) == 0).drop("_rank")


@dataclass(frozen=True)
class LogisticTrainer:
    """A trainer that experiments may also fit many at once (``operators.many``)."""

    C: float = 1.0
    max_iter: int = 1000

    def __call__(self, train: DataFrame, test: DataFrame) -> DataFrame:
        weighted, total = with_class_weights(train)
        model = logistic_estimator(total, self.C, self.max_iter).fit(weighted)
        return _scored(model.transform(test))


def logistic_trainer(C: float = 1.0, max_iter: int = 1000) -> LogisticTrainer:
    return LogisticTrainer(C, max_iter)


def boosted_trainer(iterations: int = 20, depth: int = 4, learning_rate: float = 0.1, max_bins: int = 64, **extra) -> Trainer:
    def fit(train: DataFrame, test: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(train.sparkSession)
        weighted, _ = with_class_weights(train)
        model = boosted_estimator(iterations, depth, learning_rate, max_bins, **extra).fit(weighted)
        return _scored(model.transform(test))

    return fit


def _scored(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    keep = [c for c in ("row_id", "y_true", "fold") if c in df.columns]
    return with_predictions(df.select(*keep, positive_probability().alias("y_score")), threshold)


# ---------------------------------------------------------------- models on raw columns

@dataclass
class FittedModel:
    name: str
    design: Design | None
    model: object
    roles: ColumnRoles
    info: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_score``."""
        if self.name == "gam":
            return self.model.score(df)
        out = self.model.transform(self.design.transform(df))
        return out.select(*[column(c) for c in df.columns], positive_probability().alias("y_score"))

    def scored(self, df: DataFrame, threshold: float = 0.5, attributes: Sequence[str] = ()) -> DataFrame:
        """The evaluation shape ``row_id, y_true, y_score, y_pred`` plus attributes."""
        out = self.score(df).select(
            column(self.roles.row_id).alias("row_id"), column(self.roles.target).cast("int").alias("y_true"), "y_score",
            *[column(a) for a in attributes])
        return with_predictions(out, threshold)


def fit_logistic(train: DataFrame, roles: ColumnRoles, C: float = 1.0, max_iter: int = 1500, **_) -> FittedModel:
    design = fit_design(train, roles)
    table = spread(design.assembled(train), train)
    weighted, total = with_class_weights(table)
    model = logistic_estimator(total, C, max_iter).fit(weighted)
    table.unpersist()
    return FittedModel("logistic", design, model, roles)


def fit_boosted(
    train: DataFrame, roles: ColumnRoles, iterations: int = 300, depth: int = 6, learning_rate: float = 0.05,
    early_stopping_rounds: int | None = 30, **_,
) -> FittedModel:
    """Gradient-boosted trees on index-coded levels; early stopping watches training rows held back."""
    ensure_checkpoint_dir(train.sparkSession)
    design = fit_design(train, roles, one_hot=False, scale=False)
    table, _total = with_class_weights(spread(design.assembled(train), train))
    marked = validation_rows(table, "row_id", "y_true") if early_stopping_rounds else table
    est = boosted_estimator(iterations, depth, learning_rate, design.max_levels, validation="is_validation" if early_stopping_rounds else None)
    return FittedModel("boosted", design, est.fit(marked), roles)


def fit_perceptron(train: DataFrame, roles: ColumnRoles, hidden: int = 128, max_iter: int = 100, seed: int = 42, **_) -> FittedModel:
    """Feed-forward network with halving hidden layers."""
    design = fit_design(train, roles)
    table = spread(design.assembled(train), train)
    layers = [len(design.feature_names), hidden, max(2, hidden // 2), max(2, hidden // 4), 2]
    model = MultilayerPerceptronClassifier(labelCol="y_true", featuresCol="features", layers=layers, maxIter=max_iter, seed=seed).fit(table)
    return FittedModel("perceptron", design, model, roles)


def fit_gam_model(train: DataFrame, roles: ColumnRoles, n_splines: int = 10, optimize: bool = True, **_) -> FittedModel:
    from cohort.operators.gam import fit_gam

    model = fit_gam(train, roles, n_splines=n_splines, optimize=optimize)
    return FittedModel("gam", None, model, roles)


FITTERS = {"logistic": fit_logistic, "boosted": fit_boosted, "gam": fit_gam_model, "perceptron": fit_perceptron}


def fit_model(name: str, train: DataFrame, roles: ColumnRoles, **params) -> FittedModel:
    return FITTERS[name](train, roles, **{**DEFAULTS.get(name, {}), **params})


def train_test_metrics(model: FittedModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics of a fitted model on both parts, one row each."""
    parts = [model.scored(t).withColumn("split", F.lit(n)) for n, t in (("train", train), ("test", test))]
    return binary_metrics(reduce(DataFrame.unionByName, parts), ["split"])


def fit_boosted_regression(
    train: DataFrame, roles: ColumnRoles, iterations: int = 50, depth: int = 5, learning_rate: float = 0.1, seed: int = 42
) -> tuple[Design, object]:
    ensure_checkpoint_dir(train.sparkSession)
    design = fit_design(train, roles, one_hot=False, scale=False)
    table = spread(design.transform(train).select(column(roles.target).cast("double").alias("y_true"), "features"), train)
    est = GBTRegressor(labelCol="y_true", featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=learning_rate,
                       maxBins=max(32, design.max_levels), seed=seed, checkpointInterval=10)
    return design, est.fit(table)


def regression_report(design: Design, model, df: DataFrame) -> DataFrame:
    out = model.transform(design.transform(df)).select(column(design.roles.target).cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))
    return regression_metrics(out)


# ---------------------------------------------------------------- baselines

def baseline_scores(train: DataFrame, test: DataFrame, key: str, target: str, strategy: str = "prior", tag: str = "dummy") -> DataFrame:
    """Class-prior scores, or a stratified guess drawn from the row-key hash."""
    prior = train.agg(F.avg(column(target).cast("double"))).first()[0]
    rows = test.select(column(key).alias("row_id"), column(target).cast("int").alias("y_true"))
    if strategy == "prior":
        score = F.lit(prior)
    elif strategy == "stratified":
        score = (uniform("row_id", tag) < F.lit(prior)).cast("double")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return with_predictions(rows.select("row_id", "y_true", score.alias("y_score")), 0.5)


# ---------------------------------------------------------------- coefficients and importances

def coefficient_table(model: FittedModel) -> DataFrame:
    """Coefficients by size; one row per encoded feature."""
    rows = [(n, float(c), float(np.exp(c)), abs(float(c))) for n, c in zip(model.design.feature_names, model.model.coefficients.toArray())]
    return _session().createDataFrame(rows, "feature string, coefficient double, odds_ratio double, abs_coefficient double").orderBy(
        F.desc("abs_coefficient"), "feature")


def _session() -> SparkSession:
    """The running session; worker threads have no active one of their own."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def feature_importance(model: FittedModel, top: int | None = None) -> DataFrame:
    """Tree importances, absolute coefficients, or GAM term variances, largest first."""
    if model.name == "boosted":
        pairs = zip(model.design.feature_names, model.model.featureImportances.toArray())
    elif model.name == "gam":
        pairs = model.info.get("importance", [])
    else:
        pairs = zip(model.design.feature_names, np.abs(model.model.coefficients.toArray()))
    table = _session().createDataFrame([(n, float(v)) for n, v in pairs], "feature string, importance double")
    out = table.orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


# ---------------------------------------------------------------- cross-validation

def out_of_fold(table: DataFrame, trainer: Trainer, k: int = 5, tag: str = "fold", workers: int = 4) -> DataFrame:
    """Every row scored by the model that did not see it: ``row_id, y_true, y_score, y_pred, fold``."""
    folds = table if "fold" in table.columns else stratified_folds(table, "row_id", "y_true", k, tag)
    folds = folds.persist(StorageLevel.MEMORY_AND_DISK)
    if isinstance(trainer, LogisticTrainer):
        fitted = fit_many(folds, [Fit("model", left_out=i, C=trainer.C) for i in range(k)])
        return score_many(folds, fitted).select("row_id", "y_true", "y_score", "y_pred", "fold")

    def one(i: int) -> Callable[[], DataFrame]:
        return lambda: trainer(folds.filter(F.col("fold") != i), folds.filter(F.col("fold") == i)).withColumn("fold", F.lit(i))

    return reduce(DataFrame.unionByName, run_parallel([one(i) for i in range(k)], workers))


def fold_metrics(oof: DataFrame) -> DataFrame:
    return binary_metrics(oof, ["fold"])


CV_METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy")


def cross_validate(table: DataFrame, trainer: Trainer, k: int = 5, tag: str = "fold", metrics: Sequence[str] = CV_METRICS) -> DataFrame:
    """Mean and (population) SD over folds: ``(metric, mean, std, min, max)``."""
    per_fold = fold_metrics(out_of_fold(table, trainer, k, tag))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return per_fold.select(rows.alias("r")).select("r.*").groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


# Search ranges (low, high, scale).
SEARCH_SPACE = {
    "iterations": (50, 500, "int"),
    "depth": (3, 12, "int"),
    "learning_rate": (0.001, 0.3, "log"),
    "min_leaf": (1, 10, "int"),
    "subsample": (0.6, 1.0, "linear"),
}


def sample_params(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        trial = {}
        for name, (low, high, scale) in space.items():
            if scale == "int":
                trial[name] = int(rng.integers(low, high + 1))
            elif scale == "log":
                trial[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
            else:
                trial[name] = float(rng.uniform(low, high))
        out.append(trial)
    return out


def _cv_scores(folds: DataFrame, trainers: Sequence[LogisticTrainer], k: int, metric: str) -> list[tuple[float, float]]:
    """Mean and SD over folds of each trainer's metric, all models fitted together."""
    fits = [Fit(str(i), left_out=fold, C=t.C) for i, t in enumerate(trainers) for fold in range(k)]
    rows = metrics_of(folds, fits).groupBy("model").agg(F.avg(metric).alias("m"), F.stddev_pop(metric).alias("s")).collect()  # one per trainer
    found = {r["model"]: (r["m"], r["s"]) for r in rows}
    return [found[str(i)] for i in range(len(trainers))]


def search_params(
    table: DataFrame, make_trainer: Callable[..., Trainer], space: Mapping[str, tuple] = SEARCH_SPACE, n_trials: int = 20, k: int = 5,
    metric: str = "f1", seed: int = 42, workers: int = 2,
) -> tuple[DataFrame, dict]:
    """Random search by cross-validated score: the trials table and the best parameters.

    Folds are fixed once, so trials differ only in their parameters.
    """
    folds = stratified_folds(table, "row_id", "y_true", k).persist(StorageLevel.MEMORY_AND_DISK)
    trials = sample_params(space, n_trials, seed)
    trainers = [make_trainer(**p) for p in trials]

    def one(params: dict) -> Callable[[], tuple]:
        def run():
            row = fold_metrics(out_of_fold(folds, make_trainer(**params), k)).agg(
                F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")).first()
            return row["mean"], row["std"]
        return run

    if all(isinstance(t, LogisticTrainer) for t in trainers):
        results = _cv_scores(folds, trainers, k, metric)
    else:
        results = run_parallel([one(p) for p in trials], workers)
    rows = [(i, {n: float(v) for n, v in p.items()}, m, s) for i, (p, (m, s)) in enumerate(zip(trials, results))]
    out = table.sparkSession.createDataFrame(rows, "trial int, params map<string,double>, mean_score double, std_score double")
    best = max(zip(trials, results), key=lambda t: t[1][0])[0]
    return out.orderBy(F.desc("mean_score"), "trial"), best


def compare_default_and_tuned(table: DataFrame, make_trainer: Callable[..., Trainer], default: dict, tuned: dict, k: int = 5, metric: str = "f1") -> DataFrame:
    """Cross-validated score of both parameter sets on the same folds, with the improvement."""
    folds = stratified_folds(table, "row_id", "y_true", k).persist(StorageLevel.MEMORY_AND_DISK)
    scores = [
        fold_metrics(out_of_fold(folds, make_trainer(**p), k)).agg(
            F.lit(1).alias("_k"), F.avg(metric).alias(f"{n}_mean"), F.stddev_pop(metric).alias(f"{n}_std"))
        for n, p in (("default", default), ("tuned", tuned))
    ]
    both = scores[0].join(scores[1], "_k").drop("_k")  # one row each
    gain = F.col("tuned_mean") - F.col("default_mean")
    return both.select("*", gain.alias("improvement"), (F.when(F.col("default_mean") != 0, gain / F.col("default_mean")) * 100.0).alias("improvement_pct"))


def slice_features(table: DataFrame, names: Sequence[str], keep: Sequence[int]) -> DataFrame:
    """Keep some positions of the ``features`` vector."""
    sliced = VectorSlicer(inputCol="features", outputCol="_kept", indices=list(keep)).transform(table)
    return sliced.drop("features").withColumnRenamed("_kept", "features")
