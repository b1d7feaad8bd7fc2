"""Additive explanations: exact for linear and additive models, permutation for the rest."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohort.functions.columns import column
from cohort.operators.evaluate import binary_metrics, with_predictions
from cohort.operators.split import hash_rank


def linear_contributions(
    df: DataFrame, key: str, coefficients: Mapping[str, float], intercept: float = 0.0, background: DataFrame | None = None
) -> DataFrame:
    """``(row_id, base, phi)`` with phi_j = b_j (x_j - mean_j); means over ``background`` or ``df``."""
    names = list(coefficients)
    source = df if background is None else background
    means = source.agg(*[F.avg(column(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    base = float(intercept) + sum(float(coefficients[c]) * means[f"m{i}"] for i, c in enumerate(names))
    phi = F.array(*[F.lit(float(coefficients[c])) * (column(c).cast("double") - F.lit(means[f"m{i}"])) for i, c in enumerate(names)])
    return df.select(column(key).alias("row_id"), F.lit(base).alias("base"), phi.alias("phi"))


def model_contributions(model, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Contributions of a fitted logistic or additive model, with the feature names."""
    if model.name == "gam":
        return model.model.explain(df, model.roles.row_id), [t.name for t in model.model.terms]
    names = model.design.feature_names
    x = model.design.transform(df).select(column(model.roles.row_id).alias("row_id"), vector_to_array("features").alias("x"))
    means = x.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    beta = [float(b) for b in model.model.coefficients.toArray()]
    base = float(model.model.intercept) + sum(b * m for b, m in zip(beta, means))
    centre = F.array(*[F.lit(float(m)) for m in means])
    weights = F.array(*[F.lit(b) for b in beta])
    phi = F.zip_with(F.zip_with(F.col("x"), centre, lambda a, m: a - m), weights, lambda a, b: a * b)
    return x.select("row_id", F.lit(base).alias("base"), phi.alias("phi")), names


def top_contributions(contributions: DataFrame, names: Sequence[str], top: int = 5) -> DataFrame:
    """The ``top`` features per row by |phi|: ``(row_id, position, feature, phi)``."""
    labels = F.array(*[F.lit(n) for n in names])
    items = F.zip_with(F.col("phi"), labels, lambda p, n: F.struct((-F.abs(p)).alias("k"), n.alias("feature"), p.alias("phi")))
    first = F.slice(F.array_sort(items), 1, top)
    return contributions.select("row_id", "base", F.posexplode(first).alias("position", "item")).select(
        "row_id", "base", (F.col("position") + 1).alias("position"), "item.feature", "item.phi")


def global_importance(contributions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean |phi|, mean phi and SD of phi per feature, largest first."""
    labels = F.array(*[F.lit(n) for n in names])
    long = contributions.select(F.posexplode("phi").alias("i", "phi"))
    return long.groupBy("i").agg(
        F.avg(F.abs("phi")).alias("importance"), F.avg("phi").alias("mean_phi"), F.stddev_pop("phi").alias("std_phi")
    ).select(F.element_at(labels, F.col("i") + 1).alias("feature"), "importance", "mean_phi", "std_phi").orderBy(F.desc("importance"), "feature")


def permuted_column(df: DataFrame, key: str, name: str, tag: str = "permute") -> DataFrame:
    """``df`` with one column's values dealt out again over all rows.

    Two hash orders of the rows are matched rank to rank, so no task sees the whole column.
    """
    taker = hash_rank(df, key, tag + ":to", [], out="_at")
    giver = hash_rank(df.select(column(key), column(name).alias("_value")), key, tag + ":from", [], out="_at").select("_at", "_value")
    joined = taker.join(giver, "_at")
    return joined.select(*[(F.col("_value").alias(c) if c == name else column(c)) for c in df.columns])


def permutation_importance(model, df: DataFrame, columns: Sequence[str], tag: str = "permute") -> DataFrame:
    """Loss of AUC when a column is shuffled, for any fitted model."""
    base = binary_metrics(model.scored(df)).first()["roc_auc"]
    rows = []
    for name in columns:
        shuffled = permuted_column(df, model.roles.row_id, name, f"{tag}:{name}")
        auc = binary_metrics(model.scored(shuffled)).first()["roc_auc"]
        rows.append((name, base, auc, base - auc))
    table = df.sparkSession.createDataFrame(rows, "feature string, baseline_auc double, permuted_auc double, auc_drop double")
    return table.orderBy(F.desc("auc_drop"), "feature")
