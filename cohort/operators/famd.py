"""Factor analysis of mixed data: z-scored numbers beside weighted level indicators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohort.functions.columns import column, melt, ratio
from cohort.functions.linalg import in_task
from cohort.operators.models import Design, fit_design
from cohort.roles import ColumnRoles


def _components(cov: np.ndarray, scale: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first) and vectors of the scaled covariance; the largest entry is positive."""
    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    values, vectors = values[::-1], vectors[:, ::-1][:, :k]
    peak = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return np.maximum(values, 0.0), vectors * np.where(peak < 0, -1.0, 1.0)


@dataclass
class Famd:
    design: Design
    eigenvalues: np.ndarray
    axes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"F{i + 1}" for i in range(self.axes.shape[1])]

    def explained(self, spark) -> DataFrame:
        """Eigenvalue, share of the kept and of the whole variance, and running shares."""
        k = self.axes.shape[1]
        kept, total = float(self.eigenvalues[:k].sum()), float(self.eigenvalues.sum())
        rows = [(n, float(v), float(v) / kept, float(v) / total) for n, v in zip(self.names, self.eigenvalues)]
        table = spark.createDataFrame(rows, "component string, eigenvalue double, share_of_kept double, share_of_total double")
        run = Window.orderBy(F.desc("eigenvalue"), "component").rowsBetween(Window.unboundedPreceding, 0)  # one row per component
        return table.select("*", F.sum("share_of_kept").over(run).alias("cumulative_of_kept"), F.sum("share_of_total").over(run).alias("cumulative_of_total"))

    def coordinates(self, df: DataFrame) -> DataFrame:
        """``df`` with one column per component."""
        weights, shift = self.axes * self.scale[:, None], (self.mean * self.scale) @ self.axes

        @F.pandas_udf(ArrayType(DoubleType()))
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_list()) @ weights - shift))

        out = self.design.transform(df).select(*[column(c) for c in df.columns], project(vector_to_array("features")).alias("_f"))
        return out.select(*[column(c) for c in df.columns], *[F.col("_f")[i].alias(n) for i, n in enumerate(self.names)])


def fit_famd(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], n_components: int = 10) -> Famd:
    """Means and covariance in two distributed passes; the p x p eigenproblem is solved in a task."""
    roles = ColumnRoles("", "", list(numeric), [], list(categorical), None, [])
    design = fit_design(df, roles)
    vectors = design.transform(df).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    row = vectors.agg(
        Summarizer.mean(F.col("features")).alias("m"), Summarizer.variance(F.col("features")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    mean, n = row["m"].toArray(), row["n"]
    spread = np.sqrt(row["v"].toArray() * (n - 1) / n)
    corr = np.nan_to_num(Correlation.corr(vectors, "features").first()[0].toArray())  # p x p; a constant column has none
    np.fill_diagonal(corr, 1.0)
    cov = corr * np.outer(spread, spread)
    vectors.unpersist()
    share = mean.copy()
    share[: len(numeric)] = 1.0
    scale = 1.0 / np.sqrt(np.where(share > 0, share, 1.0))
    values, axes = in_task(df.sparkSession, _components, cov, scale, min(n_components, len(mean)))
    return Famd(design, values, axes, mean, scale)


def component_association(coords: DataFrame, components: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], shares: Sequence[float] | None = None) -> DataFrame:
    """Link of every variable to every component: r or eta, cos2 and contribution.

    ``cos2`` is r squared for numbers and the between-level share of variance for levels;
    ``contribution`` is cos2 over the component's explained share.
    """
    parts = []
    comp = [F.col(c) for c in components]
    if numeric:
        row = coords.agg(*[F.corr(column(v).cast("double"), c).alias(f"r{i}_{j}") for i, v in enumerate(numeric) for j, c in enumerate(comp)])
        items = F.explode(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.lit("numeric").alias("type"), F.lit(components[j]).alias("component"), F.col(f"r{i}_{j}").alias("r"))
            for i, v in enumerate(numeric) for j in range(len(components))
        ]))
        parts.append(row.select(items.alias("i")).select("i.*").select("variable", "type", "component", F.col("r").alias("correlation"), F.pow("r", F.lit(2.0)).alias("cos2")))
    if categorical:
        long = melt(coords, categorical, components, name="variable", value="level").filter(F.col("level").isNotNull())
        cells = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in components])
        items = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("m")) for c in components]))
        means = cells.select("variable", "n", items.alias("i")).select("variable", "n", "i.component", "i.m")
        totals = long.groupBy("variable").agg(*[F.var_pop(c).alias(c) for c in components], *[F.avg(c).alias(f"mean_{c}") for c in components])
        titems = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v"), F.col(f"mean_{c}").alias("g")) for c in components]))
        total = totals.select("variable", titems.alias("i")).select("variable", "i.component", "i.v", "i.g")
        joined = means.join(total, ["variable", "component"])
        eta = ratio(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2.0))) / F.sum("n"), F.max("v"), 0.0)
        parts.append(joined.groupBy("variable", "component").agg(eta.alias("cos2")).select(
            "variable", F.lit("categorical").alias("type"), "component", F.sqrt("cos2").alias("correlation"), "cos2"))
    out = reduce(DataFrame.unionByName, parts)
    if shares is None:
        return out
    share = F.element_at(F.create_map(*[F.lit(x) for kv in zip(components, map(float, shares)) for x in kv]), F.col("component"))
    return out.withColumn("contribution", ratio(F.col("cos2"), share, 0.0))


def top_variables(association: DataFrame, top: int = 10) -> DataFrame:
    order = Window.partitionBy("component").orderBy(F.desc("contribution"), "variable")
    return association.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
