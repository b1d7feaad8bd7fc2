"""Logistic additive model: cubic B-splines, factor levels, P-IRLS over Spark.

Each iteration is one pass: partitions turn their rows into the penalised normal equations
(a p x p matrix per smoothing value), the matrices are added up block by block across the
cluster and solved in a task, and only the coefficients reach the driver, whatever the row
count. All smoothing values of the grid advance in the same pass.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohort.functions.columns import column
from cohort.operators.clean import column_levels, learn_fills, learn_scaling
from cohort.roles import ColumnRoles

# Fixed values of the solver.
DEGREE = 3
LAMBDAS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0)
DEFAULT_LAMBDA = 10.0
MAX_ITER = 60
TOLERANCE = 1e-4
COEF_LIMIT = 10.0
RESPONSE_LIMIT = 50.0
ETA_LIMIT = 30.0
MARGIN = 0.01
RIDGE = 1e-4


def knots(n_splines: int, low: float, high: float) -> np.ndarray:
    """Evenly spaced clamped knots over the range widened by one percent on both sides."""
    span = high - low if high - low > 1e-12 else 1.0
    inner = np.linspace(low - MARGIN * span, high + MARGIN * span, n_splines + DEGREE + 1)
    return np.concatenate([[inner[0]] * DEGREE, inner, [inner[-1]] * DEGREE])


def basis(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """B-spline basis rows (they sum to one); values beyond the knots take the end value."""
    x = np.clip(np.asarray(x, float), grid[0], grid[-1])
    last = len(grid) - DEGREE - 2
    cell = np.clip(np.searchsorted(grid, x, side="right") - 1, DEGREE, last)
    out = np.zeros((len(x), len(grid) - 1))
    out[np.arange(len(x)), cell] = 1.0
    for d in range(1, DEGREE + 1):
        left, right = grid[d:-1] - grid[: -d - 1], grid[d + 1:] - grid[1:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (x[:, None] - grid[: -d - 1]) / left, 0.0)
            b = np.where(right > 0, (grid[d + 1:] - x[:, None]) / right, 0.0)
        out = a * out[:, :-1] + b * out[:, 1:]
    return out


def second_differences(k: int) -> np.ndarray:
    d = np.diff(np.eye(k), n=2, axis=0)
    return d.T @ d


@dataclass
class Term:
    """One column's part of the design."""

    name: str
    kind: str  # numeric, ordinal or nominal
    fill: float | str = 0.0
    mean: float = 0.0
    std: float = 1.0
    grid: list[float] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.levels) if self.kind == "nominal" else len(self.grid) - DEGREE - 1

    def design(self, values) -> np.ndarray:
        if self.kind == "nominal":
            index = {v: i for i, v in enumerate(self.levels)}
            back = index.get(self.fill, 0)
            out = np.zeros((len(values), self.width))
            out[np.arange(len(values)), [index.get(self.fill if v is None else v, back) for v in values]] = 1.0
            return out
        x = pd.to_numeric(pd.Series(values), errors="coerce").fillna(self.fill).to_numpy(float)
        return basis((x - self.mean) / self.std, np.array(self.grid))

    def penalty(self) -> np.ndarray:
        return np.zeros((self.width, self.width)) if self.kind == "nominal" else second_differences(self.width)


@dataclass
class GamModel:
    terms: list[Term]
    beta: np.ndarray
    covariance: np.ndarray
    lam: float
    stats: dict

    def slices(self) -> list[slice]:
        ends = np.cumsum([1, *[t.width for t in self.terms]])
        return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:])]

    def contributions(self) -> Column:
        """Array column: the intercept, then every term's part of the linear predictor."""
        terms, beta, slices = self.terms, self.beta, self.slices()

        @F.pandas_udf(ArrayType(DoubleType()))
        def parts(frame: pd.DataFrame) -> pd.Series:
            out = np.empty((len(frame), len(terms) + 1))
            out[:, 0] = beta[0]
            for i, (t, s) in enumerate(zip(terms, slices)):
                out[:, i + 1] = t.design(frame.iloc[:, i].tolist()) @ beta[s]
            return pd.Series(list(out))

        return parts(F.struct(*[_raw(t) for t in terms]))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_score``; knots and levels are those of the training rows."""
        eta = F.aggregate(F.col("_parts"), F.lit(0.0), lambda a, x: a + x)
        eta = F.greatest(F.least(eta, F.lit(ETA_LIMIT)), F.lit(-ETA_LIMIT))
        out = df.withColumn("_parts", self.contributions())
        return out.select(*[column(c) for c in df.columns], (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).alias("y_score"))

    def explain(self, df: DataFrame, key: str) -> DataFrame:
        """``(row_id, base, phi)``: each term's contribution less its mean over ``df``."""
        parts = df.select(column(key).alias("row_id"), self.contributions().alias("_parts")).persist(StorageLevel.MEMORY_AND_DISK)
        n = len(self.terms)
        means = parts.agg(*[F.avg(F.col("_parts")[i + 1]).alias(f"m{i}") for i in range(n)]).first()
        base = float(self.beta[0]) + sum(means[f"m{i}"] for i in range(n))
        phi = F.array(*[F.col("_parts")[i + 1] - F.lit(means[f"m{i}"]) for i in range(n)])
        return parts.select("row_id", F.lit(base).alias("base"), phi.alias("phi"))

    def importance(self, df: DataFrame) -> DataFrame:
        """Variance of each term's contribution, one pass."""
        parts = df.select(self.contributions().alias("_parts"))
        row = parts.agg(*[F.var_samp(F.col("_parts")[i + 1]).alias(f"v{i}") for i in range(len(self.terms))])
        items = F.explode(F.array(*[
            F.struct(F.lit(t.name).alias("feature"), F.lit(i).alias("term_index"), F.col(f"v{i}").alias("variance_importance"))
            for i, t in enumerate(self.terms)
        ]))
        return row.select(items.alias("i")).select("i.*").orderBy(F.desc("variance_importance"), "feature")

    def partial_dependence(self, spark, n_points: int = 100) -> DataFrame:
        """Effect of each term over its range with a 95% band: ``(feature, x, level, effect, lower, upper)``."""
        rows = []
        for t, s in zip(self.terms, self.slices()):
            if t.kind == "nominal":
                points, design, labels = [None] * t.width, np.eye(t.width), t.levels
            else:
                low, high = t.grid[DEGREE], t.grid[-DEGREE - 1]
                span = (high - low) / (1 + 2 * MARGIN)
                z = np.linspace(low + MARGIN * span, high - MARGIN * span, n_points)
                points, design, labels = list(z * t.std + t.mean), basis(z, np.array(t.grid)), [None] * n_points
            effect = design @ self.beta[s]
            half = 1.959963984540054 * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", design, self.covariance[s, s], design), 0.0))
            rows += [(t.name, None if p is None else float(p), lv, float(e), float(e - h), float(e + h)) for p, lv, e, h in zip(points, labels, effect, half)]
        return spark.createDataFrame(rows, "feature string, x double, level string, effect double, lower double, upper double")

    def interpretation(self, spark) -> DataFrame:
        """Range and direction of each term's effect."""
        pd_table = self.partial_dependence(spark)
        ends = pd_table.groupBy("feature").agg(
            F.min("effect").alias("effect_min"), F.max("effect").alias("effect_max"),
            F.min_by("effect", F.struct("x", "level")).alias("_first"), F.max_by("effect", F.struct("x", "level")).alias("_last"))
        direction = F.when(F.col("_last") > F.col("_first"), "positive").when(F.col("_last") < F.col("_first"), "negative").otherwise("nonlinear")
        return ends.select("feature", "effect_min", "effect_max", (F.col("effect_max") - F.col("effect_min")).alias("effect_span"), direction.alias("direction"))

    def to_json(self) -> str:
        return json.dumps({
            "terms": [t.__dict__ for t in self.terms], "beta": self.beta.tolist(), "covariance": self.covariance.tolist(),
            "lam": self.lam, "stats": self.stats})

    @staticmethod
    def from_json(text: str) -> "GamModel":
        raw = json.loads(text)
        return GamModel([Term(**t) for t in raw["terms"]], np.array(raw["beta"]), np.array(raw["covariance"]), raw["lam"], raw["stats"])


def _raw(term: Term) -> Column:
    if term.kind == "nominal":
        return column(term.name).cast("string").alias("c")
    return column(term.name).try_cast("double").alias("c")


def fit_terms(train: DataFrame, roles: ColumnRoles, n_splines: int = 10) -> list[Term]:
    """Fills, scaling, knots and levels of the training rows."""
    roles = roles.present(train)
    nominal = list(roles.nominal) + ([roles.sensitive] if roles.sensitive else [])
    fills = learn_fills(train, numeric=roles.numeric, mode_numeric=roles.ordinal, text=nominal)
    numbers = [c for c in [*roles.numeric, *roles.ordinal] if c not in fills.dropped]
    filled = fills.transform(train)
    scaling = learn_scaling(filled, roles.numeric)
    ends = filled.agg(*[f(column(c)).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("lo", F.min), ("hi", F.max))]).first() if numbers else None
    levels = column_levels(filled, nominal) if nominal else {}
    terms = []
    for i, c in enumerate(numbers):
        mean, std = (scaling.mean[c], scaling.std[c]) if c in roles.numeric else (0.0, 1.0)
        low, high = (float(ends[f"lo{i}"]) - mean) / std, (float(ends[f"hi{i}"]) - mean) / std
        terms.append(Term(c, "numeric" if c in roles.numeric else "ordinal", fills.numeric[c], mean, std, knots(n_splines, low, high).tolist()))
    return terms + [Term(c, "nominal", fills.text[c], levels=list(levels[c])) for c in nominal]


LINES_PER_BLOCK = 16
FAN_IN = 256  # partial sums that one task adds up


def _newton_step(
    rows: DataFrame, terms: Sequence[Term], betas: np.ndarray, lambdas: Sequence[float], penalty: np.ndarray, partitions: int
) -> list:
    """One pass for all smoothing values: ``(g, beta, edf, deviance, n, covariance)`` each.

    Partitions emit their part of [X'WX | X'Wz] in blocks of matrix lines; equal blocks are
    added up in parallel and the system is solved in a task.
    """
    g, p = betas.shape

    def partial(batches):
        gram, rhs, deviance, count = np.zeros((g, p, p)), np.zeros((g, p)), np.zeros(g), 0
        for frame in batches:
            y = frame["y"].to_numpy(float)
            x = np.hstack([np.ones((len(y), 1))] + [t.design(frame[f"c{i}"].tolist()) for i, t in enumerate(terms)])
            for j in range(g):
                eta = np.clip(x @ betas[j], -ETA_LIMIT, ETA_LIMIT)
                mu = 1.0 / (1.0 + np.exp(-eta))
                w = np.maximum(mu * (1.0 - mu), 1e-8)
                z = np.clip(eta + (y - mu) / w, -RESPONSE_LIMIT, RESPONSE_LIMIT)
                xw = x * w[:, None]
                gram[j] += x.T @ xw
                rhs[j] += xw.T @ z
                deviance[j] += -2.0 * float(np.sum(y * np.log(mu) + (1 - y) * np.log1p(-mu)))
            count += len(y)
        if count:
            for j in range(g):
                lines = np.hstack([gram[j], rhs[j][:, None], np.full((p, 1), deviance[j]), np.full((p, 1), count)])
                for at in range(0, p, LINES_PER_BLOCK):
                    yield pd.DataFrame({
                        "g": [j], "block": [at // LINES_PER_BLOCK], "part": [TaskContext.get().partitionId()],
                        "v": [lines[at:at + LINES_PER_BLOCK].ravel()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(frame["v"].to_list()), axis=0)
        return pd.DataFrame({"g": frame["g"].iloc[:1], "block": frame["block"].iloc[:1], "part": frame["part"].iloc[:1], "v": [total]})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        lines = np.concatenate(frame.sort_values("block")["v"].to_list()).reshape(p, p + 3)
        j, gram, n = int(frame["g"].iloc[0]), lines[:, :p], lines[0, p + 2]
        ridge = RIDGE * n * np.diag([0.0] + [1.0] * (p - 1))  # the bases all contain the constant
        inverse = np.linalg.inv(gram + lambdas[j] * penalty + ridge)
        beta = inverse @ lines[:, p]
        beta[1:] = np.clip(beta[1:], -COEF_LIMIT, COEF_LIMIT)
        return pd.DataFrame({"g": [j], "beta": [beta], "edf": [float(np.sum(inverse * gram.T))], "deviance": [lines[0, p + 1]],
                             "n": [int(n)], "covariance": [inverse.ravel()]})

    blocks = "g int, block int, part int, v array<double>"
    summed = rows.mapInPandas(partial, blocks)
    while partitions > FAN_IN:  # a tree of sums on a wide cluster
        partitions = -(-partitions // FAN_IN)
        summed = summed.withColumn("part", F.col("part") % partitions).groupBy("g", "block", "part").applyInPandas(add, blocks)
    summed = summed.groupBy("g", "block").applyInPandas(add, blocks)
    solved = summed.groupBy("g").applyInPandas(solve, "g int, beta array<double>, edf double, deviance double, n long, covariance array<double>")
    return sorted(solved.collect(), key=lambda r: r["g"])  # one row per smoothing value


def fit_gam(train: DataFrame, roles: ColumnRoles, n_splines: int = 10, optimize: bool = True, lambdas: Sequence[float] = LAMBDAS) -> GamModel:
    """Penalised iteratively reweighted least squares; the smoothing value minimises GCV."""
    from cohort.operators.models import spread

    terms = fit_terms(train, roles, n_splines)
    rows = spread(train.select(
        column(roles.target).cast("double").alias("y"), *[_raw(t).alias(f"c{i}") for i, t in enumerate(terms)]
    ).filter(F.col("y").isNotNull()), train)
    partitions = rows.rdd.getNumPartitions()
    grid = list(lambdas) if optimize else [DEFAULT_LAMBDA]
    p = 1 + sum(t.width for t in terms)
    penalty = np.zeros((p, p))
    at = 1
    for t in terms:
        penalty[at:at + t.width, at:at + t.width] = t.penalty()
        at += t.width
    betas = np.zeros((len(grid), p))
    active, results, iterations = list(range(len(grid))), {}, 0
    while active and iterations < MAX_ITER:
        iterations += 1
        still = []
        steps = _newton_step(rows, terms, betas[active], [grid[j] for j in active], penalty, partitions)
        for j, r in zip(active, steps):
            results[j], fresh = r, np.array(r["beta"])
            change = np.max(np.abs(fresh - betas[j])) / max(1.0, np.max(np.abs(betas[j])))
            betas[j] = fresh
            if change > TOLERANCE:
                still.append(j)
        active = still
    rows.unpersist()
    gcv = {j: r["deviance"] / (r["n"] * max(1.0 - r["edf"] / r["n"], 1e-6) ** 2) for j, r in results.items()}
    best = min(gcv, key=gcv.get)
    r = results[best]
    stats = {"iterations": iterations, "converged": best not in active, "deviance": float(r["deviance"]), "edf": float(r["edf"]),
             "gcv": float(gcv[best]), "rows": int(r["n"])}
    return GamModel(terms, betas[best], np.array(r["covariance"]).reshape(p, p), grid[best], stats)
