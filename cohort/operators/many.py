"""Many weighted logistic models from one scan per iteration.

Folds, left-out columns, noise levels, changed labels and penalties ask for the same model again
and again over the same rows. Here the rows are packed once into blocks of numbers, and each pass
over the blocks gives the loss and the gradient of every model that has not converged: two matrix
products a block. Models step side by side by limited-memory quasi-Newton updates that start from the
curvature bound X'X / 4 of their features (Boehning and Lindsay), summed in one pass, so a handful of
passes suffices. The driver holds coefficients and one such matrix per features column, never rows.
Tasks hand on one row per model, summed on the executors. Blocks are kept packed column by column.

Noise levels change every feature, so their blocks can't be shared: they are made level by level from
the clean blocks, kept until that level's model is found, and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from cohort.functions.columns import column, ratio
from cohort.functions.hashing import Keys
from cohort.operators.evaluate import binary_metrics, with_predictions
from cohort.operators.rank import range_bounds

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 16384
CHUNK_ROWS = 65_536  # scores counted together before they are handed on
ROWS_PER_PARTITION = 250_000
HISTORY = 20
WIDEST_GRAM = 2048  # beyond this many features steps start from the diagonal: more passes, the same optimum


@dataclass(frozen=True)
class Fit:
    """One model to fit.

    ``keep`` are the positions of the feature vector it may use (None: all), ``left_out`` is the fold
    it does not see (None: it sees all rows), ``features`` and ``label`` the columns it learns from.
    """

    name: str
    keep: tuple[int, ...] | None = None
    left_out: int | None = None
    features: str = "features"
    label: str = "y_true"
    C: float = 1.0


@dataclass
class Fitted:
    """Coefficients (one row per model, the intercept last) and how the solver ended."""

    fits: list[Fit]
    coefficients: np.ndarray
    loss: np.ndarray
    gradient: np.ndarray  # largest absolute component per model
    rows: np.ndarray
    passes: int
    tol: float
    seen: np.ndarray  # rows and positives per model

    def report(self, spark) -> DataFrame:
        """One row per model: rows learnt from, penalised mean loss, largest gradient, whether it converged."""
        out = [
            (f.name, f.left_out, int(n), float(l), float(g), bool(g <= self.tol))
            for f, n, l, g in zip(self.fits, self.rows, self.loss, self.gradient)
        ]
        return spark.createDataFrame(out, "model string, left_out int, n long, loss double, max_gradient double, converged boolean")


_BLOCK = "n int, packed boolean, x binary, y binary, fold binary, keys binary, ends binary"


def _block(x: np.ndarray, y: np.ndarray, fold: np.ndarray, keys: bytes, ends: np.ndarray, packed: bool = True) -> pa.RecordBatch:
    """One block as a row. ``x`` is (features column, row, number), laid out column by column and compressed if ``packed``."""
    numbers = np.ascontiguousarray(x.transpose(0, 2, 1)).tobytes()
    return pa.RecordBatch.from_arrays([
        pa.array([x.shape[1]], pa.int32()), pa.array([packed]),
        pa.array([pa.compress(numbers, codec="zstd", asbytes=True) if packed else numbers], pa.binary()),
        pa.array([y.tobytes()], pa.binary()), pa.array([fold.tobytes()], pa.binary()), pa.array([keys], pa.binary()), pa.array([ends.tobytes()], pa.binary()),
    ], names=["n", "packed", "x", "y", "fold", "keys", "ends"])


def _numbers(x: bytes, packed: bool, n: int, y: np.ndarray, variants: int, width: int) -> np.ndarray:
    """(features column, row, number) of a block."""
    whole = pa.decompress(x, 8 * n * variants * width, codec="zstd", asbytes=True) if packed and n * width else x
    return np.frombuffer(whole).reshape(variants, width, n).transpose(0, 2, 1)


def _blocks(table: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``_BLOCK`` rows: rows as packed doubles, one matrix per features column, one line per label, and their keys as text."""
    rows = table.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    fold = F.col("fold").cast("int") if "fold" in table.columns else F.lit(-1)
    lean = table.select("row_id", fold.alias("_fold"), *[column(c).alias(f"_v{i}") for i, c in enumerate(features)],
                        *[column(c).cast("double").alias(f"_y{i}") for i, c in enumerate(labels)])
    lean = lean.repartition(max(cores, -(-rows // ROWS_PER_PARTITION)), "row_id")
    wide = lean.select("_fold", *[vector_to_array(f"_v{i}").alias(f"_v{i}") for i in range(len(features))], *[f"_y{i}" for i in range(len(labels))],
                       F.col("row_id").cast("string").cast("binary").alias("_key"))
    n_features, n_labels, limit, most = len(features), len(labels), BLOCK_BYTES, BLOCK_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            xs = [batch.column(1 + i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in range(n_features)]
            ys = [batch.column(1 + n_features + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n_labels)]
            fold = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            keys = batch.column(1 + n_features + n_labels).to_pylist()
            step = int(min(most, max(1, limit // (8 * n_features * max(1, xs[0].shape[1])))))
            for start in range(0, batch.num_rows, step):
                cut = slice(start, start + step)
                ends = np.array([-1 if k is None else len(k) for k in keys[cut]], np.int32)
                yield _block(np.stack([x[cut] for x in xs]), np.stack([y[cut] for y in ys]), fold[cut], b"".join(k for k in keys[cut] if k), ends)

    return wide.mapInArrow(pack, _BLOCK)


def _noisy(blocks: DataFrame, width: int, level: float, tag: str) -> DataFrame:
    """Blocks of one features column with Gaussian noise of SD ``level``: the draws of ``hashing.normal`` for every (row, feature)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for n, packed, x, y, fold, keys, ends in zip(*[c.to_pylist() for c in batch.columns]):
                lengths = np.frombuffer(ends, np.int32)
                if (lengths < 0).any():
                    raise ValueError("noise is drawn from the row's id, which is null for some rows")
                drawn, out = Keys(keys, lengths), np.empty((1, n, width), order="F")
                clean = _numbers(x, packed, n, None, 1, width)[0]
                for i in range(width):
                    out[0, :, i] = clean[:, i] + level * drawn.normals(f":{i}", tag)
                yield _block(out, np.frombuffer(y).reshape(-1, n), np.frombuffer(fold, np.int32), keys, lengths, packed=False)

    return blocks.mapInArrow(add, _BLOCK)


def _summed(blocks: DataFrame, count: int, length: int, variants: int, width: int, sums_of) -> np.ndarray:
    """``count`` arrays of ``length`` numbers: ``sums_of(n, x, y, fold, out)`` adds a block's share to ``out``; without ``width`` it gets no x."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        out, seen = np.zeros((count, length)), False
        for batch in batches:
            for n, packed, x, y, fold in zip(*[c.to_pylist() for c in batch.columns[:5]]):
                seen, labels = True, np.frombuffer(y).reshape(-1, n)
                sums_of(n, _numbers(x, packed, n, labels, variants, width) if width else None, labels, np.frombuffer(fold, np.int32), out)
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([
                pa.array(range(count), pa.int32()), pa.array([part] * count, pa.int32()), pa.array([row.tobytes() for row in out], pa.binary()),
            ], names=["model", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        done = {}
        for batch in batches:
            for m, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                done[m] = done[m] + np.frombuffer(blob) if m in done else np.frombuffer(blob)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(done), pa.int32()), pa.array([v.tobytes() for v in done.values()], pa.binary())], names=["model", "sums"])

    parts = blocks.mapInArrow(sums, "model int, part int, sums binary")
    spread = min(count, blocks.sparkSession.sparkContext.defaultParallelism)
    # in the order of the tasks, so that sums do not depend on which one came first
    totals = parts.repartition(spread, "model").sortWithinPartitions("model", "part").mapInArrow(add, "model int, sums binary")
    out = np.zeros((count, length))
    for row in totals.collect():  # one row per model
        out[row["model"]] = np.frombuffer(bytes(row["sums"]))
    return out


def _class_counts(blocks: DataFrame, label, left_out) -> np.ndarray:
    """Rows and positives that each model sees."""

    def sums_of(n, x, y, fold, out):
        import numpy as np

        t = y[label].T
        used = ~np.isnan(t) & (fold[:, None] != left_out[None, :])
        out[:, 0] += used.sum(axis=0)
        out[:, 1] += np.where(used, t, 0.0).sum(axis=0)

    return _summed(blocks, len(label), 2, 1, 0, sums_of)


def _curvature(blocks: DataFrame, variants: int, width: int, full: bool) -> np.ndarray:
    """Per features column X'X with a column of ones last, or only its diagonal."""

    def sums_of(n, x, y, fold, out):
        import numpy as np

        for v, part in enumerate(x):
            own = np.column_stack([part, np.ones(n)])
            out[v] += (own.T @ own).ravel() if full else (own ** 2).sum(axis=0)

    return _summed(blocks, variants, (width + 1) ** 2 if full else width + 1, variants, width, sums_of)


def _loss_and_gradient(blocks: DataFrame, variants: int, width: int, variant, label, left_out, theta, heavy, light) -> np.ndarray:
    """Per model the summed loss, then its gradient with the intercept's last."""

    def sums_of(n, xs, y, fold, out):
        import numpy as np

        for v in np.unique(variant):
            at = np.flatnonzero(variant == v)
            t = y[label[at]].T
            used = ~np.isnan(t) & (fold[:, None] != left_out[at][None, :])
            t = np.where(used, t, 0.0)
            z = xs[v] @ theta[at, :width].T + theta[at, width]
            w = np.where(used, np.where(t == 1, heavy[at], light[at]), 0.0)
            out[at, 0] += (w * (np.logaddexp(0.0, z) - t * z)).sum(axis=0)
            r = w * (0.5 * (1.0 + np.tanh(0.5 * z)) - t)
            out[at, 1:-1] += r.T @ xs[v]
            out[at, -1] += r.sum(axis=0)

    return _summed(blocks, len(variant), width + 2, variants, width, sums_of)


def _direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], start) -> np.ndarray:
    """Two-loop quasi-Newton step; ``start`` applies the first guess of the inverse curvature."""
    q, alphas = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        alphas.append(a)
    h = start(q)
    if past:
        s, y = past[-1]
        h *= (s @ y) / (y @ start(y))
    for (s, y), a in zip(past, reversed(alphas)):
        h += (a - (y @ h) / (s @ y)) * s
    return -h


def _starts(curvature: np.ndarray, variant: np.ndarray, rows: int, ridge: np.ndarray, free: np.ndarray, full: bool) -> list:
    """Per model a function that solves with its curvature bound; equal models share one factor."""
    width, shared, out = free.shape[1], {}, []
    for v, r, mask in zip(variant, ridge, free > 0):
        key = (int(v), float(r), mask.tobytes())
        if key not in shared:
            at = np.flatnonzero(mask)
            penalty = np.where(at < width - 1, r, 0.0)
            inverse = np.zeros((width, width)) if full else np.zeros(width)
            if full:
                bound = 0.25 * curvature[v].reshape(width, width)[np.ix_(at, at)] / rows + np.diag(penalty + 1e-12)
                inverse[np.ix_(at, at)] = np.linalg.inv(bound)
            else:
                inverse[at] = 1.0 / (0.25 * curvature[v][at] / rows + penalty + 1e-12)
            shared[key] = (lambda q, m=inverse: m @ q) if full else (lambda q, m=inverse: m * q)
        out.append(shared[key])
    return out


def fit_many(table: DataFrame, fits: Sequence[Fit], tol: float = 1e-6, max_passes: int = 1000) -> Fitted:
    """Fit all models side by side: ``row_id``, vector and label columns, and ``fold`` where a fit names one.

    Each minimises the mean of class-weighted log-losses plus ``|b|^2 / (2 C n)``, the intercept free, until
    no component of its gradient exceeds ``tol``. Rows whose label is null teach nothing; a class weight is
    n / (2 n_class) over the rows a model sees.
    """
    fits = list(fits)
    features, labels = _names(fits)
    blocks = _blocks(table, features, labels).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(blocks, _width(table, features[0]), fits, tol, max_passes)
    finally:
        blocks.unpersist()


def _names(fits: Sequence[Fit]) -> tuple[list[str], list[str]]:
    """The features and label columns of the fits."""
    return list(dict.fromkeys(f.features for f in fits)), list(dict.fromkeys(f.label for f in fits))


def _width(table: DataFrame, features: str) -> int:
    first = table.select(F.size(vector_to_array(column(features))).alias("p")).first()
    return first["p"] if first else 0


def _fit(blocks: DataFrame, p: int, fits: Sequence[Fit], tol: float = 1e-6, max_passes: int = 1000, seen: np.ndarray | None = None) -> Fitted:
    """``fit_many`` over packed blocks, which hold the features and labels in the order of the fits.

    ``seen`` are rows and positives per model, if they are known.
    """
    features, labels = _names(fits)
    variant, label = np.array([features.index(f.features) for f in fits]), np.array([labels.index(f.label) for f in fits])
    left_out = np.array([-2 if f.left_out is None else f.left_out for f in fits])
    seen = _class_counts(blocks, label, left_out) if seen is None else seen
    n, pos = np.maximum(seen[:, 0], 1.0), seen[:, 1]
    heavy, light = np.where(pos > 0, n / (2 * np.maximum(pos, 1)), 1.0), np.where(n > pos, n / (2 * np.maximum(n - pos, 1)), 1.0)
    ridge = np.array([1.0 / f.C for f in fits]) / n
    free = np.zeros((len(fits), p + 1))
    free[:, p] = 1.0
    for i, f in enumerate(fits):
        free[i, list(range(p) if f.keep is None else f.keep)] = 1.0
    full = p <= WIDEST_GRAM
    most = int(max(n))
    # the penalty of the largest fit stands for all of one C, so folds share a factor
    starts = _starts(_curvature(blocks, len(features), p, full), variant, most, np.array([1.0 / (f.C * most) for f in fits]), free, full)

    def evaluate(at: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = _loss_and_gradient(blocks, len(features), p, variant[at], label[at], left_out[at], theta, heavy[at], light[at]) / n[at][:, None]
        penalty = theta * ridge[at][:, None]
        penalty[:, p] = 0.0
        return got[:, 0] + 0.5 * (penalty * theta).sum(axis=1), (got[:, 1:] + penalty) * free[at]

    theta = np.zeros((len(fits), p + 1))
    everyone = np.arange(len(fits))
    f, g = evaluate(everyone, theta)
    past: list[list] = [[] for _ in fits]
    length = np.ones(len(fits))
    ways = [None] * len(fits)
    passes = 3
    while passes < max_passes:
        active = everyone[np.abs(g).max(axis=1) > tol]
        if not len(active):
            break
        for i in active:
            if ways[i] is None:
                ways[i] = _direction(g[i], past[i], starts[i])
                if g[i] @ ways[i] >= 0:  # no descent: start over
                    past[i], ways[i] = [], -starts[i](g[i])
        trial = theta[active] + length[active][:, None] * np.array([ways[i] for i in active])
        f_new, g_new = evaluate(active, trial)
        passes += 1
        for j, i in enumerate(active):
            slope = length[i] * (g[i] @ ways[i])
            if not f_new[j] <= f[i] + 1e-4 * slope + 1e-14 * abs(f[i]):
                length[i] *= 0.5
                if length[i] < 1e-10:  # nothing left to gain in this direction
                    past[i], ways[i], length[i] = [], None, 1.0
                continue
            s, y = trial[j] - theta[i], g_new[j] - g[i]
            if s @ y > 1e-16 * (y @ y):
                past[i] = [*past[i][1 - HISTORY:], (s, y)]
            theta[i], f[i], g[i], ways[i], length[i] = trial[j], f_new[j], g_new[j], None, 1.0
    return Fitted(list(fits), theta, f, np.abs(g).max(axis=1), seen[:, 0], passes, tol, seen)


def score_many(table: DataFrame, fitted: Fitted, features: str = "features") -> DataFrame:
    """``(model, fold, row_id, y_true, y_score, y_pred)`` from one scan of ``features``.

    A model with a left-out fold scores only that fold; any other scores every row, with a null ``fold``.
    """
    fold = F.col("fold").cast("int") if "fold" in table.columns else F.lit(-1)
    rows = table.select(fold.alias("fold"), "row_id", F.col("y_true").cast("int").alias("y_true"), vector_to_array(column(features)).alias("_x"))
    kind = dict(table.dtypes)["row_id"]
    theta, names, left_out = fitted.coefficients, [f.name for f in fitted.fits], [f.left_out for f in fitted.fits]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for name, out, b in zip(names, left_out, theta):
                at = np.arange(batch.num_rows) if out is None else np.flatnonzero(fold == out)
                z = x[at] @ b[:-1] + b[-1]
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(at), pa.string()), pa.array([out] * len(at), pa.int32()), batch.column(1).take(pick),
                    batch.column(2).take(pick), pa.array(0.5 * (1.0 + np.tanh(0.5 * z)), pa.float64()),
                ], names=["model", "fold", "row_id", "y_true", "y_score"])

    return with_predictions(rows.mapInArrow(score, f"model string, fold int, row_id {kind}, y_true int, y_score double"), 0.5)


def metrics_of(table: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Metrics per (model, fold) of the fits scored on the clean features and the true labels."""
    return binary_metrics(score_many(table, fit_many(table, fits)), ["model", "fold"])


def ranked_fits(table: DataFrame, fits: Sequence[Fit], levels: Sequence[tuple[float, str]] = ()) -> list[tuple[float, float]]:
    """ROC-AUC and F1 of models that see all rows of one features column, on the clean rows and the labels of the first fit.

    ``levels`` adds a copy of the first fit per (SD, tag) that learns from noisy features; only one level's rows are held at a time.
    """
    features, labels = _names(fits)
    blocks = _blocks(table, features, labels).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        p = _width(table, features[0])
        fitted = _fit(blocks, p, list(fits))
        theta = [fitted.coefficients]
        for level, tag in levels:
            noisy = _noisy(blocks, p, float(level), tag).persist(StorageLevel.DISK_ONLY)  # too large for the heap beside the rest
            try:
                theta.append(_fit(noisy, p, list(fits[:1]), seen=fitted.seen[:1]).coefficients)
            finally:
                noisy.unpersist(blocking=True)
        return _auc_f1(blocks, p, np.concatenate(theta))
    finally:
        blocks.unpersist()


def _scores(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One column per model."""
    return 0.5 * (1.0 + np.tanh(0.5 * (x @ theta[:, :-1].T + theta[:, -1])))


def _auc_f1(blocks: DataFrame, p: int, theta: np.ndarray) -> list[tuple[float, float]]:
    """ROC-AUC and F1 per model over the first label: as ``binary_metrics``, but counts of scores travel as packed numbers."""
    models = len(theta)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, rows = [], 0
        for batch in batches:
            for n, packed, x, y in zip(*[c.to_pylist() for c in batch.columns[:4]]):
                labels = np.frombuffer(y).reshape(-1, n)
                known = ~np.isnan(labels[0])
                held.append((_scores(_numbers(x, packed, n, labels, 1, p)[0], theta)[known], labels[0][known] == 1))
                rows += n
                if rows >= CHUNK_ROWS:
                    yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held, rows = [], 0
        if held:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for s, _ in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in s.T], names=[f"s{m}" for m in range(models)])

    names = [f"s{m}" for m in range(models)]
    found = range_bounds(blocks.mapInArrow(plain, ", ".join(f"{c} double" for c in names)), names)
    bounds = [np.array(found[c]) for c in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per model and range of scores: the different scores, ascending, with their rows and positive rows."""
        import numpy as np
        import pyarrow as pa

        for s, positive in chunks(batches):
            out = []
            for m in range(models):
                score, where = np.unique(s[:, m], return_inverse=True)
                n, pos = np.bincount(where, minlength=len(score)).astype(np.uint32), np.bincount(where, weights=positive, minlength=len(score)).astype(np.uint32)
                ends = [0, *np.searchsorted(score, bounds[m]), len(score)]
                out += [(m, b, score[i:j].tobytes(), n[i:j].tobytes(), pos[i:j].tobytes()) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["model", "bucket", "score", "n", "pos"])

    def add(frame):
        import numpy as np
        import pandas as pd

        score, where = np.unique(np.concatenate([np.frombuffer(b) for b in frame["score"]]), return_inverse=True)
        n, pos = (np.bincount(where, weights=np.concatenate([np.frombuffer(b, np.uint32) for b in frame[c]])) for c in ("n", "pos"))
        neg, high = n - pos, score >= 0.5
        return pd.DataFrame({"model": frame["model"].iloc[:1], "bucket": frame["bucket"].iloc[:1], "pos": pos.sum(), "neg": neg.sum(), "tp": pos[high].sum(),
                             "fp": neg[high].sum(), "wins": (pos * (neg.cumsum() - neg / 2.0)).sum()})

    cells = blocks.mapInArrow(count, "model int, bucket int, score binary, n binary, pos binary")
    parts = cells.groupBy("model", "bucket").applyInPandas(add, "model int, bucket int, pos double, neg double, tp double, fp double, wins double")
    before = Window.partitionBy("model").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    walked = parts.withColumn("wins", F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    pos, neg, tp, fp = (F.sum(c) for c in ("pos", "neg", "tp", "fp"))
    out = {r["model"]: (r["auc"], r["f1"]) for r in walked.groupBy("model").agg(
        ratio(F.sum("wins"), pos * neg).alias("auc"), ratio(2.0 * tp, tp + fp + pos, 0.0).alias("f1")).collect()}  # one row per model
    return [out[m] for m in range(models)]
