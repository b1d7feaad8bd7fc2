"""Clustering of component coordinates and the profiles of the clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from cohort.functions.columns import column
from cohort.functions.linalg import in_task
from cohort.operators.clean import zscore
from cohort.operators.models import run_parallel
from cohort.operators.neighbors import (
    BLOCK_ROWS, _alive, _extent, _held, _numbers, _places, _spread, _stack, _vectors, collapse_copies, grow_tree, knn, meet, packed, routed, weighted_counts, within)
from cohort.operators.rank import quantiles, ranked_cells
from cohort.session import written

# Fixed values of the density search.
EPS_QUANTILES = [0.50 + 0.05 * i for i in range(10)]
NOISE_PENALTY = 0.25


def scaled_points(df: DataFrame, key: str, components: Sequence[str]) -> DataFrame:
    """``(id, vec)`` of re-scaled coordinates."""
    out = zscore(df.select(column(key).cast("long").alias("id"), *[column(c).cast("double").alias(c) for c in components]), components)
    return out.select("id", F.array(*[column(c) for c in components]).alias("vec"))


def _separation(n: list, means: list, scatter: list, inertia: list) -> tuple[float, float]:
    """Calinski-Harabasz and Davies-Bouldin indices from cluster sizes, centres and spreads."""
    n, centre, scatter = np.array(n, float), np.array(means, float), np.array(scatter, float)
    grand = (n[:, None] * centre).sum(axis=0) / n.sum()
    k, within = len(n), float(np.sum(inertia))
    between = float((n * ((centre - grand) ** 2).sum(axis=1)).sum())
    ch = between / (k - 1) / (within / (n.sum() - k)) if within > 0 else float("inf")
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        worst = np.where(gap > 0, (scatter[:, None] + scatter[None]) / gap, -np.inf).max(axis=1)
    return float(ch), float(worst.mean())


def cluster_indices(labelled: DataFrame) -> dict:
    """Inertia, Calinski-Harabasz and Davies-Bouldin of ``(vec, cluster)``; one row per cluster reaches the driver."""
    width = F.size("vec")
    dims = labelled.select(width.alias("d")).first()["d"]
    centres = labelled.groupBy("cluster").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dims)]).alias("_c"))
    gap = F.aggregate(F.zip_with("vec", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    sizes = labelled.join(F.broadcast(centres), "cluster").groupBy("cluster").agg(  # one row per cluster
        F.count(F.lit(1)).alias("n"), F.first("_c").alias("c"), F.sum(gap).alias("w"), F.avg(F.sqrt(gap)).alias("s")).collect()
    ch, db = in_task(labelled.sparkSession, _separation, [r["n"] for r in sizes], [r["c"] for r in sizes], [r["s"] for r in sizes], [r["w"] for r in sizes])
    return {"inertia": float(sum(r["w"] for r in sizes)), "calinski_harabasz": ch, "davies_bouldin": db}


def _silhouette(labelled: DataFrame) -> float:
    table = labelled.select(array_to_vector("vec").alias("features"), F.col("cluster").cast("int").alias("prediction"))
    return ClusteringEvaluator().evaluate(table)


def kmeans_search(points: DataFrame, k_range: tuple[int, int] = (2, 10), seed: int = 42, workers: int = 3) -> tuple[DataFrame, DataFrame]:
    """K-Means per k with its quality: the table of candidates and the labels of the best silhouette.

    The silhouette uses squared distances, which needs one pass; ties take the smaller k.
    """
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    table = points.withColumn("features", array_to_vector("vec")).persist(StorageLevel.MEMORY_AND_DISK)
    top = min(k_range[1], table.count() - 1)

    def one(k: int):
        def run():
            model = KMeans(k=k, seed=seed, maxIter=50).fit(table)
            labels = model.transform(table).select("id", "vec", F.col("prediction").alias("cluster"))
            return k, _silhouette(labels), cluster_indices(labels), labels
        return run

    found = run_parallel([one(k) for k in range(k_range[0], top + 1)], workers)
    rows = [(k, s, q["inertia"], q["calinski_harabasz"], q["davies_bouldin"]) for k, s, q, _ in found]
    candidates = points.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double, calinski_harabasz double, davies_bouldin double")
    best = max(found, key=lambda f: (f[1], -f[0]))
    return candidates, best[3].select("id", "cluster")


# ---------------------------------------------------------------- density

def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node of every component: ``(node, root)``.

    Each round takes the smallest root among the neighbours and then jumps to the root of
    the root, so long chains shrink geometrically; lineage is cut every round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both)
    roots = written(nodes.select("node", F.col("node").alias("root")))
    while True:
        seen = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("_near"))
        hooked = roots.join(seen, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("_near", "root")).alias("root"), F.col("root").alias("_old"))
        up = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        jumped = hooked.join(up, F.col("root") == F.col("_n")).select("node", F.least("root", "_up").alias("root"), "_old")
        jumped = written(jumped)
        if jumped.filter("root <> _old").limit(1).count() == 0:
            return jumped.select("node", "root")
        roots = jumped.select("node", "root")


def _block_components(frame: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Components of one block's core points under the eps graph, named by their lowest id."""
    ids, v = frame["id"].to_numpy(), _stack(frame["vec"])
    comp = np.full(len(ids), -1, np.int64)
    for start in np.argsort(ids):
        if comp[start] >= 0:
            continue
        comp[start], front = ids[start], np.array([start])
        while len(front):
            open_ = np.flatnonzero(comp < 0)
            if not len(open_):
                break
            hit = np.zeros(len(open_), bool)
            for _, near in within(v[front], v[open_], eps):
                hit |= near.any(axis=0)
            front = open_[hit]
            comp[front] = ids[start]
    return frame.assign(comp=comp)


def dbscan(points: DataFrame, eps: float, min_samples: int, fan: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Density clusters ``(id, cluster)``, -1 for noise; exact, independent of partitioning.

    Clusters are numbered by their lowest core id, and a border row joins the first of them.
    Blocks report only which components of core points a query touches, so edges stay few
    where rows are dense.
    """
    distinct, members = collapse_copies(points.select("id", "vec"))
    tree = grow_tree(distinct, fan, block_rows)
    rows, dims = _extent(tree.points)
    counts = weighted_counts(tree, eps, block_rows)
    known = tree.points.join(counts, "id").withColumn("core", F.col("n") >= min_samples).select("id", "vec", "cell", "block", "core")
    known = written(known)
    core = known.filter("core").select("id", "vec", "cell", "block")
    blocks = core.groupBy("cell", "block").applyInPandas(lambda f: _block_components(f, eps), "id long, vec array<double>, cell long, block int, comp long")
    blocks = written(blocks)
    own = blocks.select("id", F.col("comp").alias("own"))
    queries = known.join(own, "id", "left").select("vec", "cell", "block", "core", F.coalesce("own", "id").alias("own"))

    def touch(pairs):
        for left, right in pairs:
            at, comp = _alive(left["bits"], left["n"]), _numbers(right["comp"], np.int64, right["n"])
            own, flag = _numbers(left["own"], np.int64, left["n"])[at], _numbers(left["core"], np.bool_, left["n"])[at]
            names, where = np.unique(comp, return_inverse=True)
            found = [np.empty((0, 3), np.int64)]
            for start, near in within(_vectors(left["vec"], left["n"])[at], _vectors(right["vec"], right["n"]), eps):
                q, p = _places(near)
                q = q + start
                found.append(np.unique(np.stack([flag[q].astype(np.int64), own[q], names[where[p]]], axis=1), axis=0))
            core, a, b = np.unique(np.concatenate(found), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(core.astype(bool)), pa.array(a), pa.array(b)], names=["core", "a", "b"])

    asked = routed(tree, _spread(packed(queries), rows, dims), repr(float(eps)))
    cores = _held(_spread(packed(blocks.select("vec", "cell", "block", "comp")), rows, dims), rows, dims)
    links = written(meet(asked, cores, touch, "core boolean, a long, b long").distinct())
    roots = connected_components(links.filter("core"), blocks.select(F.col("comp").alias("node")).distinct())
    numbered = ranked_cells(roots.select("root").distinct(), ["root"]).select(F.col("value").cast("long").alias("root"), (F.col("cum_n") - 1).cast("int").alias("cluster"))
    clusters = roots.join(numbered, "root").select("node", "cluster")
    inner = own.join(clusters, F.col("own") == F.col("node")).select("id", "cluster")
    border = links.filter(~F.col("core")).join(clusters, F.col("b") == F.col("node")).groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    labels = inner.unionByName(border).withColumnRenamed("id", "rep")
    return members.join(labels, "rep", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def default_min_samples(dims: int, n: int) -> int:
    return min(max(5, 2 * dims), max(2, n - 1))


def dbscan_search(points: DataFrame, min_samples: int | None = None, eps_quantiles: Sequence[float] = EPS_QUANTILES) -> tuple[DataFrame, DataFrame]:
    """Candidates over the k-distance quantiles, and the labels of the best score.

    Score = silhouette of the clustered rows less a quarter of the noise share; a candidate
    needs two clusters or more and fewer clusters than clustered rows.
    """
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    n, dims = points.count(), len(points.first()["vec"])
    min_samples = min_samples or default_min_samples(dims, n)
    reach = knn(points, min_samples - 1).groupBy("id").agg(F.max("distance").alias("reach"))  # the row itself counts as one
    row = quantiles(reach, ["reach"], eps_quantiles).first()
    rows, best, best_labels = [], None, None
    for i, q in enumerate(eps_quantiles):
        eps = row[2 + i]
        if not eps > 0:
            continue
        labels = dbscan(points, eps, min_samples).persist(StorageLevel.MEMORY_AND_DISK)
        s = labels.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.count(F.when(F.col("cluster") >= 0, 1)).alias("kept")).first()
        noise, silhouette, score = 1.0 - s["kept"] / n, None, None
        if 2 <= s["k"] < s["kept"]:
            silhouette = _silhouette(labels.filter("cluster >= 0").join(points, "id"))
            score = silhouette - NOISE_PENALTY * noise
        rows.append((float(q), float(eps), int(min_samples), int(s["k"]), float(noise), silhouette, score))
        if score is not None and (best is None or score > best):
            best, best_labels = score, labels
    candidates = points.sparkSession.createDataFrame(
        rows, "eps_quantile double, eps double, min_samples int, n_clusters int, noise_fraction double, silhouette double, score double")
    if best_labels is None:
        best_labels = points.select("id", F.lit(-1).alias("cluster"))
    return candidates, best_labels


def cluster_profiles(coords: DataFrame, components: Sequence[str], target: str | None = None, cluster: str = "cluster") -> DataFrame:
    """Size, share, component means, the two dominant components and the target rate per cluster."""
    aggs = [F.count(F.lit(1)).alias("n_samples"), *[F.avg(column(c)).alias(f"mean_{c}") for c in components]]
    if target:
        aggs.append(F.avg(column(target).cast("double")).alias("target_rate"))
    groups = coords.groupBy(column(cluster).alias("cluster")).agg(*aggs)
    total = groups.agg(F.sum("n_samples").alias("_total"), F.lit(1).alias("_k"))
    items = F.array_sort(F.array(*[F.struct((-F.abs(f"mean_{c}")).alias("k"), F.lit(c).alias("c"), F.col(f"mean_{c}").alias("m")) for c in components]))
    text = F.transform(F.slice(items, 1, 2), lambda i: F.concat(i["c"], F.when(i["m"] >= 0, " high (").otherwise(" low ("), F.format_number(i["m"], 2), F.lit(")")))
    joined = groups.withColumn("_k", F.lit(1)).join(total, "_k")  # a one-row side
    return joined.select(
        "cluster", "n_samples", (F.col("n_samples") / F.col("_total") * 100.0).alias("share_pct"), *[f"mean_{c}" for c in components],
        *(["target_rate"] if target else []),
        F.when(F.col("cluster") == -1, "noise").otherwise(F.array_join(text, "; ")).alias("interpretation"))
