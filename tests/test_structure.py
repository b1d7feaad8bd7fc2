"""Neighbours, resampling and clustering against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import cluster, famd, neighbors, resample


def points(spark, array):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(array)], "id long, vec array<double>")


def brute_knn(array, k):
    d = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    out = {}
    for i in range(len(array)):
        order = sorted((d[i, j], j) for j in range(len(array)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("block_rows, pivots", [(16, 5), (4096, None)])
def test_knn_with_a_third_of_copies(spark, block_rows, pivots):
    rng = np.random.default_rng(0)
    array = np.vstack([np.zeros((60, 2)), rng.normal(size=(120, 2))])
    got: dict = {}
    for r in neighbors.knn(points(spark, array), 4, pivots, block_rows).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute_knn(array, 4)


def test_neighbor_counts(spark):
    rng = np.random.default_rng(4)
    array = np.vstack([np.ones((40, 3)), rng.normal(size=(80, 3))])
    d = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    got = {r["id"]: r["n"] for r in neighbors.neighbor_counts(points(spark, array), 0.8, 6, 16).collect()}
    assert got == {i: int(c) for i, c in enumerate((d <= 0.8).sum(axis=1))}


def test_tree_leaves_out_leaves_of_clustered_points(spark):
    rng = np.random.default_rng(11)
    centres = rng.uniform(-10, 10, (40, 8))
    array = np.vstack([c + rng.normal(0, 0.5, (100, 8)) for c in centres])
    tree = neighbors.grow_tree(points(spark, array), 8, 64)
    assert len(tree.levels) > 1 and tree.points.count() == 4000
    leaves = {r["cell"]: r["size"] for r in tree.leaves.collect()}
    assert {r["cell"]: r["count"] for r in tree.points.groupBy("cell").count().collect()} == leaves
    routed = neighbors.route(tree, neighbors.bounded(tree, 5), "bound", 5, 64)
    assert routed.count() < 0.6 * 4000 * len(leaves)
    got: dict = {}
    for r in neighbors.knn(points(spark, array), 5, 8, 64).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute_knn(array, 5)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-6, 1e3), (1e6, -1e3)])
def test_ties_on_a_grid_far_from_the_origin(spark, scale, shift):
    grid = np.stack(np.meshgrid(np.arange(12), np.arange(12)), axis=2).reshape(-1, 2) * scale + shift
    got: dict = {}
    for r in neighbors.knn(points(spark, grid), 4, 4, 16).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute_knn(grid, 4)
    d = np.sqrt(((grid[:, None] - grid[None]) ** 2).sum(axis=2))
    counts = {r["id"]: r["n"] for r in neighbors.neighbor_counts(points(spark, grid), float(d[0, 1]), 4, 16).collect()}
    assert counts == {i: int(c) for i, c in enumerate((d <= d[0, 1]).sum(axis=1))}


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_few_points(spark, rows):
    table = points(spark, np.arange(rows * 2, dtype=float).reshape(rows, 2))
    assert neighbors.knn(table, 5).count() == rows * max(0, rows - 1)
    assert neighbors.neighbor_counts(table, 100.0).filter(F.col("n") != rows).count() == 0


def brute_dbscan(array, eps, least):
    d = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2)) <= eps
    core, labels, k = d.sum(axis=1) >= least, np.full(len(array), -1), 0
    for i in range(len(array)):
        if core[i] and labels[i] < 0:
            stack, labels[i] = [i], k
            while stack:
                p = stack.pop()
                for q in np.flatnonzero(d[p]):
                    if labels[q] < 0:
                        labels[q] = k
                        if core[q]:
                            stack.append(q)
            k += 1
    return {i: int(c) for i, c in enumerate(labels)}


@pytest.mark.parametrize("parts, block_rows", [(1, 4096), (5, 12)])
def test_dbscan(spark, parts, block_rows):
    rng = np.random.default_rng(7)
    chain = np.stack([np.linspace(0, 4, 60), np.zeros(60)], axis=1)
    array = np.vstack([np.full((50, 2), 9.0), chain, rng.normal([0, 5], 0.3, (60, 2)), rng.uniform(-10, 10, (20, 2))])
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(points(spark, array).repartition(parts), 0.3, 5, 6, block_rows).collect()}
    assert got == brute_dbscan(array, 0.3, 5)


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = cluster.connected_components(edges, spark.range(201).select(F.col("id").alias("node")))
    assert [r["root"] for r in roots.select("root").distinct().collect()] == [0]


def test_smote_lies_on_segments_and_balances(spark):
    rng = np.random.default_rng(1)
    array = np.vstack([rng.normal(size=(40, 2)), rng.normal(4, 1, size=(11, 2))])
    table = points(spark, array).withColumn("y", (F.col("id") >= 40).cast("int"))
    made = resample.smote(table, k=3).collect()
    new = [r for r in made if r["is_synthetic"]]
    assert len(new) == 29 and len({r["id"] for r in made}) == len(made)
    near = brute_knn(array[40:], 3)
    for r in new:
        v = np.array(r["vec"])
        gaps = [
            np.linalg.norm(v - a) + np.linalg.norm(v - array[40 + j]) - np.linalg.norm(a - array[40 + j])
            for i, a in enumerate(array[40:]) for j in near[i]
        ]
        assert min(gaps) < 1e-9


def test_component_profiles(spark):
    f = [(-2.0, 0.2, 0), (-1.8, 0.1, 0), (-1.5, 0.3, 0), (1.4, -0.1, 1), (1.7, -0.3, 1), (2.0, -0.2, 1), (0.1, 1.8, 1), (-0.1, 1.6, 0)]
    df = spark.createDataFrame([(i, a, b, t, 0 if i < 3 else 1 if i < 6 else -1) for i, (a, b, t) in enumerate(f)], "id long, F1 double, F2 double, target int, cluster int")
    rows = {r["cluster"]: r for r in cluster.cluster_profiles(df, ["F1", "F2"], "target").collect()}
    assert rows[1]["interpretation"].startswith("F1 high (1.70)") and rows[0]["target_rate"] == 0 and rows[-1]["interpretation"] == "noise"


def test_kmeans_finds_two_groups(spark):
    rng = np.random.default_rng(3)
    array = np.vstack([rng.normal(0, 0.2, (30, 2)), rng.normal(5, 0.2, (30, 2))])
    candidates, labels = cluster.kmeans_search(points(spark, array), (2, 4))
    best = candidates.orderBy(F.desc("silhouette")).first()
    assert best["k"] == 2 and labels.groupBy("cluster").count().filter("count = 30").count() == 2
    assert all(isinstance(best[c], float) for c in ("calinski_harabasz", "davies_bouldin", "inertia"))


def test_famd_matches_numpy(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=80), rng.normal(size=80)
    g = np.array(["u", "v", "w"])[rng.integers(0, 3, 80)]
    df = spark.createDataFrame([(i, float(x), float(y), str(z)) for i, (x, y, z) in enumerate(zip(a, b, g))], "id long, a double, b double, g string")
    model = famd.fit_famd(df, ["a", "b"], ["g"], 3)
    hot = (g[:, None] == np.array(["u", "v", "w"])[None]).astype(float)
    x = np.hstack([((np.stack([a, b], 1) - [a.mean(), b.mean()]) / [a.std(), b.std()]), (hot - hot.mean(0)) / np.sqrt(hot.mean(0))])
    values = np.linalg.eigvalsh(x.T @ x / 80)[::-1]
    assert np.allclose(model.eigenvalues[:4], values[:4])
    coords = model.coordinates(df).agg(*[F.var_pop(c).alias(c) for c in model.names]).first()
    assert [coords[c] for c in model.names] == pytest.approx(list(values[:3]))
