"""Neighbours, resampling, mixed-data factors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from cohort import fixtures
from cohort.functions.columns import rounded
from cohort.operators import cluster, famd, neighbors, resample


def _points(spark, sf, dims=None):
    e = fixtures.table(spark, sf, "embeddings")
    vec = "embedding" if dims is None else F.slice("embedding", 1, dims)
    return neighbors.as_points(e, "vec_id", vec)


def _labelled(spark, sf):
    """Embeddings of label 0 against the rest: an unbalanced binary table."""
    e = fixtures.table(spark, sf, "embeddings")
    y = (F.col("label") == 0).cast("int").alias("y")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), y)


_D = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]-p[2])*(p[1]-p[2]))))"
_E = lambda d: f"e AS (SELECT vec_id AS id, embedding[1:{d}]::DOUBLE[] AS v, label FROM embeddings)"


@query("nearest_neighbors", f"""WITH {_E(64)}, d AS (SELECT a.id, b.id AS neighbor, {_D} AS distance FROM e a JOIN e b ON a.id <> b.id)
   SELECT id, neighbor, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor)::INTEGER AS position FROM d QUALIFY position <= 5""", "distance")
def _(spark, sf):
    return rounded(neighbors.knn(_points(spark, sf), 5))


@query("nearest_neighbors_with_copies", f"""WITH {_E(1)}, r AS (SELECT id, [round(v[1], 2)] AS v FROM e), d AS (SELECT a.id, b.id AS neighbor, {_D} AS distance FROM r a JOIN r b ON a.id <> b.id)
   SELECT id, neighbor, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor)::INTEGER AS position FROM d QUALIFY position <= 3""", "distance")
def _(spark, sf):
    e = fixtures.table(spark, sf, "embeddings")
    vec = F.array(F.round(F.col("embedding")[0].cast("double"), 2))
    return rounded(neighbors.knn(neighbors.as_points(e, "vec_id", vec), 3))


@query("neighbor_counts", f"WITH {_E(64)} SELECT a.id, count(*) AS n FROM e a JOIN e b ON {_D} <= 1.2 GROUP BY a.id")
def _(spark, sf):
    return neighbors.neighbor_counts(_points(spark, sf), 1.2)


@query("smote_counts", """WITH n AS (SELECT (label=0)::INTEGER AS y, count(*) AS n FROM embeddings GROUP BY 1) SELECT y, false AS is_synthetic, n FROM n
   UNION ALL SELECT y, true, (SELECT max(n) FROM n) - n FROM n WHERE n < (SELECT max(n) FROM n)""")
def _(spark, sf):
    return resample.smote(_labelled(spark, sf)).groupBy("y", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("smote_rows")
def _(spark, sf):
    return resample.smote(_labelled(spark, sf)).filter("is_synthetic")


@query("tomek_links", f"""WITH {_E(64)}, n AS (SELECT a.id, b.id AS nb, a.label=0 AS y, b.label=0 AS yb FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) = 1)
   SELECT n.id FROM n JOIN n m ON n.nb = m.id AND m.nb = n.id WHERE n.y <> n.yb""")
def _(spark, sf):
    return resample.tomek_links(_labelled(spark, sf))


@query("edited_neighbors", f"""WITH {_E(64)}, n AS (SELECT a.id, (a.label=0) <> (b.label=0) AS bad FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) <= 3)
   SELECT id, (any_value(label)=0)::INTEGER AS y FROM e JOIN n USING (id) GROUP BY id HAVING NOT bool_or(bad)""")
def _(spark, sf):
    return resample.edited_neighbors(_labelled(spark, sf)).select("id", "y")


@query("resampling_methods")
def _(spark, sf):
    out = resample.compare_methods(_labelled(spark, sf))
    return rounded(out.withColumn("classes", F.to_json("classes")))


@query("balanced_train", """WITH n AS (SELECT (label=0)::INTEGER AS y, count(*) AS n, (SELECT count(*) FROM embeddings) AS total, ceil(round(0.2*(SELECT count(*) FROM embeddings),9))::BIGINT AS test FROM embeddings GROUP BY 1),
   q AS (SELECT y, n, (n*test)//total + (row_number() OVER (ORDER BY (n*test)%total DESC, y) <= any_value(test) OVER () - sum((n*test)//total) OVER ())::INT AS q FROM n)
   SELECT 'train' AS part, y, (max(n-q) OVER ())::BIGINT AS n FROM q UNION ALL SELECT 'test', y, q::BIGINT FROM q""")
def _(spark, sf):
    train, test = resample.balanced_train(_labelled(spark, sf))
    parts = train.select("y", F.lit("train").alias("part")).unionByName(test.select("y", F.lit("test").alias("part")))
    return parts.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n"))


def _famd(spark, sf):
    df = fixtures.survey(spark, sf).persist()
    return df, famd.fit_famd(df, ["age", "balance", "price", "pressure"], ["gender", "priority", "family_history", "sensitive"], 5)


@query("famd_eigenvalues")
def _(spark, sf):
    return rounded(_famd(spark, sf)[1].explained(spark))


@query("famd_coordinates")
def _(spark, sf):
    df, model = _famd(spark, sf)
    return rounded(model.coordinates(df).select("id", *model.names, "target"))


@query("famd_top_variables")
def _(spark, sf):
    df, model = _famd(spark, sf)
    coords = model.coordinates(df).persist()
    shares = model.eigenvalues[:5] / model.eigenvalues[:5].sum()
    link = famd.component_association(coords, model.names, ["age", "balance", "price"], ["gender", "priority", "family_history", "sensitive"], shares)
    return rounded(famd.top_variables(link))


def _coords(spark, sf):
    e = fixtures.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", (F.col("label") % 2).alias("target"), *[F.col("embedding")[i].cast("double").alias(f"F{i + 1}") for i in range(4)])


_C = "c AS (SELECT vec_id, label, label % 2 AS target, embedding[1]::DOUBLE AS F1, embedding[2]::DOUBLE AS F2, embedding[3]::DOUBLE AS F3, embedding[4]::DOUBLE AS F4 FROM embeddings)"
_ASSOC = " UNION ALL ".join(
    f"""SELECT 'label' AS variable, 'categorical' AS type, '{c}' AS component, sqrt(e) AS correlation, e AS cos2 FROM (SELECT sum(n*pow(m-(SELECT avg({c}) FROM c),2))/(SELECT sum(pow({c}-(SELECT avg({c}) FROM c),2)) FROM c) AS e FROM (SELECT count(*) AS n, avg({c}) AS m FROM c GROUP BY label))
    UNION ALL SELECT 'target', 'numeric', '{c}', corr(target, {c}), pow(corr(target, {c}), 2) FROM c""" for c in ("F1", "F2"))


@query("component_association", f"WITH {_C} {_ASSOC}", "correlation cos2")
def _(spark, sf):
    return rounded(famd.component_association(_coords(spark, sf), ["F1", "F2"], ["target"], ["label"]))


@query("cluster_profiles", f"""WITH {_C} SELECT label AS cluster, count(*) AS n_samples, 100.0*count(*)/(SELECT count(*) FROM c) AS share_pct, avg(F1) AS mean_F1, avg(F2) AS mean_F2, avg(target) AS target_rate FROM c GROUP BY label""",
       "share_pct mean_F1 mean_F2 target_rate")
def _(spark, sf):
    out = cluster.cluster_profiles(_coords(spark, sf), ["F1", "F2"], "target", "label")
    return rounded(out.drop("interpretation"))


@query("kmeans_search")
def _(spark, sf):
    points = cluster.scaled_points(_coords(spark, sf), "vec_id", ["F1", "F2", "F3", "F4"])
    return rounded(cluster.kmeans_search(points)[0], 4)


@query("cluster_indices")
def _(spark, sf):
    points = cluster.scaled_points(_coords(spark, sf), "vec_id", ["F1", "F2", "F3", "F4"])
    _, labels = cluster.kmeans_search(points, (3, 3))
    q = cluster.cluster_indices(points.join(labels, "id"))
    return rounded(spark.createDataFrame([tuple(q.values())], "inertia double, calinski_harabasz double, davies_bouldin double"), 4)


_EDGES = f"""{_E(64)}, core AS (SELECT a.id, any_value(a.v) AS v FROM e a JOIN e b ON {_D} <= 1.2 GROUP BY a.id HAVING count(*) >= 5)"""


@query("dbscan", f"""WITH RECURSIVE {_EDGES}, link AS (SELECT a.id AS x, b.id AS y FROM core a JOIN core b ON {_D} <= 1.2),
   walk AS (SELECT id AS x, id AS root FROM core UNION SELECT link.y, walk.root FROM walk JOIN link ON walk.x = link.x WHERE walk.root < link.y),
   roots AS (SELECT x, min(root) AS root FROM walk GROUP BY x), num AS (SELECT root, (row_number() OVER (ORDER BY root) - 1)::INTEGER AS cluster FROM (SELECT DISTINCT root FROM roots)),
   border AS (SELECT a.id, min(num.cluster) AS cluster FROM e a JOIN core b ON {_D} <= 1.2 JOIN roots ON roots.x = b.id JOIN num USING (root) WHERE a.id NOT IN (SELECT id FROM core) GROUP BY a.id)
   SELECT e.id, coalesce(num.cluster, border.cluster, -1)::INTEGER AS cluster FROM e LEFT JOIN roots ON roots.x = e.id LEFT JOIN num USING (root) LEFT JOIN border ON border.id = e.id""")
def _(spark, sf):
    return cluster.dbscan(_points(spark, sf), 1.2, 5)


@query("dbscan_search")
def _(spark, sf):
    points = cluster.scaled_points(_coords(spark, sf), "vec_id", ["F1", "F2"])
    return rounded(cluster.dbscan_search(points, eps_quantiles=[0.5, 0.7, 0.9])[0], 4)
