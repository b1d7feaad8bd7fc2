"""Operators whose plans must hold for many levels, strata, tests and scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import compare, robustness, split, stats


def test_two_way_anova_of_a_thousand_by_a_thousand_levels(spark):
    df = spark.range(150_000).select(
        (F.col("id") % 1000).alias("a"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("b"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) / 3.0).alias("e"))
    df = df.union(df.limit(50_000)).withColumn("v", F.col("a") % 7 + F.sin(F.col("b").cast("double")) + F.col("e") + F.col("e") * (F.monotonically_increasing_id() % 2))
    found = {r.source: r for r in stats.anova_two_way(df, "v", "a", "b").collect()}

    rows = df.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("v").alias("y"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s")).toPandas()
    a, b, n, y = (rows[c].to_numpy() for c in "abny")

    def rest(key):
        return float((n * (y - (np.bincount(key, n * y) / np.bincount(key, n))[key]) ** 2).sum())

    table = np.zeros((1000, 1000))
    table[a, b] = n
    lead = table / table.sum(axis=1)[:, None]
    own = np.bincount(b, n * (y - (np.bincount(a, n * y) / np.bincount(a, n))[a]))
    effect = np.linalg.lstsq(np.diag(table.sum(axis=0)) - table.T @ lead, own, rcond=1e-12)[0]
    z = y - effect[b]
    both = float((n * (z - (np.bincount(a, n * z) / np.bincount(a, n))[a]) ** 2).sum())
    within = float(((n - 1) * rows["s"]).sum())
    want = {"a": (rest(b) - both, 999), "b": (rest(a) - both, 999), "a * b": (both, len(rows) - 1999), "Residual": (within, n.sum() - len(rows))}
    for source, (ss, dof) in want.items():
        assert found[source].df == dof and found[source].ss == pytest.approx(ss, rel=1e-8)
        if source != "Residual":
            assert found[source].f == pytest.approx(ss / dof / (within / (n.sum() - len(rows))), rel=1e-8) and 0 <= found[source].p <= 1


def test_two_way_anova_of_parts_that_do_not_meet(spark):
    rows = [("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 4.0), ("b", "u", 3.0), ("b", "w", 5.0), ("b", "w", 9.0), (None, "x", 1.0), ("a", None, 1.0), ("a", "x", None)]
    found = {r.source: r for r in stats.anova_two_way(spark.createDataFrame(rows, "g string, h string, v double"), "v", "g", "h").collect()}
    assert found["g * h"].ss == pytest.approx(0, abs=1e-9) and found["Residual"].ss == pytest.approx(8.5)
    assert stats.anova_two_way(spark.createDataFrame([], "g string, h string, v double"), "v", "g", "h").count() == 4


def test_holm_beside_plain_python(spark):
    draw = random.Random(4)
    values = [draw.choice([None, 0.0, 1.0, 0.01, draw.random() ** 6]) for _ in range(4000)]
    tests = spark.createDataFrame(list(enumerate(values)), "label long, p double").repartition(9)
    known = sorted((p, k) for k, p in enumerate(values) if p is not None)
    want, top = {k: None for k, p in enumerate(values) if p is None}, 0.0
    for i, (p, k) in enumerate(known):
        top = max(top, min(1.0, p * (len(known) - i)))
        want[k] = top
    out = stats.holm(tests, ["label"], len(known))
    assert {r.label: r.p_adjusted for r in out.collect()} == pytest.approx(want)


def test_quotas_of_a_million_strata(spark):
    sizes = spark.range(1_000_000).select(F.col("id").cast("string").alias("_stratum"), (1 + F.pmod(F.xxhash64("id"), F.lit(4))).alias("_n"))
    out = split._quotas(sizes, 0.3).toPandas()
    n = sizes.toPandas().set_index("_stratum")["_n"].loc[out["_stratum"]].to_numpy()
    total, test = int(n.sum()), int(np.ceil(round(0.3 * int(n.sum()), 9)))
    base, rest = n * test // total, n * test % total
    order = np.lexsort((out["_stratum"].to_numpy().astype(str), -rest))
    base[order[: test - base.sum()]] += 1
    assert (out["_quota"].to_numpy() == base).all() and base.sum() == test


def scored(spark, n, parts, grid=None):
    noise = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000.0
    rows = spark.range(0, n, 1, parts).withColumn("y_true", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0).cast("int"))
    score = 0.7 * noise + 0.3 * F.col("y_true")
    rows = rows.withColumn("y_score", F.round(score, grid) if grid is not None else score)
    return rows.select(F.col("id").alias("row_id"), "y_true", "y_score", (F.col("y_score") >= 0.5).cast("int").alias("y_pred"))


def test_bootstrap_of_a_million_scores_meets_the_closed_form(spark):
    rows = scored(spark, 1_000_000, 16).persist()
    found = {r.metric: r for r in compare.bootstrap_ci(rows, 100).collect()}["roc_auc"]
    exact = compare.auc_variance(rows).first()
    assert found.replicates == 100 and abs(found.mean - exact.auc) < 4 * exact.se
    assert 0.7 < found.std / exact.se < 1.35
    rows.unpersist()


@pytest.mark.parametrize("grid", [1, 2, None])
def test_replicates_do_not_depend_on_ranges(spark, grid, monkeypatch):
    rows = scored(spark, 700, 3, grid)
    cells = rows.groupBy("y_true", F.array("y_score").alias("scores"), F.array("y_pred").alias("preds")).agg(F.count("*").alias("n"))
    own = cells.withColumn("key", F.xxhash64(F.lit(3), "y_true", "scores", "preds")).toPandas()
    weights = compare._poisson(own["key"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(), 20)
    score, y = np.array([s[0] for s in own["scores"]]), own["y_true"].to_numpy()
    beats = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
    wins = [float(((w * (y == 1)) @ beats @ (w * (y == 0)))) for w in weights.T]
    monkeypatch.setattr(compare, "DRAWS", 100)  # several cuts inside a range
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = {r.rep: r.wins for r in compare._replicates(cells, 1, 20, 3).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 7)
        assert [out[k] for k in range(20)] == pytest.approx(wins)


def test_poisson_weights_have_their_moments():
    keys = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 7, 900, 20_000):
        draws = compare._poisson(keys, np.full(3000, n), 40)
        assert draws.mean() == pytest.approx(n, rel=0.02) and draws.var() == pytest.approx(n, rel=0.05)


def test_variance_of_auc_beside_all_pairs(spark):
    one, two = scored(spark, 400, 3, 2), scored(spark, 400, 2, 1).withColumn("y_score", F.round(F.col("y_score") * 0.5 + F.pmod("row_id", F.lit(7)) / 14, 2))

    def placed(frame):
        rows = frame.orderBy("row_id").toPandas()
        y, s = rows["y_true"].to_numpy(), rows["y_score"].to_numpy()
        beats = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
        return beats[y == 1][:, y == 0]

    a, b = placed(one), placed(two)

    def variance(m):
        return m.mean(axis=1).var(ddof=1) / m.shape[0] + m.mean(axis=0).var(ddof=1) / m.shape[1]

    found = compare.auc_variance(one).first()
    assert found.auc == pytest.approx(a.mean()) and found.variance == pytest.approx(variance(a))
    both = one.withColumn("model", F.lit("p")).unionByName(two.withColumn("model", F.lit("q")))
    test = compare.auc_difference_test(both, "p", "q").first()
    assert test.auc_diff == pytest.approx(a.mean() - b.mean()) and test.variance == pytest.approx(variance(a - b)) and 0 <= test.p <= 1
    single = compare.auc_variance(one.filter("y_true = 1")).first()
    assert single.auc is None and single.variance is None


def test_feature_groups_take_rules():
    from catalog.modelling import GROUPS

    assert [robustness.feature_group(n, GROUPS) for n in ("city_x", "gender_m", "age", "none")] == ["City", "Gender", "Numeric", "Other"]
