"""Cases in which rounding, null groups, NaN or formats used to change an answer."""

import pytest
from pyspark.sql import functions as F

from cohort.operators import charts, clean, evaluate, fairness, models, profile, robustness, split, thresholds
from cohort.plans import deploy
from cohort.sources.tables import write_json
from cohort.streaming import trend


def test_tiny_scores_keep_their_order(spark):
    rows = [(k, int(k >= 18), (k + 1) * 1e-9, 0, "ab"[k % 2]) for k in range(40)]
    scored = spark.createDataFrame(rows, "row_id int, y_true int, y_score double, y_pred int, g string")
    assert evaluate.binary_metrics(scored).first()["roc_auc"] == 1.0
    assert {r.roc_auc for r in evaluate.binary_metrics(scored, ["g"]).collect()} == {1.0}
    assert {r.roc_auc for r in evaluate.subgroup_metrics(scored, {"g": "g"}, 1).collect()} == {1.0}


def test_threshold_compares_raw_scores(spark):
    scored = spark.createDataFrame([(1, 1, 0.3999997), (2, 0, 0.4)], "row_id int, y_true int, y_score double")
    assert [r.y_pred for r in evaluate.with_predictions(scored, 0.4).orderBy("row_id").collect()] == [0, 1]
    assert thresholds.threshold_sweep(scored, [0.4]).first()["n_flagged"] == 1


def test_calibration_edges(spark):
    scored = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.100000001), (1, 1.0)], "y_true int, y_score double")
    by = {closed: sorted((r.bin, r.n) for r in evaluate.calibration_bins(scored, closed=closed).collect()) for closed in ("right", "left", "right-open-zero")}
    assert by == {"right": [(1, 2), (2, 1), (10, 1)], "left": [(1, 1), (2, 2), (10, 1)], "right-open-zero": [(1, 1), (2, 1), (10, 1)]}


def test_theil_of_scores_below_a_millionth(spark):
    from math import log

    values = [1e-8, 3e-8, 0.0, 4e-8]
    scored = spark.createDataFrame([(v, "x") for v in values], "y_score double, g string")
    mean = sum(values) / 4
    want = sum((v / mean if v else 1e-10) * log(v / mean if v else 1e-10) for v in values) / 4
    assert abs(fairness.theil_index(scored, {"g": "g"}, 1).filter("family = 'g'").first()["theil"] - want) < 1e-9


def test_rows_without_a_class_stay(spark):
    rows = [(k, None if k % 5 == 0 else k % 2) for k in range(100)]
    table = spark.createDataFrame(rows, "id int, y int")
    folds = split.stratified_folds(table, "id", "y", 4)
    assert folds.count() == 100 and folds.filter("fold is null").count() == 0
    kept = split.undersample(table.filter("y is null or y = 0 or id < 50"), "id", "y")
    assert {r.y: r["count"] for r in kept.groupBy("y").count().collect()} == {None: 20, 0: 20, 1: 20}


def test_first_and_last_follow_an_order(spark):
    table = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("a", 2, 3)], "g string, v int, t int")
    row = profile.aggregate_by_group(table, "g", metrics={"first": ("v", "t"), "last": ("v", "t")}).first()
    assert (row.v_first, row.v_last) == (3, 2)
    with pytest.raises(ValueError):
        profile.aggregate_by_group(table, "g", metrics={"first": "v"})


def test_nan_and_infinity_belong_to_no_bin(spark):
    table = spark.createDataFrame([(float(v),) for v in range(10)] + [(float("nan"),), (float("inf"),), (None,)], "v double")
    bins = charts.histogram(table, "v", 3).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in bins] == [(0, 3), (1, 3), (2, 4)]


def test_feature_groups_and_owners(spark, survey):
    assert [robustness.feature_group(n) for n in ("FINANCIAL need", "Agent_x", "Age", "City_X")] == ["Financial", "Other", "Numeric", "City"]
    from cohort.roles import ColumnRoles

    table = spark.createDataFrame([(k, "b_x" if k % 2 else "c", "u" if k % 3 else "v", float(k), k % 2) for k in range(30)], "id int, a string, a_b string, `x - -y` double, y int")
    roles = ColumnRoles(row_id="id", target="y", numeric=["x - -y"], ordinal=[], nominal=["a", "a_b"])
    design = models.fit_design(table, roles)
    assert dict(zip(design.feature_names, design.owners))["a_b_x"] == "a" and len(design.owners) == len(design.feature_names)
    assert design.assembled(table).count() == 30


def test_json_lines_and_arrays_are_both_read(spark, tmp_path):
    table = spark.range(100).withColumn("name", F.concat(F.lit("n"), "id"))
    write_json(table, f"{tmp_path}/rows.json")
    assert deploy.read_records(spark, f"{tmp_path}/rows.json").count() == 100
    (tmp_path / "array.json").write_text('[\n{"id": 1},\n{"id": 2}\n]')
    assert deploy.read_records(spark, f"{tmp_path}/array.json").count() == 2


def test_an_unfinished_stream_raises(spark, tmp_path):
    spark.range(2000).withColumn("v", F.lit(1.0)).repartition(40).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(TimeoutError):
        trend.run_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/state", timeout=1)
    assert not spark.streams.active


def test_sparse_one_hot_has_no_limit_on_levels(spark):
    table = spark.range(30000).select("id", F.concat(F.lit("v"), F.col("id") % 20000).alias("c"), (F.col("id") % 2).cast("string").alias("d"))
    ones = clean.one_hot_sparse(table, "id", ["c", "d"])
    assert ones.count() == 60000 and ones.agg(F.max("position")).first()[0] == 20001
    seen = clean.one_hot_sparse(table.limit(5), "id", ["d"], clean.level_index(table.filter("d = '0'"), ["d"]))
    assert {r.level for r in seen.collect()} == {"0"}


def test_anova_over_very_many_groups(spark):
    from cohort.operators import stats

    table = spark.range(300_000).select((F.col("id") % 100_000).cast("string").alias("g"), ((F.col("id") * 7919) % 1000 / 10.0).alias("v"))
    row = stats.anova_one_way(table, "v", "g").first()
    groups = table.toPandas().groupby("g")["v"]
    grand = table.agg(F.avg("v")).first()[0]
    between = float(((groups.mean() - grand) ** 2 * groups.size()).sum())
    assert row.k == 100_000 and abs(row.ss_between - between) < 1e-6 * between
    plan = stats.anova_one_way(table, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_named_groups_of_a_t_test(spark):
    from cohort.operators import stats

    table = spark.createDataFrame([("abc"[k % 3], float(k * k % 17)) for k in range(60)], "g string, v double")
    two = stats.t_test(table, "v", "g", labels=["c", "a"]).first()
    every = stats.t_test(table, "v", "g").filter("label_a = 'a' and label_b = 'c'").first()
    assert (two.label_a, two.label_b) == ("a", "c") and abs(two.t - every.t) < 1e-12
    with pytest.raises(ValueError):
        stats.t_test(table, "v", "g", labels=["a"])


def test_rank_correlations_at_once_and_pair_by_pair(spark):
    from cohort.operators import stats

    table = spark.createDataFrame([(float(k * 37 % 101), float(k * k % 13), float(k % 4)) for k in range(300)], "a double, b double, c double")
    at_once = {(r.x, r.y): (r.n, r.r) for r in stats.correlation(table, ["a", "b", "c"], "spearman").collect()}
    for (x, y), (n, r) in at_once.items():
        one = stats.spearman(table, x, y).first()
        assert n == one.n and abs(r - one.r) < 1e-12
    gaps = table.unionByName(spark.createDataFrame([(None, 1.0, 2.0)], table.schema))
    assert {(r.x, r.y): r.n for r in stats.correlation(gaps, ["a", "b", "c"], "spearman").collect()} == {("a", "b"): 300, ("a", "c"): 300, ("b", "c"): 301}


def test_box_stats_with_and_without_a_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([("xy"[k % 2], float(k * k % 50)) for k in range(90)] + [("x", 1e6), (None, 3.0), ("y", None), ("y", float("nan"))], "g string, v double")
    sent = sorted(map(tuple, charts.box_stats(table, ["v"], ["g"]).collect()), key=str)
    monkeypatch.setattr(charts, "FEW_GROUPS", 0)
    assert sorted(map(tuple, charts.box_stats(table, ["v"], ["g"]).collect()), key=str) == sent
