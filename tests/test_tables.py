"""Cleaning, ranks, splits, sources and logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import charts, clean, logs, profile, rank, split, stats
from cohort.roles import ColumnRoles, SENSITIVE
from cohort.sources import tables as T


def test_name_collision_is_an_error(spark):
    with pytest.raises(ValueError, match="collide"):
        clean.normalize_names(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "id int, v double, w string")
    filled = clean.learn_fills(df, numeric=["v"], text=["w"]).transform(df)
    assert filled.columns == ["id", "w"] and [r["w"] for r in filled.collect()] == ["x", "x"]


def test_mode_tie_takes_the_lowest(spark):
    df = spark.createDataFrame([("b", 10.0), ("a", 9.0), ("b", 9.0), ("a", 10.0)], "w string, n double")
    top = {r["column"]: r["value"] for r in rank.top_values(df, ["w", "n"]).collect()}
    assert top == {"w": "a", "n": "9.0"}


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.1,)] * 7, "v double")
    assert [r["v"] for r in clean.zscore(df, ["v"]).distinct().collect()] == [pytest.approx(0.0)]


def test_odd_column_names_and_profiles(survey):
    roles = ColumnRoles()
    safe = clean.select_profile(survey, roles, "safe")
    full = clean.select_profile(survey, roles, "full")
    assert SENSITIVE not in safe.columns and SENSITIVE in full.columns
    assert profile.missing_table(survey).first()["column"] == "Financial Stress"
    standard, report = clean.standardize(survey)
    assert {r["gioi_tinh"] for r in standard.select("gioi_tinh").distinct().collect()} == {"Nam", "Nu"}
    assert {r["role"] for r in report.collect()} == {"id", "target", "numeric", "ordinal", "nominal"}


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_quantiles_with_a_hot_value(spark, partitions):
    """A third of the rows share one value; ranks still come out exactly."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = np.random.default_rng(1)
        values = np.concatenate([np.full(1000, 0.25), rng.normal(size=2000)])
        df = spark.createDataFrame([(float(v), "a" if i % 3 else None) for i, v in enumerate(values)], "v double, g string")
        row = rank.quantiles(df, ["v"], [0.01, 0.5, 0.9]).first()
        assert [row["q1"], row["q50"], row["q90"]] == pytest.approx(list(np.quantile(values, [0.01, 0.5, 0.9])))
        groups = {r["g"]: r["n"] for r in rank.quantiles(df, ["v"], [0.5], ["g"]).collect()}
        assert groups == {"a": 2000, None: 1000}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_levels_with_quotes_and_many_values(spark):
    words = [f"it's \\ {i:04d}" for i in range(1500)] + ["a'b", "\\", "é"]
    df = spark.createDataFrame([(w, "k") for w in words for _ in range(2)], "w string, c string")
    got = {r["value"]: r["index"] for r in clean.level_index(df, ["w", "c"]).filter("column = 'w'").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_ranks_average_ties(spark):
    out = {r["v"]: r["rank"] for r in rank.rank_average(spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0]], "v double"), "v").collect()}
    assert out == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_one_row_group_has_no_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "g string, v double")
    row = stats.anova_one_way(df, "v", "g").first()
    assert row["ss_within"] == pytest.approx(2.0) and row["df_within"] == 1.0


def test_tests_agree_with_textbook(spark):
    a, b = [5.1, 4.9, 6.2, 5.8, 6.0], [6.8, 7.1, 6.5, 7.7, 6.9]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    t, f = stats.t_test(df, "v", "g").first(), stats.anova_one_way(df, "v", "g").first()
    assert t["t"] ** 2 == pytest.approx(f["f"]) and t["p"] == pytest.approx(f["p"], abs=1e-9)
    assert t["ci95_low"] < t["difference"] < t["ci95_high"] < 0
    tukey = stats.tukey_hsd(df, "v", "g").first()
    assert tukey["p"] == pytest.approx(t["p"], abs=1e-4)  # two groups: the same test
    two = stats.anova_two_way(df.withColumn("h", F.when(F.col("v") > 6.1, "x").otherwise("y")), "v", "g", "h").collect()
    assert [r["source"] for r in two] == ["g", "h", "g * h", "Residual"]


def test_kendall_counts_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 150), rng.integers(0, 9, 150)
    row = stats.kendall(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double"), "x", "y").first()
    s = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
    assert row["concordant"] == (s > 0).sum() / 2 and row["discordant"] == (s < 0).sum() / 2


def test_regression_recovers_a_plane(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(2 + 3 * a - b + e)) for a, b, e in rng.normal(size=(400, 3)) * [1, 1, 0.1]]
    got = {r["term"]: r for r in stats.linear_regression(spark.createDataFrame(rows, "a double, b double, y double"), "y", ["a", "b"]).collect()}
    assert got["a"]["coef"] == pytest.approx(3, abs=0.05) and got["intercept"]["coef"] == pytest.approx(2, abs=0.05) and got["a"]["r2"] > 0.99


def test_split_quotas_and_folds(spark, survey):
    out = split.stratified_split(survey, "id", "Depression", None, 0.25)
    assert split.detect_strata(survey) == ["Gender", "Family History of Mental Illness"]
    assert out.filter("split = 'test'").count() == 18
    folds = split.stratified_folds(survey, "id", "Depression", 5).groupBy("Depression", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["Depression"] == label]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5
    again = split.stratified_split(survey.repartition(5), "id", "Depression", None, 0.25)
    assert sorted(map(tuple, again.select("id", "split").collect())) == sorted(map(tuple, out.select("id", "split").collect()))


def test_singleton_stratum_falls_back(spark):
    df = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(99, 1, "lonely")], "id long, y int, g string")
    keys = {r["id"]: r["_stratum"] for r in split.stratum_key(df, "y", ["g"]).collect()}
    assert keys[99] == "1" and keys[1] == "1_x"


def test_split_of_one_huge_class(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("y"))
    assert split.target_split(df, "id", "y", 0.2).filter("split = 'test'").count() == 1000


def test_cache_misses_then_hits(spark, survey):
    source, cache = T.scratch_path(spark, "survey.csv"), T.scratch_path(spark, "cache")
    T.write_csv(survey, source)
    first, second = T.load_cached(spark, source, cache), T.load_cached(spark, source, cache)
    assert (first.from_cache, second.from_cache) == (False, True) and second.frame.count() == 72


def test_missing_columns_are_all_named(survey):
    with pytest.raises(ValueError, match="Age, CGPA"):
        T.check_columns(survey.drop("Age", "CGPA"), ["Age", "CGPA", "City"])


def test_json_values():
    assert T.json_value({"a": float("nan"), "b": (1, np.int64(2))}) == {"a": None, "b": [1, 2]}


def log(spark, body, name="20260424_091911_eda_A_quick_default.log"):
    return spark.createDataFrame([("logs/" + name, body)], "path string, content string")


def test_log_header_and_body(spark):
    text = "workflow: eda\nfamily: legacy\ndataset: table.csv\n\n=== console result ===\nEDA line 1\nEDA line 2\n"
    row = logs.parse_logs(log(spark, text)).first()
    assert (row["workflow"], row["dataset"], row["body"], row["preset"]) == ("eda", "table.csv", "EDA line 1\nEDA line 2", None)
    assert logs.parse_logs(log(spark, "just text")).first()["workflow"] == "eda"


def test_eda_log_facts(spark):
    text = "\n".join([
        "Shape: 27,901 rows × 18 cols", "Có trầm cảm (1): 16,336 (58.55%)", "⚠️  [Quality Gate] Tỷ lệ 'Suicidal thoughts = Yes' = 63.3% — cảnh báo leakage.",
        "[Quality Gate] 1 cột có tổng 3 giá trị thiếu", "[Quality Gate] 2 cột có category hiếm (<1%)", "6 visualizations saved to: out",
        "Exploratory Data Analysis completed in 1.10s", "Data Review completed in 0.03s"])
    parsed = logs.parse_logs(log(spark, text))
    row = logs.eda_facts(parsed).first()
    assert (row["rows"], row["cols"], row["charts"], row["missing_columns"], row["rare_columns"]) == (27901, 18, 6, 1, 2)
    assert (row["positive_pct"], row["eda_seconds"], row["readiness"]) == (58.55, 1.1, "stratify")
    assert logs.log_counts(parsed).first()["warnings"] == 3


def test_compare_log_facts(spark):
    text = ("{'logistic': {'safe_roc_auc': 0.8123, 'full_roc_auc': 0.8465, 'roc_auc_delta_full_minus_safe': 0.0342, 'f1_delta_full_minus_safe': 0.043}, "
            "'catboost': {'safe_roc_auc': 0.834, 'full_roc_auc': 0.841, 'roc_auc_delta_full_minus_safe': 0.007, 'f1_delta_full_minus_safe': 0.012}}")
    row = logs.compare_facts(logs.parse_logs(log(spark, text, "20260424_1_compare.log"))).first()
    assert (row["n_models"], row["best_gain_model"], row["worst_gain_model"], row["advice"]) == (2, "logistic", "catboost", "full_gains_check_leakage")


def test_advanced_log_facts(spark):
    text = "Analyzing fairness for logistic...\nAnalyzing fairness for catboost...\nresults/fairness_logistic.json\nresults/fairness_catboost.json\nFairness analysis completed in 2.50s\n⚠ warning: low"
    parsed = logs.parse_logs(log(spark, text, "20260424_1_fairness.log"))
    counts = logs.log_counts(parsed).first()
    assert logs.advanced_facts(parsed).first()["n_models"] == 2 and counts["json"] == 2 and counts["last_seconds"] == 2.5


def test_mojibake(spark):
    good = "báo cáo: cà phê đã được sửa"
    broken = good.encode("utf-8").decode("latin-1")
    rows = spark.createDataFrame([(broken,), (good,), ("plain",), (broken + "â\u0080",)], "content string")
    out = [r[0] for r in rows.select(logs.repair_mojibake()).collect()]
    assert out[0] == good and out[1] == good and out[2] == "plain" and out[3] == good


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(size=500)], "g string, v double")
    rows = charts.density(df, "v", ["g"]).orderBy("x").collect()
    area = np.trapezoid([r["density"] for r in rows], [r["x"] for r in rows])
    assert 0.9 < area < 1.02
