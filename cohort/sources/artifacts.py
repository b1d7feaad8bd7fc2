"""Catalogue of result files and reader of past run reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Folders left out of scans, and file-name rules of past reports.
EXCLUDED_PARTS = ["app_cache", "test-fixtures", "__pycache__"]
PREFIX_RULES = [
    ("run_", "run"),
    ("compare_profiles", "compare"),
    ("fairness_", "fairness"),
    ("subgroup_", "subgroups"),
    ("robustness_", "robustness"),
    ("split_report", "split"),
    ("leakage_investigation", "review"),
    ("model_results_", "models"),
    ("model_comparison_report", "report"),
    ("gam_interpretation", "analysis"),
    ("research_", "analysis"),
]
PROFILE_STEMS = ["dataset_summary", "dataset_profile", "eda_data_profile"]


def file_name(path: str | Column = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: str | Column = "path") -> Column:
    return F.regexp_replace(F.lower(file_name(path)), r"\.[^.]*$", "")


def scan_artifacts(spark: SparkSession, roots: Sequence[str], suffix: str, excluded: Sequence[str] = EXCLUDED_PARTS) -> DataFrame:
    """Files below the roots, newest first: ``(path, name, size, modified)``; contents stay unread."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True)
    files = reader.load(list(roots)).select("path", file_name().alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    kept = files.filter(~F.arrays_overlap(parts, F.array(*[F.lit(e) for e in excluded]))) if excluded else files
    return kept.dropDuplicates(["path"]).orderBy(F.desc("modified"), "path")


def latest_per_workflow(files: DataFrame, workflow: Column) -> DataFrame:
    newest = Window.partitionBy("workflow").orderBy(F.desc("modified"), "path")
    return files.withColumn("workflow", workflow).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def report_workflow(content: Column, path: str = "path") -> Column:
    """Kind of a run report: by its top-level keys, else by its file name."""
    keys = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    has = lambda *names: reduce(lambda a, b: a & b, [F.array_contains(keys, n) for n in names])
    stem = file_stem(path)
    out = F.when(has("config", "dataset", "split", "models"), "run").when(has("preset", "profiles", "summary"), "compare")
    out = out.when(has("summary", "warnings"), "profile").when(stem.isin(PROFILE_STEMS), "profile")
    for prefix, workflow in PREFIX_RULES:
        out = out.when(stem.startswith(prefix), workflow)
    return out.otherwise("report")


def run_history(reports: DataFrame) -> DataFrame:
    """One summary row per report from ``(path, content)``: workflow, settings and size."""
    c = F.col("content")
    get = lambda p: F.get_json_object(c, p)
    workflow = report_workflow(c)
    length = lambda p: F.coalesce(F.json_array_length(get(p)), F.lit(0))
    models = F.array_join(F.from_json(get("$.config.models"), "array<string>"), ", ")
    summary_keys = F.coalesce(F.json_object_keys(get("$.summary")), F.array().cast("array<string>"))
    rows = F.coalesce(get("$.dataset.rows"), get("$.summary.rows"), get("$.shape.rows"), get("$.rows")).try_cast("long")
    return reports.select(
        "path", file_name().alias("name"), workflow.alias("workflow"),
        F.coalesce(get("$.config.preset"), get("$.preset")).alias("preset"), get("$.config.profile").alias("profile"),
        get("$.config.training_budget_mode").alias("budget"), rows.alias("rows"),
        F.coalesce(get("$.summary.cols"), get("$.shape.cols"), get("$.cols")).try_cast("long").alias("cols"),
        get("$.split.test_size").try_cast("double").alias("test_size"),
        F.when(workflow == "compare", F.array_join(summary_keys, ", ")).otherwise(models).alias("models"),
        F.when(workflow == "compare", F.size(summary_keys)).otherwise(F.lit(0)).alias("delta_count"),
        F.when(workflow == "profile", length("$.warnings")).otherwise(F.lit(0)).alias("warning_count"),
        F.array_join(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")), ", ").alias("keys"),
    )


def read_history(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Summary rows of the JSON reports below the roots."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(list(roots))
    return run_history(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
