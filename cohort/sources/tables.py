"""Readers and writers of tables, with schema checks and a Parquet cache for CSV."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohort.functions.columns import column, require
from cohort.roles import ColumnRoles
from cohort.session import ensure_checkpoint_dir


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV scan; give a schema to spare the inference pass over large files."""
    reader = spark.read.option("header", header).option("nanValue", "NaN")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as nulls, so that every aggregate skips them."""
    return df.select(*[
        F.when(~F.isnan(column(n)), column(n)).alias(n) if t in ("double", "float") else column(n) for n, t in df.dtypes
    ])


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are kept as fields."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_value(value):
    """A value as plain JSON types: numbers, text, lists, maps; NaN becomes null."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    if hasattr(value, "asDict"):
        return json_value(value.asDict())
    if isinstance(value, dict):
        return {str(k): json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_value(v) for v in value]
    if hasattr(value, "item"):
        return json_value(value.item())
    return str(value)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small JSON document, written where executors and driver both can read it."""
    spark.createDataFrame([(json.dumps(json_value(document), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Result tables of an analysis, one folder each."""
    writers = {"parquet": write_parquet, "json": write_json, "csv": write_csv}
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        writers[fmt](df, paths[name])
    return paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, on storage every executor shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


# ---------------------------------------------------------------- schema contract

def check_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> None:
    """Raise one error that names every missing column."""
    require(df, required, what)


def schema_issues(df: DataFrame, roles: ColumnRoles, profile: str = "full") -> DataFrame:
    """Expected columns with their presence, and the share found."""
    require(df, [roles.target], "dataset")
    expected = roles.features(profile)
    found = sum(c in df.columns for c in expected)
    share = 100.0 * found / len(expected) if expected else 100.0
    rows = [(c, "target" if c == roles.target else "feature", c in df.columns, share) for c in [roles.target, *expected]]
    return df.sparkSession.createDataFrame(rows, "column string, role string, present boolean, found_pct double")


# ---------------------------------------------------------------- cache

@dataclass
class CachedTable:
    """A loaded table and where it came from."""

    path: str
    frame: DataFrame
    cache_path: str
    from_cache: bool


def file_stamp(spark: SparkSession, path: str) -> str:
    """Name, size and time of the source files as one short key; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    row = files.agg(
        F.sum("length").alias("size"), F.max(F.unix_micros("modificationTime")).alias("time"),
        F.hex(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).alias("key"),
    ).first()
    return f"{stem}-{row['size']}-{row['time']}-{row['key']}"


def load_cached(spark: SparkSession, path: str, cache_dir: str, schema: StructType | str | None = None) -> CachedTable:
    """CSV through a Parquet copy that is rebuilt when the source changes.

    A note beside the copy is written last; without it the copy counts as unfinished.
    """
    target = f"{cache_dir.rstrip('/')}/{file_stamp(spark, path)}.parquet"
    try:
        read_document(spark, target + ".done")
        return CachedTable(path, spark.read.parquet(target), target, True)
    except AnalysisException:
        write_parquet(nan_to_null(read_csv(spark, path, schema)), target)
        write_document(spark, {"source": path}, target + ".done")
        return CachedTable(path, spark.read.parquet(target), target, False)


def sample_survey(ids: DataFrame, key: str, seed: str = "sample") -> DataFrame:
    """Generated score table, one row per key: every value is a function of the key and seed."""
    from cohort.functions.columns import clip
    from cohort.functions.hashing import exponential, normal, uniform

    u = lambda tag: uniform(key, f"{seed}:{tag}")
    n = lambda tag: normal(key, f"{seed}:{tag}")
    pick = lambda tag, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(u(tag) * len(names)) + 1).cast("int"))
    return ids.select(
        column(key).alias("student_id"), (F.lit(15) + F.floor(u("age") * 15)).cast("int").alias("age"), pick("gender", "Nam", "Nữ").alias("gender"),
        pick("education", "High School", "University", "Graduate").alias("education_level"),
        F.floor(clip(F.lit(12.0) + F.lit(5.0) * n("score"), 0.0, 27.0)).cast("int").alias("depression_score"),
        F.round(F.lit(2.0) + F.lit(2.0) * u("gpa"), 2).alias("gpa"),
        F.round(clip(F.lit(6.5) + F.lit(1.5) * n("sleep"), 3.0, 12.0), 1).alias("sleep_hours"),
        F.round(clip(exponential(key, f"{seed}:exercise", 2.0), 0.0, 20.0), 1).alias("exercise_hours_per_week"),
        F.round(clip(F.lit(50.0) + F.lit(15.0) * n("support"), 0.0, 100.0), 1).alias("social_support_score"),
        (F.lit(1) + F.floor(u("stress") * 10)).cast("int").alias("stress_level"),
    )
