"""Synthetic over-sampling and neighbour-based cleaning of ``id, vec, y`` tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from cohort.functions.hashing import uniform
from cohort.operators.neighbors import knn
from cohort.operators.split import hash_rank


def _targets(sizes: dict, strategy: str | Mapping) -> dict:
    """New rows wanted per class."""
    top = max(sizes.values())
    if isinstance(strategy, Mapping):
        return {c: max(0, int(n) - sizes[c]) for c, n in strategy.items()}
    if strategy == "auto":
        return {c: top - n for c, n in sizes.items()}
    if strategy == "minority":
        low = min(sizes, key=lambda c: (sizes[c], str(c)))
        return {low: top - sizes[low]}
    raise ValueError(f"unknown strategy {strategy!r}")


def smote(table: DataFrame, strategy: str | Mapping = "auto", k: int = 5, tag: str = "smote") -> DataFrame:
    """Original rows plus synthetic ones: ``id, vec, y, is_synthetic``.

    A synthetic row lies between a row and one of its k nearest rows of the same class. New
    rows are dealt out evenly over the class in hash order; the neighbour and the position
    on the segment are hash draws of (row, copy number). Synthetic ids are negative.
    """
    table = table.select("id", "vec", "y").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["y"]: r["count"] for r in table.groupBy("y").count().collect()}  # one row per class
    out = [table.withColumn("is_synthetic", F.lit(False))]
    for label, extra in sorted(_targets(sizes, strategy).items(), key=lambda kv: str(kv[0])):
        if extra <= 0:
            continue
        rows = table.filter(F.col("y") == label)
        size = sizes[label]
        if size < 2:
            raise ValueError(f"class {label!r} has too few rows to interpolate")
        reach = min(k, size - 1)
        pairs = knn(rows, reach)
        ranked = hash_rank(rows, "id", tag, [])
        share = F.lit(extra // size) + (F.col("_rank") <= extra % size).cast("int")
        copies = ranked.withColumn("copies", share).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        seed = F.concat_ws(":", F.col("id").cast("string"), F.col("copy").cast("string"))
        drawn = copies.select(
            F.col("id"), F.col("vec"), "_rank", "copy", (F.floor(uniform(seed, tag + ":neighbor") * reach) + 1).cast("int").alias("position"),
            uniform(seed, tag + ":gap").alias("gap"))
        near = drawn.join(pairs.select("id", "position", "neighbor"), ["id", "position"])
        ends = near.join(rows.select(F.col("id").alias("neighbor"), F.col("vec").alias("_to")), "neighbor")
        made = F.zip_with("vec", "_to", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        vec = F.transform(made, lambda p: p["a"] + F.col("gap") * (p["b"] - p["a"]))
        number = F.col("_rank") + (F.col("copy") - 1) * F.lit(size)
        offset = sum(n for c, n in _targets(sizes, strategy).items() if str(c) < str(label))
        out.append(ends.select((-(number + offset)).cast("long").alias("id"), vec.alias("vec"), F.lit(label).alias("y"), F.lit(True).alias("is_synthetic")))
    return reduce(DataFrame.unionByName, out)


def _neighbor_labels(table: DataFrame, k: int) -> DataFrame:
    labels = table.select(F.col("id").alias("neighbor"), F.col("y").alias("other"))
    return knn(table, k).join(labels, "neighbor").join(table.select("id", "y"), "id")


def tomek_links(table: DataFrame) -> DataFrame:
    """Rows in a pair of mutual nearest neighbours of different classes."""
    pairs = _neighbor_labels(table, 1).select("id", "neighbor", "y", "other").persist(StorageLevel.MEMORY_AND_DISK)
    back = pairs.select(F.col("id").alias("neighbor"), F.col("neighbor").alias("id"))
    return pairs.filter(F.col("y") != F.col("other")).join(back, ["id", "neighbor"], "left_semi").select("id")


def drop_tomek_links(table: DataFrame) -> DataFrame:
    return table.join(tomek_links(table), "id", "left_anti")


def edited_neighbors(table: DataFrame, k: int = 3) -> DataFrame:
    """Keep a row only if its k nearest rows all share its class."""
    bad = _neighbor_labels(table, k).filter(F.col("y") != F.col("other")).select("id").distinct()
    return table.join(bad, "id", "left_anti")


def _kept(table: DataFrame) -> DataFrame:
    return table.persist(StorageLevel.MEMORY_AND_DISK)


def smote_tomek(table: DataFrame, strategy: str | Mapping = "auto", k: int = 5) -> DataFrame:
    return drop_tomek_links(_kept(smote(table, strategy, k)))


def smote_enn(table: DataFrame, strategy: str | Mapping = "auto", k: int = 5) -> DataFrame:
    return edited_neighbors(_kept(smote(table, strategy, k)))


METHODS = {
    "original": lambda t: t.withColumn("is_synthetic", F.lit(False)), "smote": smote, "smote_tomek": smote_tomek, "smote_enn": smote_enn,
}


def compare_methods(table: DataFrame, methods: Sequence[str] = ("original", "smote", "smote_tomek", "smote_enn")) -> DataFrame:
    """Rows, class counts, imbalance ratio and added rows per method."""
    counts = [METHODS[m](table).groupBy("y").agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(m)) for m in methods]
    before = table.count()
    long = reduce(DataFrame.unionByName, counts)
    return long.groupBy("method").agg(
        F.sum("n").alias("n_samples"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("y").cast("string"), "n")))).alias("classes"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"), ((F.sum("n") - before) / before * 100.0).alias("added_pct"))


def balanced_train(table: DataFrame, method: str = "smote", test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Split first, then resample the train part only."""
    from cohort.operators.split import target_split

    marked = target_split(table, "id", "y", test_size).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = marked.filter("split = 'train'").drop("split"), marked.filter("split = 'test'").drop("split")
    return METHODS[method](train), test
