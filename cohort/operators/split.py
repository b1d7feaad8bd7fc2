"""Exact, reproducible splits, folds and under-sampling by row-key hash.

A row's place in its class is its rank by hash. Ranks are taken inside hash slots, so a
class holding most of the table is still ordered by many tasks, and slot offsets (one row
per class and slot) turn them into ranks within the class.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.columns import column, join_groups
from cohort.functions.hashing import uniform
from cohort.operators.rank import bucket_count, numbered
from cohort.session import cut_lineage


def hash_rank(df: DataFrame, key: str, tag: str, by: Sequence[str], out: str = "_rank", slots: int | None = None) -> DataFrame:
    """Add the 1-based rank of each row within ``by`` in hash order; the key breaks ties.

    The hash decides the slot, so the rank equals a sort of the whole group.
    """
    slots = slots or 8 * bucket_count(df)
    keys = [column(c) for c in by]
    marked = df.withColumn("_u", uniform(key, tag)).withColumn("_slot", F.floor(F.col("_u") * slots).cast("int"))
    sizes = marked.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("_u", column(key))
    ranked = marked.withColumn("_inside", F.row_number().over(inside))
    joined = join_groups(ranked, offsets, [*by, "_slot"])  # a null group is a group
    return joined.select(*[column(c) for c in df.columns], (F.col("_inside") + F.col("_before")).alias(out))


def stratum_key(df: DataFrame, target: str, columns: Sequence[str] = ()) -> DataFrame:
    """Add ``_stratum``: target and columns joined by ``_``; a singleton falls back to its target."""
    parts = [F.coalesce(column(c).cast("string"), F.lit("None")) for c in [target, *columns]]
    full = F.concat_ws("_", *parts)
    if not columns:
        return df.withColumn("_stratum", full)
    marked = df.withColumn("_full", full)
    single = marked.groupBy("_full").agg(F.count(F.lit(1)).alias("_k")).filter("_k = 1").select("_full", F.lit(1).alias("_single"))
    return marked.join(single, "_full", "left").withColumn(
        "_stratum", F.when(F.col("_single") == 1, parts[0]).otherwise(F.col("_full"))
    ).drop("_full", "_single")


def detect_strata(df: DataFrame, limit: int = 10) -> list[str]:
    """Gender and family-history columns of at most ``limit`` levels, by normalised name."""
    tidy = {c: c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns}
    found = []
    for test in (lambda n: n in ("gender", "gioi_tinh"), lambda n: "family_history" in n or "tien_su" in n):
        match = next((c for c in df.columns if test(tidy[c])), None)
        if match is not None and df.select(column(match)).distinct().limit(limit + 1).count() <= limit:
            found.append(match)
    return found


def _quotas(sizes: DataFrame, share: float) -> DataFrame:
    """Test rows per stratum: proportional, largest remainders first, summing to the exact size.

    Strata are numbered by a sort across the cluster, so any number of them will do.
    """
    sizes = cut_lineage(sizes.select("_stratum", "_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    big = "decimal(38,0)"
    test = F.ceil(F.round(F.lit(float(share)) * F.lit(total), 9))
    sized = sizes.select("_stratum", "_n", F.lit(total).cast(big).alias("_total"), test.cast(big).alias("_test"))
    product = F.col("_n").cast(big) * F.col("_test")
    base = sized.select("*", F.floor(product / F.col("_total")).cast("long").alias("_guess"), product.alias("_product"))
    # decimal division may round up at the last digit; correct it with exact integers
    over = F.col("_guess").cast(big) * F.col("_total") > F.col("_product")
    exact_base = base.withColumn("_base", F.when(over, F.col("_guess") - 1).otherwise(F.col("_guess"))).withColumn(
        "_rest", F.col("_product") - F.col("_base").cast(big) * F.col("_total"))
    placed = numbered(exact_base.select("_stratum", "_base", "_rest", F.col("_test").cast("long").alias("_test")), [F.desc("_rest"), F.col("_stratum")])
    left = placed.agg((F.max("_test") - F.sum("_base")).alias("n")).first()["n"]
    return placed.select("_stratum", (F.col("_base") + (F.col("_rank") <= F.lit(left or 0)).cast("long")).alias("_quota"))


def stratified_split(
    df: DataFrame, key: str, target: str, columns: Sequence[str] | None = (), test_size: float = 0.2, tag: str = "split",
    excluded: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``split`` = train or test; every stratum gives its exact share of test rows.

    ``columns=None`` detects the demographic columns.
    """
    work = df.drop(*[c for c in excluded if c in df.columns])
    if target not in work.columns:
        raise ValueError(f"target column {target!r} not found")
    columns = detect_strata(work) if columns is None else columns
    keyed = stratum_key(work, target, [c for c in columns if c in work.columns and c != target])
    ranked = hash_rank(keyed, key, tag, ["_stratum"])
    quotas = _quotas(keyed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n")), test_size)
    label = F.when(F.col("_rank") <= F.col("_quota"), "test").otherwise("train")
    return ranked.join(quotas, "_stratum").withColumn("split", label).select(*[column(c) for c in work.columns], "split")


def target_split(df: DataFrame, key: str, target: str, test_size: float = 0.2, tag: str = "split") -> DataFrame:
    return stratified_split(df, key, target, (), test_size, tag)


def take_rows(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose key appears in ``members``."""
    return df.join(members.select(column(key)), key, "left_semi")


def stratified_folds(df: DataFrame, key: str, target: str, k: int = 5, tag: str = "fold") -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes differ by at most one within a class."""
    ranked = hash_rank(df, key, tag, [target])
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def undersample(df: DataFrame, key: str, target: str, strategy: str | Mapping = "auto", tag: str = "under") -> DataFrame:
    """Random rows of the larger classes down to the smallest class, or to given class sizes.

    Rows without a class are no class: they stay and do not set the size.
    """
    ranked = hash_rank(df, key, tag, [target])
    sizes = df.groupBy(column(target)).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(strategy, Mapping):
        wanted = reduce(lambda c, kv: c.when(column(target) == kv[0], F.lit(int(kv[1]))), strategy.items(), F.when(F.lit(False), F.lit(0)))
        limits = sizes.select(column(target), F.least(F.coalesce(wanted, F.col("_n")), F.col("_n")).alias("_limit"))
    elif strategy in ("auto", "majority"):
        smallest = F.min(F.when(column(target).isNotNull(), F.col("_n"))).over(Window.partitionBy())  # one row per class
        limits = sizes.select(column(target), F.when(column(target).isNull(), F.col("_n")).otherwise(smallest).alias("_limit"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return join_groups(ranked, limits, [target]).filter(F.col("_rank") <= F.col("_limit")).select(*[column(c) for c in df.columns])


def split_balance(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Share of every level in the whole table, in train and in test, and the larger deviation."""
    from cohort.functions.columns import melt

    long = melt(df, columns, [split], name="column", value="level")
    is_test = column(split) == "test"
    counts = long.groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(~is_test, 1)).alias("n_train"), F.count(F.when(is_test, 1)).alias("n_test"))
    sizes = counts.groupBy("column").agg(*[F.sum(f"n_{p}").alias(f"_{p}") for p in ("total", "train", "test")])
    share = lambda p: F.when(F.col(f"_{p}") > 0, F.col(f"n_{p}") / F.col(f"_{p}") * 100.0)
    out = counts.join(sizes, "column")
    diff = F.greatest(F.abs(share("train") - share("total")), F.abs(share("test") - share("total")))
    return out.select("column", "level", "n_total", "n_train", "n_test", *[share(p).alias(f"{p}_pct") for p in ("total", "train", "test")],
                      diff.alias("max_diff"))


def split_report(df: DataFrame, target: str, columns: Sequence[str], numeric: Sequence[str], split: str = "split") -> dict[str, DataFrame]:
    """Sizes, target and level balance, and the KS distance of every numeric column."""
    from cohort.operators.stats import ks_two_sample

    sizes = df.groupBy(column(split)).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # two rows
    return {
        "sizes": sizes.select("*", (F.col("n") / F.sum("n").over(whole) * 100.0).alias("pct")),
        "balance": split_balance(df, [target, *columns], split),
        "ks": ks_two_sample(df, numeric, split, "train", "test"),
    }
