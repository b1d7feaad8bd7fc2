"""Small tables behind the charts: shares, boxes, densities, histograms, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.columns import column, count_if, join_groups, melt, numeric_columns, string_columns
from cohort.functions.hashing import uniform
from cohort.operators import profile as P
from cohort.operators.rank import quantiles, value_cells


# Rows of (group, column) that may be sent to every task.
FEW_GROUPS = 50_000


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """Donut data: class shares and the gap between the largest and the smallest."""
    shares = P.class_distribution(df, target)
    whole = Window.partitionBy()  # one row per class
    return shares.select("*", (F.max("pct").over(whole) - F.min("pct").over(whole)).alias("imbalance_pct"))


def box_stats(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Five-number summary, mean, whiskers within 1.5 IQR and outlier count per column and group."""
    keys = [*by, "column"]
    quarts = quantiles(df, names, [0.25, 0.5, 0.75], by).drop("n").persist()
    if quarts.count() <= FEW_GROUPS:  # then rows meet their quartiles where they are read
        rows = melt(df, names, by, cast="double").filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("n", F.lit(1).cast("long"))
        joined = join_groups(rows, F.broadcast(quarts), keys)
    else:
        joined = join_groups(value_cells(df, names, by), quarts, keys)
    reach = F.lit(1.5) * (F.col("q75") - F.col("q25"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    return joined.groupBy(*[column(k) for k in keys]).agg(
        F.sum("n").alias("n"), F.min("value").alias("min"), F.max("q25").alias("q25"), F.max("q50").alias("median"),
        F.max("q75").alias("q75"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
    )


def _finite(value: str) -> Column:
    """Null, NaN and infinite values belong to no bin."""
    x = column(value).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _range(df: DataFrame, value: str) -> tuple[float, float]:
    """Smallest and largest finite value."""
    row = df.agg(F.min(column(value).cast("double")).alias("lo"), F.max(column(value).cast("double")).alias("hi")).first()
    return (0.0, 0.0) if row["lo"] is None else (row["lo"], row["hi"])


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the column's range; the maximum belongs to the last bin."""
    df = df.filter(_finite(value))
    low, high = _range(df, value)
    width = (high - low) / bins or 1.0
    slot = F.least(F.floor((column(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*[column(b) for b in by], slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    left = F.lit(low) + F.col("bin") * F.lit(width)
    return counts.select(*[column(b) for b in by], "bin", left.alias("left"), (left + F.lit(width)).alias("right"), "n")


def threshold_counts(df: DataFrame, value: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows below and at or above a marker line."""
    hit = column(value) >= threshold
    return df.groupBy(*[column(b) for b in by]).agg(count_if(~hit).alias("below"), count_if(hit).alias("at_or_above"))


def density(df: DataFrame, value: str, by: Sequence[str], bins: int = 200, points: int = 100) -> DataFrame:
    """Gaussian kernel density per group on a common grid (Scott's bandwidth), from binned counts.

    Each group contributes at most ``bins`` numbers, whatever its row count.
    """
    df = df.filter(_finite(value))
    low, high = _range(df, value)
    width = (high - low) / bins or 1.0
    keys = [column(b) for b in by]
    slot = F.least(F.floor((column(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counted = df.groupBy(*keys, slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("_w"), F.sum(column(value).cast("double")).alias("_s"),
        F.sum(column(value).cast("double") * column(value).cast("double")).alias("_ss"),
    )
    centre = F.lit(low) + (F.col("_slot") + F.lit(0.5)) * F.lit(width)
    n = F.sum("_w")
    groups = counted.groupBy(*keys).agg(
        n.alias("n"), F.sqrt((F.sum("_ss") - F.sum("_s") * F.sum("_s") / n) / F.greatest(n - 1, F.lit(1))).alias("_sd"),
        F.collect_list(F.struct(centre.alias("c"), F.col("_w").cast("double").alias("w"))).alias("_bins"),
    )
    h = F.greatest(F.col("_sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(width / 2.0))
    step = (high - low) / (points - 1) or 1.0
    grid = groups.withColumn("_h", h).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(low) + F.col("_i") * F.lit(step)
    kernel = F.aggregate(
        F.array_sort("_bins"), F.lit(0.0),
        lambda acc, b: acc + b["w"] * F.exp(F.lit(-0.5) * F.pow((x - b["c"]) / F.col("_h"), F.lit(2.0))),
    )
    return grid.select(*keys, x.alias("x"), (kernel / (F.col("n") * F.col("_h") * F.lit(2.5066282746310002))).alias("density"))


def stacked_shares(df: DataFrame, target: str, names: Sequence[str] | None = None, max_levels: int = 15) -> DataFrame:
    """Class shares within each level, for text columns of few levels."""
    names = [c for c in string_columns(df) if c != target] if names is None else list(names)
    cells = P.crosstab(df, names, target)
    sizes = cells.groupBy("column").agg(F.count_distinct("level").alias("_k")).filter(F.col("_k") <= max_levels)
    return cells.join(sizes.select("column"), "column", "left_semi")


def sample_rows(df: DataFrame, key: str, n: int = 5000, tag: str = "sample") -> DataFrame:
    """At most ``n`` rows chosen by key hash; the same rows whatever the partitioning."""
    return df.orderBy(uniform(key, tag), column(key)).limit(n)


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group."""
    a, b = column(x).cast("double"), column(y).cast("double")
    return df.groupBy(*[column(c) for c in by]).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"),
    )


def time_trend(df: DataFrame, time: str, value: str, by: Sequence[str] = (), window: str = "1 day") -> DataFrame:
    """Mean and row count per tumbling window and group."""
    return df.groupBy(F.window(column(time), window).alias("_w"), *[column(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column(value)).alias("mean")
    ).select(F.col("_w.start").alias("start"), *[column(b) for b in by], "n", "mean")


def category_distribution(df: DataFrame, name: str) -> DataFrame:
    counts = df.groupBy(column(name).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.lit(1).alias("_one"))
    return counts.withColumn("_one", F.lit(1)).join(total, "_one").select(
        "category", "n", (F.col("n") / F.col("_t") * 100.0).alias("pct"))


def category_by_group(df: DataFrame, name: str, group: str) -> DataFrame:
    return df.groupBy(column(name).alias("category"), column(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))


def bar_by_group(df: DataFrame, group: str, value: str, function: str = "mean") -> DataFrame:
    return P.aggregate_by_group(df, group, metrics={function: value})


def eda_tables(
    df: DataFrame, target: str, sensitive: str | None = None, numeric: Sequence[str] | None = None, excluded: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Every chart table of an exploratory pass plus a one-row summary."""
    kept = df.drop(*[c for c in excluded if c in df.columns])
    numeric = [c for c in numeric_columns(kept) if c != target] if numeric is None else list(numeric)
    tables = {
        "profile": P.column_profile(kept),
        "missing": P.missing_table(kept),
        "classes": class_shares(kept, target),
        "boxes": box_stats(kept, numeric, [target]),
        "categories": stacked_shares(kept, target),
        "correlations": P.correlation_matrix(kept, numeric),
    }
    if sensitive:
        tables["sensitive"] = P.crosstab(kept, [sensitive], target)
    tables["summary"] = eda_summary(kept, target)
    return tables


def eda_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, columns, columns with nulls and positive share."""
    nulls = [F.max(column(c).isNull().cast("int")).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), (F.avg((column(target) == 1).cast("double")) * 100.0).alias("positive_pct"), *nulls)
    with_nulls = sum((F.col(f"_n{i}") for i in range(len(df.columns))), F.lit(0))
    return row.select("rows", F.lit(len(df.columns)).alias("columns"), with_nulls.alias("columns_with_nulls"), "positive_pct")
