"""Data profiles and group aggregates; all columns of a table share one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort import roles as R
from cohort.functions.columns import column, count_if, join_groups, labelled, melt, numeric_columns, ratio, string_columns
from cohort.operators.rank import medians, quantiles, value_cells

# aggregate names of a group summary
AGGREGATES = {
    "mean": F.avg, "std": F.stddev_samp, "count": F.count, "min": F.min, "max": F.max, "sum": F.sum,
    "var": F.var_samp, "n_unique": F.count_distinct,
}
DEFAULT_AGGREGATES = ["mean", "std", "median", "count", "min", "max"]


def aggregate_by_group(
    df: DataFrame, group: str, value: str | None = None, metrics: Mapping[str, str | Column] | None = None
) -> DataFrame:
    """Group summary ``{column}_{function}``.

    ``value`` alone gives the six default statistics. ``metrics`` maps a function name to a
    column, or an alias to a ready aggregate Column; unknown names are skipped. ``first`` and
    ``last`` take a pair ``(column, order column)``, since rows of a table have no order of their own.
    """
    if metrics is None:
        if value is None:
            raise ValueError("give a value column or a metrics mapping")
        metrics = {name: value for name in DEFAULT_AGGREGATES}
    aggs, middles = [], []
    for name, target in metrics.items():
        if isinstance(target, Column):
            aggs.append(target.alias(name))
        elif name in ("first", "last"):
            if isinstance(target, str):
                raise ValueError(f"{name} needs a pair (column, order column)")
            pick = F.min_by if name == "first" else F.max_by
            aggs.append(pick(column(target[0]), column(target[1])).alias(f"{target[0]}_{name}"))
        elif name == "median":
            middles.append(target)
        elif name in AGGREGATES:
            aggs.append(AGGREGATES[name](column(target)).alias(f"{target}_{name}"))
    aggs = aggs or [F.count(F.lit(1)).alias("count")]
    out = df.groupBy(column(group)).agg(*aggs)
    for target in middles:
        middle = medians(df, [target], [group]).select(
            column(group).alias("_g"), F.col("median").alias(f"{target}_median")
        )
        out = out.join(middle, column(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    return out


def _moments(df: DataFrame, names: Sequence[str], by: Sequence[str], parts: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``(by, column, parts...)`` from one aggregate over the columns side by side; no row is repeated per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[part(column(c).cast("double")).alias(k) for k, part in parts.items()]) for c in names])
    keys = [column(k) for k in by]
    return df.groupBy(*keys).agg(rows.alias("_m")).select(*keys, F.explode("_m").alias("_m")).select(*keys, "_m.*")


def describe(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Count, nulls, mean, SD, minimum, quartiles and maximum, one row per numeric column."""
    names = numeric_columns(df) if names is None else list(names)
    moments = _moments(df, names, (), {
        "count": F.count, "null_count": lambda x: F.count(F.when(x.isNull(), 1)), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quarts = quantiles(df, names, [0.25, 0.5, 0.75]).drop("n")
    return moments.join(quarts, "column", "left")


def descriptive_stats(df: DataFrame, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``describe`` plus skewness and (excess) kurtosis, population form; optionally per group."""
    names = [c for c in numeric_columns(df) if c not in by] if names is None else list(names)
    keys = [*by, "column"]
    moments = _moments(df, names, by, {
        "n": F.count, "missing": lambda x: F.count(F.when(x.isNull(), 1)), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "skew": F.skewness, "kurtosis": F.kurtosis})
    quarts = quantiles(df, names, [0.25, 0.5, 0.75], by).drop("n").withColumnRenamed("q50", "median")
    return join_groups(moments, quarts, keys, "left")


def value_counts(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, column, value, n)`` over text forms of the values, null as a value of its own."""
    return melt(df, names, by).groupBy(*[column(c) for c in by], "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _top(n: Column, value: Column) -> Column:
    """Smallest struct = most frequent value, lowest value (null first) on ties."""
    return F.min(F.struct((-n).alias("neg"), value.alias("value")))


def column_profile(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Missing and distinct counts and the most frequent value of each column."""
    names = df.columns if names is None else list(names)
    kinds = F.create_map(*[F.lit(x) for n, t in df.dtypes if n in names for x in (n, t)])
    counts = value_counts(df, names)
    return counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count(F.lit(1)).alias("n_unique"), _top(F.col("n"), F.col("value")).alias("_t"),
    ).select(
        "column", F.element_at(kinds, F.col("column")).alias("dtype"), "rows", "missing",
        (F.col("missing") / F.col("rows") * 100.0).alias("missing_pct"), "n_unique",
        (F.col("n_unique") / F.col("rows") * 100.0).alias("unique_pct"),
        F.col("_t.value").alias("top_value"), (-F.col("_t.neg") / F.col("rows") * 100.0).alias("top_pct"),
    )


def low_variance(profile: DataFrame, max_levels: int = 10, share: float = 95.0) -> DataFrame:
    """Columns of few levels dominated by one value."""
    return profile.filter((F.col("n_unique") <= max_levels) & (F.col("top_pct") > share)).select(
        "column", "n_unique", "top_value", "top_pct"
    )


def near_constant(profile: DataFrame, target: str | None = None) -> DataFrame:
    out = low_variance(profile, max_levels=2)
    return out.filter(F.col("column") != target) if target else out


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(column(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per class
    return counts.select("label", "n", (F.col("n") / F.sum("n").over(whole) * 100.0).alias("pct"))


def data_profile(df: DataFrame, target: str | None = None, excluded: Sequence[str] = ()) -> dict[str, DataFrame]:
    profile = column_profile(df)
    out = {
        "columns": profile,
        "low_variance": low_variance(profile.filter(~F.col("column").isin(list(excluded)))),
    }
    if target:
        out["classes"] = class_distribution(df, target)
    return out


def quality(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, completeness, and unique and duplicate row counts."""
    missing = [count_if(column(c).isNull()) for c in df.columns]
    cells = df.groupBy(*[column(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_k"))
    per = cells.agg(
        F.sum("_k").alias("rows"), F.count(F.lit(1)).alias("unique_rows"),
        F.sum(sum((column(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long")) * F.col("_k")).alias("missing"),
    ) if missing else None
    width = F.lit(len(df.columns)).cast("long")
    return per.select(
        "rows", width.alias("columns"), "missing", "unique_rows", (F.col("rows") - F.col("unique_rows")).alias("duplicate_rows"),
        ((F.lit(1.0) - F.col("missing") / (F.col("rows") * width)) * 100.0).alias("completeness_pct"),
    )


def missing_table(df: DataFrame) -> DataFrame:
    """Columns that have nulls, with count and share; a single aggregate over the table."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_if(column(c).isNull()).alias(c) for c in df.columns])
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), column(c).alias("missing")) for c in df.columns])
    )
    return row.select("_rows", rows.alias("r")).select(
        "r.column", "r.missing", (F.col("r.missing") / F.col("_rows") * 100.0).alias("missing_pct")
    ).filter(F.col("missing") > 0)


def rare_categories(df: DataFrame, max_levels: int | None = 20, share: float = 1.0, names: Sequence[str] | None = None) -> DataFrame:
    """Text values held by less than ``share`` percent of rows, in columns of few levels."""
    names = string_columns(df) if names is None else list(names)
    counts = value_counts(df, names)
    totals = counts.groupBy("column").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_levels"))
    if max_levels is not None:
        totals = totals.filter(F.col("_levels") <= max_levels)
    pct = F.col("n") / F.col("_rows") * 100.0
    return counts.join(totals, "column").select("column", "value", "n", pct.alias("pct")).filter(F.col("pct") < share)


def quality_warnings(
    df: DataFrame, target: str = R.TARGET, sensitive: str | None = R.SENSITIVE, yes: str = "Yes",
    positive_limit: float = 55.0, sensitive_limit: float = 50.0,
) -> DataFrame:
    """Quality gates that fired: ``(gate, detail, value)``."""
    parts = []
    rates = [(F.avg((column(target) == 1).cast("double")) * 100.0).alias("positive")]
    has_sensitive = sensitive is not None and sensitive in df.columns
    if has_sensitive:
        rates.append((F.avg(F.coalesce((column(sensitive) == yes).cast("double"), F.lit(0.0))) * 100.0).alias("sensitive"))
    shares = df.agg(*rates)
    parts.append(
        shares.filter(F.col("positive") > positive_limit).select(
            F.lit("positive_rate").alias("gate"), F.lit(target).alias("detail"), F.col("positive").alias("value"))
    )
    if has_sensitive:
        parts.append(
            shares.filter(F.col("sensitive") > sensitive_limit).select(
                F.lit("sensitive_rate").alias("gate"), F.lit(sensitive).alias("detail"), F.col("sensitive").alias("value"))
        )
    parts.append(
        missing_table(df).select(F.lit("missing_values").alias("gate"), F.col("column").alias("detail"),
                                 F.col("missing").cast("double").alias("value"))
    )
    rare = rare_categories(df, max_levels=None)
    parts.append(
        rare.groupBy("column").agg(F.count(F.lit(1)).alias("k")).select(
            F.lit("rare_category").alias("gate"), F.col("column").alias("detail"), F.col("k").cast("double").alias("value"))
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def data_review(df: DataFrame, target: str = R.TARGET, sensitive: str | None = R.SENSITIVE, excluded: Sequence[str] = R.EXCLUDED) -> DataFrame:
    """Missing values, rare categories, near-constant columns and gates as ``(section, column, key, value)``."""
    kept = df.drop(*[c for c in excluded if c in df.columns])
    profile = column_profile(df)
    dropped = profile.filter(F.col("column").isin(list(excluded)))
    review = profile.filter(~F.col("column").isin(list(excluded)))

    def rows(table: DataFrame, section: str, key: str | Column, value: str, name: str = "column") -> DataFrame:
        key = F.lit(key) if isinstance(key, str) else key
        return table.select(
            F.lit(section).alias("section"), column(name).alias("column"), key.alias("key"), column(value).cast("double").alias("value")
        )

    return (
        rows(review.filter("missing > 0"), "missing", "count", "missing")
        .unionByName(rows(rare_categories(kept), "rare_category", F.col("value"), "pct"))
        .unionByName(rows(near_constant(review, target), "near_constant", F.col("top_value"), "top_pct"))
        .unionByName(rows(dropped, "dropped", F.col("top_value"), "top_pct"))
        .unionByName(rows(quality_warnings(kept, target, sensitive), "warning", F.col("gate"), "value", "detail"))
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Class counts and shares with the largest-to-smallest ratio and its severity."""
    counts = df.groupBy(column(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per class
    worst = F.max("n").over(whole) / F.min("n").over(whole)
    return counts.select("label", "n", (F.col("n") / F.sum("n").over(whole)).alias("ratio"), worst.alias("imbalance_ratio")).select(
        "*", F.when(F.col("imbalance_ratio") > 10, "severe").when(F.col("imbalance_ratio") > 3, "moderate").otherwise("acceptable").alias("severity")
    )


def crosstab(df: DataFrame, rows: Sequence[str], col: str) -> DataFrame:
    """Counts and row shares of each column in ``rows`` against ``col``; nulls are left out.

    Long form without zero cells: ``(column, level, other, n, row_pct)``.
    """
    long = melt(df, rows, [col], name="column", value="level").select(
        "column", "level", column(col).cast("string").alias("other")
    ).dropna()
    cells = long.groupBy("column", "level", "other").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("column", "level")) * 100.0
    return cells.select("*", share.alias("row_pct"))


def target_rate(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Rows and positive rate per level of each column."""
    long = melt(df, names, [target], name="column", value="level").filter(F.col("level").isNotNull())
    return long.groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(column(target).cast("double")).alias("target_rate")
    )


def synthetic_check(
    df: DataFrame, target: str = R.TARGET, sensitive: str = R.SENSITIVE, age: str = "Age", score: str = "CGPA",
    city: str = "City", binary: str = "Family History of Mental Illness",
) -> DataFrame:
    """Signs of generated data: shares, age spread, city count, balance, and the red-flag count."""
    yes = lambda c: F.avg(F.coalesce((column(c) == "Yes").cast("double"), F.lit(0.0))) * 100.0
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"), yes(sensitive).alias("sensitive_pct"),
        (F.avg(column(target).cast("double")) * 100.0).alias("target_pct"),
        F.avg(column(age)).alias("age_mean"), F.stddev_pop(column(age)).alias("age_std"),
        F.min(column(age)).cast("long").alias("age_min"), F.max(column(age)).cast("long").alias("age_max"),
        (F.avg(column(age).between(18, 24).cast("double")) * 100.0).alias("age_18_24_pct"),
        F.avg(column(score)).alias("score_mean"), F.stddev_pop(column(score)).alias("score_std"),
        F.min(column(score)).alias("score_min"), F.max(column(score)).alias("score_max"),
        yes(binary).alias("binary_yes_pct"),
    ).withColumn("_one", F.lit(1))
    top = column_profile(df, [city]).select(
        F.lit(1).alias("_one"), F.col("n_unique").alias("n_cities"), F.col("top_value").alias("top_city"), F.col("top_pct").alias("top_city_pct"))
    joined = stats.join(top, "_one").drop("_one")
    flags = {
        "sensitive_level": F.when(F.col("sensitive_pct") > 50, "very high").when(F.col("sensitive_pct") > 30, "high").otherwise("normal"),
        "target_level": F.when(F.col("target_pct") > 50, "very high").when(F.col("target_pct") > 30, "high").otherwise("normal"),
        "age_level": F.when(F.col("age_18_24_pct") < 50, "unusual").otherwise("normal"),
        "binary_level": F.when((F.col("binary_yes_pct") > 40) & (F.col("binary_yes_pct") < 60), "too balanced").otherwise("normal"),
    }
    flagged = joined.select("*", *[c.alias(k) for k, c in flags.items()])
    total = sum(((F.col(k) != "normal").cast("int") for k in flags), F.lit(0))
    return flagged.withColumn("total_warnings", total).withColumn("likely_synthetic", F.col("total_warnings") >= 3)


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over rows complete in that pair, one aggregate."""
    names = numeric_columns(df) if names is None else list(names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = column(a).cast("double"), column(b).cast("double")
        aggs += [F.corr(x, y).alias(f"r{i}"), count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    row = df.agg(*aggs)
    items = F.explode(
        F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    )
    return row.select(items.alias("i")).select("i.*")


def top_categories(df: DataFrame, name: str, top: int = 10, min_size: int = 30, other: str = "Other", out: str = "category") -> DataFrame:
    """Rows labelled with one of the most frequent values or ``other``; small groups drop out.

    Ties in frequency go to the lower value.
    """
    counts = df.filter(column(name).isNotNull()).groupBy(column(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.orderBy(F.desc("_n"), "_value").limit(top)  # at most ``top`` rows
    labelled_rows = df.join(F.broadcast(kept), column(name) == F.col("_value"), "left").withColumn(
        out, F.when(F.col("_value").isNotNull(), F.col("_value").cast("string")).otherwise(F.lit(other))
    )
    sizes = labelled_rows.groupBy(out).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= min_size)
    return labelled_rows.drop("_value", "_n").join(sizes.select(out), out, "left_semi")


def category_labels(df: DataFrame, name: str, top: int = 10, other: str = "Other") -> DataFrame:
    """Counts of the top categories with the rest folded into ``other``."""
    rows = top_categories(df, name, top, min_size=1, other=other)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
